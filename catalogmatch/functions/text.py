"""Column functions over text: normalisation, character n-grams, hashed n-gram vectors, card texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and their Latin spelling. One to one, then one to many; what is spelled as a mark becomes a space.
LETTERS = ("абвгдезийклмнопрстуфыэёàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "abvgdeziiklmnoprstufyeeaaaaaaceeeeiiiinooooouuuuyy")
SPELLED = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ъ": "'", "ь": "'"}


def normalize_text(value: Column) -> Column:
    """Lower case, Latin letters, everything else one space; null stays null. Compatibility forms are mapped only as far as ``LETTERS`` go."""
    text = F.translate(F.lower(value.cast("string")), *LETTERS)
    for letter, spelling in SPELLED.items():
        text = F.replace(text, F.lit(letter), F.lit(spelling))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalize_exactly(spell=None):
    """An Arrow UDF that first folds compatibility forms (NFKC); ``spell`` may transliterate further than ``LETTERS``."""
    import re
    import unicodedata

    pairs = dict(zip(LETTERS[0], LETTERS[1], strict=True)) | SPELLED

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            text = unicodedata.normalize("NFKC", value).lower()
            text = spell(text) if spell else "".join(pairs.get(c, c) for c in text)
            return re.sub("[^a-z0-9]+", " ", text).strip()

        return values.map(one)

    return run


def char_ngrams(text: Column, least: int = 2, most: int = 5) -> Column:
    """All character n-grams of a normalised text with a space on either side, repeats included; none of an empty text."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    grams = lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: padded.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) > 0, F.flatten(F.array(*(grams(n) for n in range(least, most + 1))))).otherwise(F.array().cast("array<string>"))


def _blake_parts(dims: int):
    import hashlib

    @F.pandas_udf("struct<bucket:int,sign:double>")
    def run(tokens: pd.Series) -> pd.DataFrame:
        numbers = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in tokens]
        return pd.DataFrame({"bucket": [n % dims for n in numbers], "sign": [1.0 if n >> 63 else -1.0 for n in numbers]})

    return run


def hashed_token(token: Column, dims: int = 512, hash: str = "md5") -> Column:
    """struct(bucket, sign) of a token. ``md5`` stays in the JVM (first 15 hexadecimal digits and the 16th's parity); ``blake2b`` is an Arrow UDF."""
    if hash == "blake2b":
        return _blake_parts(dims)(token)
    digest = F.md5(token.cast("binary"))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return F.struct(F.pmod(number, F.lit(dims)).cast("int").alias("bucket"), F.when(F.conv(F.substring(digest, 16, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0).alias("sign"))


def ngram_vectors(texts: DataFrame, id_col: str, text_col: str, dims: int = 512, hash: str = "md5", exact: bool = False) -> DataFrame:
    """(id, bucket, value): the non-zero entries of each text's unit vector of signed n-gram counts; empty texts have none.

    With ``exact`` texts are normalised by ``normalize_exactly``.
    """
    texts = texts.select(F.col(id_col), (normalize_exactly()(F.col(text_col)) if exact else normalize_text(F.col(text_col))).alias("text"))
    grams = texts.select(F.col(id_col), F.explode(char_ngrams(F.col("text"))).alias("gram"))
    counted = grams.groupBy(id_col, "gram").agg(F.count("*").alias("n"))
    parts = counted.withColumn("h", hashed_token(F.col("gram"), dims, hash)).select(id_col, "n", "h.*")
    sums = parts.groupBy(id_col, "bucket").agg(F.sum(F.col("sign") * F.col("n")).alias("s")).where("s <> 0")
    norms = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.join(norms, id_col).select(id_col, "bucket", (F.col("s") / F.col("norm")).alias("value"))


def densified(entries: DataFrame, id_col: str, dims: int = 512) -> DataFrame:
    """(id, vec array<double>) from sparse entries."""
    filled = entries.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    return filled.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def search_text(*columns: str) -> Column:
    """Lower-cased text of several columns for token search."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def contains_all_tokens(text: Column, query: Column) -> Column:
    """True where every whitespace-separated token of the query stands in the text; an empty query always does."""
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), lambda w: F.contains(text, w))


#: What stands for "unknown" in a profile, and the words of card texts.
UNKNOWN = "неизвестно"
UNKNOWN_STEM = "неизв"
WORDS = {"fizzy": "игристое", "region": "Регион: ", "grapes": " Сорт: ", "aromas": "Ароматы: ", "pairing": "Подходит к: ", "dishes": "К блюдам: ", "serve": "Подача: "}
FACTS = (("sweetness", ""), ("body", "тело "), ("acidity", "кислотность "), ("tannins", "танины "))


def _known(value: Column) -> Column:
    return F.when((value != "") & (value != UNKNOWN), value)


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", "), F.lit(".")))


def card_text(profile: str = "profile") -> Column:
    """Retrieval text of a card (name, winery, category, region, grapes, description) and its profile; missing parts are left out."""
    p = lambda c: F.col(f"{profile}.{c}")
    style = F.concat_ws(", ", "category", _known(p("sweetness")), F.when(p("sparkling"), WORDS["fizzy"]))
    return F.concat_ws(
        " ",
        F.format_string("%s. %s.", "name", "winery"),
        F.concat(style, F.lit(".")),
        F.concat(F.lit(WORDS["region"]), "region", F.lit("."), F.lit(WORDS["grapes"]), "grapes", F.lit(".")),
        F.when(F.col("description") != "", F.col("description")),
        _listed(WORDS["aromas"], p("aromas")),
        _listed(WORDS["pairing"], p("pairing")),
    )


def shortlist_line(position: Column, profile: str = "profile") -> Column:
    """One numbered line of a shortlist: only facts from the card and its profile."""
    p = lambda c: F.col(f"{profile}.{c}")
    facts = F.concat_ws("; ", "category", *(F.concat(F.lit(label), _known(p(c))) for c, label in FACTS), F.when(p("sparkling"), WORDS["fizzy"]))
    return F.concat_ws(
        " ",
        F.concat(F.format_string("[%d] %s — %s, %s.", position.cast("int"), "name", "winery", "region"), F.lit(WORDS["grapes"]), "grapes", F.lit(". "), facts, F.lit(".")),
        _listed(WORDS["aromas"], p("aromas")),
        _listed(WORDS["dishes"], p("pairing")),
        F.when((p("serve_temp") != "") & ~F.contains(p("serve_temp"), F.lit(UNKNOWN_STEM)), F.concat(F.lit(WORDS["serve"]), p("serve_temp"), F.lit("."))),
    )


def quoted(value: Column) -> Column:
    """Percent-encoding that leaves slashes and encodes spaces as %20."""
    out = F.url_encode(value)
    for was, becomes in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(was), F.lit(becomes))
    return out
