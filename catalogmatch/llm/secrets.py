"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by their patterns, leftmost and non-overlapping per kind: ``assign`` (a key word, a separator and a
value of eight characters or more), ``access`` (an access key id) and ``hex`` (32 hexadecimal digits or more). Positions
come from the gaps between matches: a running sum of the lengths of gaps and matches. Offsets count code points.

Weak parts are access identifiers (``part_id``), secrets too weak to stand alone (``part_secret``) and endpoints
(``part_endpoint``). A scope is a stretch without an empty line; within it parts link over at most ``reach`` characters,
from the end of one to the start of the other. The interval join runs over bins of that width: a part is in every bin that it
covers, and each bin keeps the first start and the last end, so that a part looks at its own bins and their neighbours
instead of at every other part. Weak secrets are reported only beside an
identifier or an endpoint, identifiers and endpoints only beside a weak secret or a base secret.

Results in special cases: null and empty texts have no spans; repeated rows give equal results (they are scanned once);
an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.llm.common import sized, table, written

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Patterns of the weak parts; an identifier's and a secret's value is group 2.
PART_ID = r"""(?i)\b(access_?key_?id|access_?id|client_?id|account_?id|user_?name|user_?id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})"""
PART_SECRET = r"""(?i)\b(pwd|pass_?phrase|passcode|credential|client_?key|private_?key|auth_?key|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
PART_ENDPOINT = r"""(?i)\b(https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|ftp)://[^\x20\x09-\x0D"'<>]+"""
KINDS = ["assign", "access", "hex", "part_id", "part_secret", "part_endpoint"]
#: Cheap tests that every text with a match of the kind passes.
_HINTS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "part_id": ["access_id", "accessid", "key_id", "keyid", "client_id", "clientid", "account_id", "accountid", "user_name", "username", "user_id", "userid", "login"],
    "part_secret": ["pwd", "pass_phrase", "passphrase", "passcode", "credential", "client_key", "clientkey", "private_key", "privatekey", "auth_key", "authkey", "signature"],
}


def _may_match(text: Column) -> Column:
    """True for every text with a base match, or with a weak secret beside an identifier or endpoint."""
    low = F.lower(text)
    has = {kind: F.greatest(*(low.contains(x) for x in words)) for kind, words in _HINTS.items()}
    base = has["assign"] | text.contains("AKIA") | text.rlike(r"[0-9a-f]{32}")
    return base | (has["part_secret"] & (has["part_id"] | low.contains("://")))


def _matches(texts: DataFrame, kind: str, pattern: str, value_group: int) -> DataFrame:
    """(key, kind, i, gap, size, v): per match of a pattern its number, the length of the gap before it, its own and its value's."""
    gaps = F.split("text", pattern, -1)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group)) if value_group else found
    lengths = lambda x: F.transform(x, F.length)
    zipped = F.arrays_zip(lengths(F.slice(gaps, 1, F.size(found))).alias("gap"), lengths(found).alias("size"), lengths(values).alias("v"))
    rows = texts.where(F.col("text").rlike(pattern)).select("key", F.posexplode(zipped).alias("i", "x"))
    return rows.select("key", F.lit(kind).alias("kind"), "i", "x.gap", "x.size", "x.v")


def _scopes(texts: DataFrame) -> DataFrame:
    """(key, scope_start) of every scope: stretches between empty lines."""
    parts = F.split("text", r"\n[\x20\t\r]*\n", -1)
    breaks = F.regexp_extract_all("text", F.lit(r"\n[\x20\t\r]*\n"), F.lit(0))
    lengths = F.transform(F.arrays_zip(parts.alias("p"), breaks.alias("b")), lambda x: (F.length(x["p"]) + F.coalesce(F.length(x["b"]), F.lit(0))).cast("long"))
    rows = texts.select("key", F.posexplode(lengths).alias("scope", "size"))
    return rows.select("key", "scope", (F.sum("size").over(Window.partitionBy("key").orderBy("scope")) - F.col("size")).alias("scope_start"))


def _linked(spans: DataFrame, texts: DataFrame, reach: int) -> DataFrame:
    """The weak parts of ``spans`` that stand within reach of a complementary part of their scope."""
    weak_keys = spans.where(F.col("kind").startswith("part_")).select("key").distinct()
    inside = spans.join(weak_keys, "key", "left_semi")
    marks = _scopes(texts.join(weak_keys, "key", "left_semi")).select("key", F.col("scope_start").alias("start"), "scope", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("end"))
    #: Each span belongs to the last scope that began at or before it.
    upto = Window.partitionBy("key").orderBy("start", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.unionByName(inside.withColumn("scope", F.lit(None).cast("int"))).withColumn("scope", F.last("scope", True).over(upto)).where("kind IS NOT NULL")
    placed = placed.withColumn("role", F.when(F.col("kind").isin("assign", "hex", "part_secret"), "secret").when(F.col("kind").isin("access", "part_id"), "id").otherwise("endpoint"))
    placed = placed.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach))))
    edges = placed.groupBy("key", "scope", "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    seen = edges.select("key", "scope", "role", "first", "last", F.explode(F.array(*(F.struct((F.col("bin") + d).alias("bin"), F.lit(d).alias("from")) for d in (-1, 0, 1)))).alias("x"))
    seen = seen.select("key", "scope", F.col("role").alias("other"), "first", "last", "x.bin", "x.from")
    weak = placed.where(F.col("kind").startswith("part_"))
    #: From the bin after, the first start counts; from the bin before, the last end; in the own bin any.
    near = (F.col("from") == 0) | ((F.col("from") == -1) & (F.col("first") - F.col("end") <= reach)) | ((F.col("from") == 1) & (F.col("start") - F.col("last") <= reach))
    fits = F.when(F.col("role") == "secret", F.col("other") != "secret").otherwise(F.col("other") == "secret")
    return weak.join(seen, ["key", "scope", "bin"]).where(near & fits).select("key", "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, key) for every row; spans (key, kind, start, end).

    Texts in which nothing can match get keys (n = -1) that no span has, spread by id and text so that they meet in no one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.struct(F.xxhash64(F.col(id_col), text).alias("h"), F.lit(0).cast("long").alias("c"), F.lit(-1).alias("n"))
    key = F.when(_may_match(text), F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"), F.length(text).alias("n"))).otherwise(none)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text.alias("text"))
    texts = written(rows.where("key.n >= 0").groupBy("key").agg(F.min("text").alias("text")), "secret-texts")
    patterns = {
        "assign": (ASSIGN, 2),
        "access": (ACCESS, 0),
        "hex": (r"[0-9a-f]{32,}", 0),  # the runs of HEX are maximal, so these are its long ones
        "part_id": (PART_ID, 2),
        "part_secret": (PART_SECRET, 2),
        "part_endpoint": (PART_ENDPOINT, 0),
    }
    found = functools.reduce(DataFrame.unionByName, (_matches(texts, kind, *how) for kind, how in patterns.items()))
    before = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(before))
    least = F.when(F.col("kind") == "assign", 8).when(F.col("kind") == "access", 16).otherwise(0)
    spans = written(ends.where(F.col("v") >= least).select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end"), "secret-matches")
    weak = F.col("kind").startswith("part_")
    return rows.select("doc_id", "key"), spans.where(~weak).unionByName(_linked(spans, texts, reach))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    rows, spans = secret_spans(docs, id_col, text_col, reach)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", order.alias("o"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, one))), lambda x: x["s"]), ",")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    per_text = spans.groupBy("key").agg(
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), listed(order <= 3).alias("base"), listed(F.lit(True)).alias("spans")
    )
    per_text = sized(written(per_text, "secret-per-text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(per_text, "key", "left").select(
        "doc_id", *map(zero, ("n_assign", "n_access", "n_hex")), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every document."""
    return secret_report(table(spark, sf_dir, "documents"))
