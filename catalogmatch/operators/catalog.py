"""Catalog search, paging, facets, picks, lookups and membership reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.functions.text import contains_all_tokens, search_text
from catalogmatch.sources.sinks import kept_table

#: Letters of the pieces that the search index holds.
PIECE = 3
#: The preset searches of the picks.
PRESETS = ("резерв каберне", "рислинг", "пино нуар", "брют", "шардоне", "саперави")


def searchable(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("search_text", search_text("name", "winery", "region", "grapes"))


def _pieces(text: str, length: Column | int = PIECE) -> Column:
    """The distinct pieces of ``length`` letters of a column of texts; none of a shorter one."""
    n = F.lit(length) if isinstance(length, int) else length
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.col(text).substr(i, n)))


def _split(text) -> Column:
    """The distinct words of a text; no word holds white space."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def wanted_words(queries: DataFrame) -> DataFrame:
    """(query_id, wanted, words) of queries (query_id, query, category): distinct lower-case words."""
    return queries.select("query_id", F.coalesce("category", F.lit("")).alias("wanted"), _split(F.lower(F.coalesce("query", F.lit("")))).alias("words"))


def search_cards(catalog: DataFrame) -> DataFrame:
    """(slug, pos, card_category, search_text) of a catalog."""
    return searchable(catalog).select("slug", "pos", F.col("category").alias("card_category"), "search_text")


def held_tokens(cards: DataFrame, *more: str) -> DataFrame:
    """(token, search_text, more): the words of each different text of ``cards``."""
    return cards.select("search_text", *more).distinct().select("search_text", *more, F.explode(_split("search_text")).alias("token"))


def words_in(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(word, token, n): the tokens (token, n) that contain a word; looked up by the piece of the word that fewest tokens hold."""
    parts = tokens.select("token", "n", F.explode(F.flatten(F.array(*(_pieces("token", n) for n in range(1, PIECE + 1))))).alias("piece"))
    often = parts.groupBy("piece").agg(F.count("*").alias("often"))
    own = words.select("word", F.explode(_pieces("word", F.least(F.length("word"), F.lit(PIECE)))).alias("piece")).join(often, "piece", "left")
    rarest = own.groupBy("word").agg(F.min_by("piece", F.struct(F.coalesce("often", F.lit(0)), "piece")).alias("piece"))
    return parts.hint("merge").join(rarest, "piece").where(F.contains("token", "word")).select("word", "token", "n")


#: The words of a query by which it is looked up, the rarest first; the others are verified.
KEYS = ["first", "second", "third"]


def word_sets(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(words, first, second, third): the different word lists of queries with their rarest words, "" for none; lists with a word that no text holds are left out."""
    often = known.groupBy("word").agg(F.sum("n").alias("n"))
    rows = wanted.where(F.size("words") > 0).select("words").distinct().select("words", F.explode("words").alias("word")).hint("merge").join(often, "word")
    rows = rows.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("by_n")).where(F.size("by_n") == F.size("words"))
    return rows.select("words", *(F.coalesce(F.get("by_n", F.lit(k))["word"], F.lit("")).alias(key) for k, key in enumerate(KEYS)))


def matching_texts(held: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """(search_text, words): texts that hold all words of a list. Lists that share their rarest words are followed together, one word at a time."""
    near = known.join(sets.select(F.col("first").alias("word")).distinct().hint("merge"), "word").select("token", F.col("word").alias("first"))
    found = held.select("search_text", "token").hint("merge").join(near, "token").select("search_text", "first").distinct()
    for k, key in list(enumerate(KEYS))[1:]:
        found = found.hint("merge").join(sets.select(*KEYS[: k + 1]).distinct(), KEYS[:k]).where(F.contains("search_text", key))
    rest = F.forall("words", lambda w: F.contains("search_text", w))
    return found.hint("merge").join(sets, KEYS).where(rest).select("search_text", "words")


def holding_cards(cards: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, slug, pos): the cards of the texts found that have the category of their queries."""
    fits = (F.col("wanted") == "") | (F.col("card_category") == F.col("wanted"))
    asked = texts.hint("merge").join(wanted, "words").select("search_text", "query_id", "wanted")
    return cards.hint("merge").join(asked, "search_text").where(fits).select("query_id", "slug", "pos")


def by_category(cards: DataFrame) -> DataFrame:
    """Cards under the categories that find them: their own and "", which names none."""
    return cards.withColumn("wanted", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("card_category", F.lit(""))))))


def token_search(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, slug, pos): the cards that hold every token of the query and have its category, if it names one.

    ``queries`` (query_id, query, category). Different words of queries are looked up once among the different words of the catalog, by
    the rarest of their three-letter pieces (a word of one or two letters is its own piece). Different texts are then matched with different
    word lists by their three rarest words, one after the other, and verified; cards share what their texts found. Empty queries match
    every card of their category, by an equality join of their own. Sizes of files say little about repeated texts: no join here takes a side
    for small because its file is.
    """
    cards = search_cards(catalog)
    wanted = wanted_words(queries)
    held = held_tokens(cards)
    known = kept_table(words_in(held.groupBy("token").agg(F.count("*").alias("n")), wanted.select(F.explode("words").alias("word")).distinct()), "search-words")
    empty = by_category(cards).hint("merge").join(wanted.where(F.size("words") == 0), "wanted").select("query_id", "slug", "pos")
    return holding_cards(cards, matching_texts(held, known, kept_table(word_sets(wanted, known), "search-sets")), wanted).unionByName(empty)


def search_one(catalog: DataFrame, query: str = "", category: str = "", offset: int = 0, limit: int = 24) -> DataFrame:
    """One page of one search, in file order."""
    found = searchable(catalog).where(contains_all_tokens(F.col("search_text"), F.lit(query)))
    return (found.where(F.col("category") == category) if category else found).orderBy("pos").offset(offset).limit(limit).drop("search_text")


def paged(found: DataFrame, offset: int = 0, limit: int = 24, key: str = "query_id") -> DataFrame:
    """The page of every query, with its total before paging."""
    rows = found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    totals = found.groupBy(key).agg(F.count("*").alias("total"))
    return rows.where((F.col("n") > offset) & (F.col("n") <= offset + limit)).join(totals, key).withColumn("n", F.col("n") - offset)


def facets(catalog: DataFrame) -> DataFrame:
    """(total, categories, n_wineries): non-empty distinct categories in order, number of distinct non-empty producers."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return catalog.agg(
        F.count("*").alias("total"), F.array_sort(F.collect_set(filled("category"))).alias("categories"), F.count_distinct(filled("winery")).alias("n_wineries")
    )


def featured(catalog: DataFrame, presets: tuple[str, ...] = PRESETS, fallback: int = 6) -> DataFrame:
    """(place, slug): the first card of each preset search, repeats left out; the first cards of the catalog if nothing is found."""
    spark = catalog.sparkSession
    queries = spark.createDataFrame([(k, q, "") for k, q in enumerate(presets)], "query_id int, query string, category string")
    first = token_search(catalog, queries).groupBy("query_id").agg(F.min_by("slug", "pos").alias("slug"))
    picks = first.groupBy("slug").agg(F.min("query_id").alias("place")).select("place", "slug")
    plain = catalog.orderBy("pos").limit(fallback).select((F.row_number().over(Window.orderBy("pos")) - 1).alias("place"), "slug")  # ``fallback`` rows
    found = F.broadcast(picks.agg((F.count("*") > 0).alias("any_found")))  # one row
    return picks.unionByName(plain.join(found, ~F.col("any_found")).select("place", "slug"))


def lookup(keys: DataFrame, catalog: DataFrame, key: str = "slug") -> DataFrame:
    """``keys`` with the card's columns and ``found``; keys keep their rows and order columns."""
    cards = catalog.withColumn("found", F.lit(True))
    return keys.join(cards, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing_photos(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """Cards without an image."""
    return catalog.join(images.select("slug").distinct(), "slug", "left_anti")


def not_in_catalog(gallery: DataFrame, catalog: DataFrame) -> DataFrame:
    """Gallery slugs that the catalog lacks; empty if the gallery is covered."""
    return gallery.select("slug").distinct().join(catalog.select("slug"), "slug", "left_anti")


def one_sided(a: DataFrame, b: DataFrame, key: str = "slug") -> DataFrame:
    """(key, side): keys that only one of two galleries has."""
    left = a.select(key).distinct().withColumn("in_a", F.lit(True))
    both = left.join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    return both.where("in_a IS NULL OR in_b IS NULL").select(key, F.when(F.col("in_b").isNull(), "first").otherwise("second").alias("side"))


def key_difference(a: DataFrame, b: DataFrame, key: str = "slug") -> DataFrame:
    """Keys of ``a`` that ``b`` lacks, each once."""
    return a.select(key).distinct().exceptAll(b.select(key).distinct())


def in_splits(samples: DataFrame, *splits: str) -> DataFrame:
    """Samples of the named splits."""
    return samples.where(F.col("split").isin(*splits))
