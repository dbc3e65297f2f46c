"""A stored index for token search: written once, appended to, and read in file order so that a page stops early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.operators.catalog import by_category, held_tokens, holding_cards, matching_texts, search_cards, wanted_words, word_sets, words_in
from catalogmatch.sources.sinks import kept_table, work_dir


def _stretch(segment: Column) -> Column:
    """The folder of a segment: the first one alone, and then twice as many each time, as a page reads them."""
    return F.when(segment <= 0, 0).otherwise(F.length(F.bin(segment))).cast("int")


class SearchIndex:
    """At ``path``: ``cards``, with their ``segment`` (``segment_rows`` positions), and ``held`` (token, search_text), the words of the different
    texts, both in folders of ``stretch`` (segments 0, 1, 2 to 3, 4 to 7 and so on, so that folders are few), and ``tokens`` (token, n), the number
    of texts that hold a token, a row for each append.

    Positions are file order; appended cards have positions and slugs of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.cards, self.held, tokens = (spark.read.parquet(f"{self.path}/{name}") for name in ("cards", "held", "tokens"))
        self.tokens = tokens.groupBy("token").agg(F.sum("n").alias("n"))

    @staticmethod
    def write(catalog: DataFrame, path: str | None = None, segment_rows: int = 1_000_000) -> SearchIndex:
        """Appends ``catalog`` to the index at ``path`` (a new folder of the shared one, if none is named) and opens it."""
        path = (path or work_dir(catalog.sparkSession, "search-index")).rstrip("/")
        segment = F.floor(F.col("pos") / segment_rows).cast("long")
        cards = search_cards(catalog).withColumn("segment", segment).withColumn("stretch", _stretch(F.col("segment")))
        cards.repartition("stretch", F.pmod(F.xxhash64("slug"), F.lit(32))).sortWithinPartitions("stretch", "segment", "pos").write.mode("append").partitionBy("stretch").parquet(f"{path}/cards")
        held = held_tokens(cards, "stretch")
        held.repartition("stretch", F.pmod(F.xxhash64("token", "search_text"), F.lit(32))).sortWithinPartitions("stretch", "token").write.mode("append").partitionBy("stretch").parquet(f"{path}/held")
        held_tokens(cards).groupBy("token").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{path}/tokens")
        return SearchIndex(catalog.sparkSession, path)

    def append(self, catalog: DataFrame, segment_rows: int = 1_000_000) -> SearchIndex:
        return SearchIndex.write(catalog, self.path, segment_rows)

    def _known(self, wanted: DataFrame) -> DataFrame:
        return kept_table(words_in(self.tokens, wanted.select(F.explode("words").alias("word")).distinct()), "search-words")

    def _hits(self, known: DataFrame, wanted: DataFrame, segments: list[int] | None = None) -> DataFrame:
        """The hits of queries with words in all segments or in some that follow each other."""
        cards, held = self.cards, self.held
        if segments is not None:
            first, last = (_stretch(F.lit(x)) for x in (segments[0], segments[-1]))
            within = F.col("stretch").between(first, last)
            cards, held = cards.where(within & F.col("segment").between(segments[0], segments[-1])), held.where(within)
        return holding_cards(cards.drop("segment", "stretch"), matching_texts(held, known, kept_table(word_sets(wanted, known), "search-sets")), wanted)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, slug, pos): ``catalog.token_search`` without reading the catalog's texts for their words."""
        wanted = wanted_words(queries)
        empty = by_category(self.cards).hint("merge").join(wanted.where(F.size("words") == 0), "wanted").select("query_id", "slug", "pos")
        return self._hits(self._known(wanted), wanted.where(F.size("words") > 0)).unionByName(empty)

    def page(self, queries: DataFrame, offset: int = 0, limit: int = 24) -> DataFrame:
        """(query_id, n, slug, pos): the page of every query, without totals.

        Segments are read in file order, one, one more, then twice as many each time, and only for queries that lack hits; a query is
        done with its first ``offset + limit``. Empty queries are answered once per category.
        """
        need = offset + limit
        first = lambda rows, key: rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos", "slug"))).where(F.col("n") <= need)
        wanted = kept_table(wanted_words(queries), "page-queries")
        heads = first(by_category(self.cards.select("slug", "pos", "card_category")), "wanted").select("wanted", "slug", "pos", "n")
        out = heads.join(wanted.where(F.size("words") == 0), "wanted").select("query_id", "slug", "pos", "n")
        known = self._known(wanted)
        open_ = wanted.where(F.size("words") > 0)
        segments = [r.segment for r in self.cards.select("segment").distinct().orderBy("segment").collect()]  # a number for each segment
        found, at, width = None, 0, 1
        while at < len(segments) and not open_.isEmpty():
            hits = self._hits(known, open_, segments[at : at + width])
            found = kept_table(first(hits if found is None else found.drop("n").unionByName(hits), "query_id"), "page-hits")
            at, width = at + width, max(1, at + width)
            if at < len(segments):
                done = found.where(F.col("n") == need).select("query_id").distinct()
                open_ = kept_table(open_.join(done, "query_id", "left_anti"), "page-open")
        out = out if found is None else out.unionByName(found.select("query_id", "slug", "pos", "n"))
        return out.where(F.col("n") > offset).withColumn("n", F.col("n") - offset).select("query_id", "n", "slug", "pos")
