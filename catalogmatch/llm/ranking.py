"""Ranked lexical search by presence masks.

One pass over the texts keeps, for blocks of documents, the places and counts of the terms that the items hold; no other term
is kept and nothing is shuffled. These blocks are written once and give the corpus statistics (document frequencies, number and
length of all documents). A second pass works on blocks alone. Every term of a block has a bitmap of its documents. An item's
documents are grouped by the mask of the item's terms that they hold: the bitmap of all documents is split by one term's
bitmap after another, the parts waiting in a queue ordered by the highest score that their mask allows (a term counts at most what
its best document in the block gets). Masks are scored in that order until no waiting one can reach the item's last place; so the
ranking is exact, and most masks are never told apart. Parts of few documents are scored as they are. On large inputs a few
blocks are searched first, and what their last places score is a floor for all others.

Items are taken in bounded groups, whose terms and weights are broadcast; each group is a pass of its own.

Results in special cases: a null or empty text has no terms and is not counted in N; an item without terms, or whose
terms no document holds, has no rows; rows that repeat an id are ranked as documents of their own, rows without an id after all others
of the same score; repeated item rows count once, rows of one item_id with different texts are ranked separately; an empty table
of documents or items gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.llm.common import map_batches, table, written

#: Bytes of terms: digits, letters (A-Z in lower case) and all that is not ASCII; others part them.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PART = 1 << 20
#: A block is closed at so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 21
#: Parts of so many documents are scored without being told apart by mask.
FEW = 192
BLOCK = "ids array<{id}>, lengths array<long>, terms array<int>, sizes array<int>, places array<int>, counts array<int>"


def terms_of(text: str | None):
    """The terms of a text, in parts of about a megabyte."""
    data = (text or "").encode().translate(_TERM)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + _PART)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def blocks(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: their ids and lengths, and for each term number of ``vocabulary`` (a broadcast dict) places and counts."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def closed(ids, lengths, terms, counts, held):
        number = np.fromiter(terms, np.int32, len(terms))
        place = np.repeat(np.arange(len(ids), dtype=np.int32), held)
        order = np.argsort(number, kind="stable")
        known, sizes = np.unique(number, return_counts=True)
        rows = [ids, lengths, known, sizes.astype(np.int32), place[order], np.fromiter(counts, np.int32, len(counts))[order]]
        kinds = [None, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = ["ids", "lengths", "terms", "sizes", "places", "counts"]
        arrays = [x if k is None else pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays], names)

    def run(batches):
        number_of = vocabulary.value.get
        kind, ids, lengths, terms, counts, held = None, [], [], [], [], []
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = Counter(), 0
                for part in terms_of(text.as_py()):
                    n += len(part)
                    found.update(map(number_of, part))
                if not n:
                    continue
                found.pop(None, None)
                ids.append(doc_id)
                lengths.append(n)
                terms.extend(found.keys())
                counts.extend(found.values())
                held.append(len(found))
                if len(ids) >= BLOCK_DOCS or len(terms) >= BLOCK_POSTINGS:
                    yield closed(pa.array(ids, kind), lengths, terms, counts, held)
                    ids, lengths, terms, counts, held = [], [], [], [], []
        if ids:
            yield closed(pa.array(ids, kind), lengths, terms, counts, held)

    return map_batches(docs.select(id_col, text_col), run, BLOCK.format(id=id_type))


class _Block:
    """A block with the share of every posting in a score, for N and L documents and terms of the corpus."""

    def __init__(self, ids: list, lengths, terms, sizes, places, tf, n_docs: int, n_terms: int):
        self.ids = ids
        m = 75 + 25 * lengths * n_docs // n_terms
        shares = 1_000_000_000 * tf // (1000 * tf + 12 * m[places])
        cuts = np.cumsum(sizes)[:-1]
        self.places = dict(zip(terms.tolist(), np.split(places, cuts), strict=True)) if len(terms) else {}
        self.shares = dict(zip(terms.tolist(), np.split(shares, cuts), strict=True)) if len(terms) else {}
        self.most = {t: int(x.max()) for t, x in self.shares.items()}
        self.bitmaps: dict[int, int] = {}
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k]))
        self.turn = np.empty(len(order), np.int64)
        self.turn[order] = np.arange(len(order))

    def bitmap(self, term: int) -> int:
        """The documents that hold a term, a bit each."""
        if term not in self.bitmaps:
            bits = np.zeros(len(self.ids), np.uint8)
            bits[self.places[term]] = 1
            self.bitmaps[term] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return self.bitmaps[term]

    def members(self, bitmap: int) -> np.ndarray:
        raw = np.frombuffer(bitmap.to_bytes(-(-len(self.ids) // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))

    def scores(self, docs: np.ndarray, held: list[tuple[int, int]], open_: list[tuple[int, int]]) -> np.ndarray:
        """Of documents that hold all terms in ``held`` and perhaps some in ``open_`` (term, weight)."""
        out = np.zeros(len(docs), np.int64)
        for term, weight in held:
            out += weight * self.shares[term][np.searchsorted(self.places[term], docs)]
        for term, weight in open_:
            places = self.places[term]
            at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
            out += np.where(places[at] == docs, weight * self.shares[term][at], 0)
        return out

    def best(self, item: list[tuple[int, int]], k: int, least: int) -> list[tuple[int, int]]:
        """(place, score) of the ``k`` best documents that score ``least`` or more; ``item`` lists terms and positive weights."""
        item = sorted(((t, w) for t, w in item if t in self.places), key=lambda x: -x[1] * self.most[x[0]])
        rest = [*np.cumsum([w * self.most[t] for t, w in reversed(item)])[::-1].tolist(), 0]
        turns, docs, scores = count(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        queue = [(-rest[0], next(turns), 0, (1 << len(self.ids)) - 1, [])]
        while queue:
            most, _, depth, part, held = heapq.heappop(queue)
            if -most < least:
                break
            while depth < len(item) and part.bit_count() > FEW:  # the part that holds the next term may score as much as before
                holding = part & self.bitmap(item[depth][0])
                if part != holding:
                    lower = -most - rest[depth] + rest[depth + 1]
                    if lower >= least:
                        heapq.heappush(queue, (-lower, next(turns), depth + 1, part ^ holding, held))
                if not holding:
                    break
                part, held, depth = holding, [*held, item[depth]], depth + 1
            else:
                found = self.members(part)
                score = self.scores(found, held, item[depth:])
                docs, scores = np.append(docs, found[score >= least]), np.append(scores, score[score >= least])
                if len(docs) > k:
                    first = np.lexsort((self.turn[docs], -scores))[:k]
                    docs, scores = docs[first], scores[first]
                if len(docs) == k:
                    least = max(least, int(scores.min()))
        return list(zip(docs.tolist(), scores.tolist(), strict=True))


def _searched(index: DataFrame, sent, id_type: str, k: int) -> DataFrame:
    """(item, doc_id, score) of each block's best documents."""
    import pyarrow as pa

    def run(batches):
        items, n_docs, n_terms, floors = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                arrays = [x[row].values.to_numpy().astype(np.int64) for x in batch.columns[1:]]
                block = _Block(batch.column(0)[row].as_py(), *arrays, n_docs, n_terms)
                numbers, places, scores = [], [], []
                for number, item in enumerate(items):
                    for place, score in block.best(item, k, floors.get(number, 1)):
                        numbers.append(number)
                        places.append(place)
                        scores.append(score)
                ids = batch.column(0)[row].values.take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), ids, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item int, doc_id {id_type}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", items_a_pass: int = 20_000, bytes_a_pass: int = 32 << 20, first_blocks: int = 4) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``k`` best documents.

    ``items_a_pass`` and ``bytes_a_pass`` bound what is broadcast, not the items: beyond them the items are dealt by hash into more
    passes. About ``first_blocks``, chosen by hash, are searched ahead where there are eight times as many.
    """
    asked = written(items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct(), "items")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // items_a_pass), -(-size // bytes_a_pass))
    dealt = [asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) for p in range(passes)]
    out = _search(docs, dealt[0], k, id_col, text_col, first_blocks)
    for group in dealt[1:]:
        out = out.unionByName(_search(docs, group, k, id_col, text_col, first_blocks))
    return out


def _search(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, first_blocks: int) -> DataFrame:
    """``ranked_search`` of a bounded group of items."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = asked.collect()  # bounded by the caller
    counted = [Counter(t for part in terms_of(r.text) for t in part) for r in rows]
    vocabulary = {t: number for number, t in enumerate(sorted(set().union(*counted)))}
    index = written(blocks(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "blocks")
    n_docs, n_terms, n_blocks = index.agg(
        F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)), F.count("*")
    ).first()
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    df = {r.terms: r.df for r in held.collect()}  # a row for each term of the items at most
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    numbers = [[(vocabulary[t], tf) for t, tf in c.items()] for c in counted]
    weighted = [[(t, tf * weights[t]) for t, tf in item if weights.get(t, 0) > 0] for item in numbers]

    def sent(floors):
        return spark.sparkContext.broadcast((weighted, n_docs, max(n_terms, 1), floors))

    floors = {}
    if n_blocks >= 8 * first_blocks:
        ahead = index.where(F.pmod(F.xxhash64("lengths"), F.lit(n_blocks // first_blocks)) == 0)
        last = _ranked(_searched(ahead, sent({}), id_type, k), k).where(F.col("rank") == k)
        floors = {r.item: r.score for r in last.select("item", "score").collect()}  # a row for each item at most
    named = spark.createDataFrame([(number, r.item_id) for number, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return _ranked(_searched(index, sent(floors), id_type, k), k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS_SQL} AS terms FROM documents),
lengths AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
tf AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), corpus
),
items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS_SQL} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc), corpus
  GROUP BY item, doc
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
