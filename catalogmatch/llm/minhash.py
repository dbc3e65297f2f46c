"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A text's set holds its distinct five-word shingles. Of 256 minima per set, bands of five give the keys under which
candidates meet, and the two low bits of each minimum are packed into eight 64-bit words. Texts with equal sets fall
together first. Then links are found in two steps, neither of which lists the pairs of a band:

* every member of a band is held against the band's smallest id; the packed words give an estimate of the similarity,
  corrected for chance agreement of the retained bits, and pairs well below the threshold go;
* in bands whose members still lie in different components, the members outside the largest component are held against
  all others, in blocks of bounded size inside tasks, by bit counts and then on the full sets; only links come out.

A pair at the threshold misses all bands with a probability of 2e-6, and falls to the estimate's margin with less.

Results in special cases: null texts count as empty; texts without words have no shingles and link with nothing; rows
without an id stay (kept, no component); rows that share an id are one node; equal rows give equal results; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import batch_shingles, grouped_join, hub_join, map_batches, mixed, salted_join, sized, table, written
from catalogmatch.llm.graph import components

HASHES, BAND, BANDS, BITS = 256, 5, 48, 2
#: How far an estimate may lie below the threshold: 4.5 standard errors at a similarity of 0.75.
MARGIN = 0.16
BLOCK = 1024
_ODD = np.uint64(0x5555555555555555)


def _family(seed: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(seed)
    return made.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), made.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(numbers: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minima of the hash functions over a set of 64-bit numbers."""
    short = (numbers >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(short), 512):
        np.minimum(out, (family[0][:, None] * short[None, start : start + 512] + family[1][:, None]).min(axis=1), out=out)
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The ``BITS`` low bits of each minimum, 32 to a 64-bit word."""
    low = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed words, corrected for retained bits that agree by chance."""
    differ = a ^ b
    share = 1 - np.bitwise_count((differ | (differ >> np.uint64(1))) & _ODD).sum(axis=-1) / HASHES
    return (share - 2.0**-BITS) / (1 - 2.0**-BITS)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, words) of every row; s1 and s2 are equal for equal sets only; null bands: no set."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    family = _family(seed)
    step = np.arange(BANDS, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            sizes, s1, s2, bands, words = [], [], [], [], []
            for found in batch_shingles(texts):
                sizes.append(len(found))
                again = mixed(found + np.uint64(1))
                s1.append(int(found.sum(dtype=np.uint64).view(np.int64)) if len(found) else 0)
                s2.append(int(again.sum(dtype=np.uint64).view(np.int64)) if len(found) else 0)
                if not len(found):
                    bands.append(None)
                    words.append(None)
                    continue
                mins = minima(found, family)
                keys = step
                for column in mins[: BANDS * BAND].reshape(BANDS, BAND).T:
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(keys.view(np.int64))
                words.append(packed(mins).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, s1, s2)), pa.array(bands, longs), pa.array(words, longs)],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "words"],
            )

    schema = f"doc_id {id_type}, n_shingles long, s1 long, s2 long, bands array<long>, words array<long>"
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def _full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, elements): the full sets of the texts whose id is among ``nodes``."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [x.view(np.int64) for x in batch_shingles([x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "elements"])

    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(sized(nodes), "node", "left_semi")
    return map_batches(texts, run, f"node {id_type}, elements array<long>").where("size(elements) > 0")


def _complete_groups(batches, keys: list[str]):
    """Tables of rows with equal ``keys``, from batches sorted by them."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        turns = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *turns.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _longs(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)


def _near(block, threshold: float):
    """For each query of a block, the places of the targets of other components that the estimate lets pass."""
    words, comp = _longs(block["words"], HASHES * BITS // 64), block["comp"].to_numpy()
    targets = np.flatnonzero(block["target"].to_numpy(zero_copy_only=False))
    for q in np.flatnonzero(block["query"].to_numpy(zero_copy_only=False)):
        others = targets[comp[targets] != comp[q]]
        near = others[similarity(words[others], words[q]) >= threshold - MARGIN]
        if len(near):
            yield int(q), near


def _taking_part(threshold: float):
    """Of sorted blocks, the rows of nodes that some pair needs."""

    def run(batches):
        for block in _complete_groups(batches, ["key", "tb", "qb"]):
            used = np.zeros(len(block), bool)
            for q, near in _near(block, threshold):
                used[q] = True
                used[near] = True
            if used.any():
                yield from block.filter(used).combine_chunks().to_batches()

    return run


def _block_links(threshold: float):
    """Of sorted blocks with full sets, the links."""
    import pyarrow as pa

    def run(batches):
        for block in _complete_groups(batches, ["key", "tb", "qb"]):
            sets = [x.values.to_numpy().view(np.uint64) for x in block["elements"]]  # sorted as unsigned numbers
            nodes, found = block["node"], []
            for q, near in _near(block, threshold):
                n = len(sets[q])
                close = [t for t in near.tolist() if 100 * min(n, len(sets[t])) >= 100 * threshold * max(n, len(sets[t])) - 1e-6]
                if not close:
                    continue
                owner = np.repeat(np.arange(len(close)), [len(sets[t]) for t in close])
                flat = np.concatenate([sets[t] for t in close])
                at = np.minimum(np.searchsorted(sets[q], flat), n - 1)
                common = np.bincount(owner[sets[q][at] == flat], minlength=len(close))
                for t, both in zip(close, common.tolist(), strict=True):
                    if 100 * both >= 100 * threshold * (n + len(sets[t]) - both) - 1e-6:
                        found.append((q, t))
            if found:
                a, b = (pa.array(x) for x in zip(*found, strict=True))
                yield from pa.table({"a": nodes.take(a), "b": nodes.take(b)}).combine_chunks().to_batches()

    return run


def near_links(docs: DataFrame, heads: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links that connect all that is connected among ``heads`` (node, bands, words), whose sets differ."""
    spark = docs.sparkSession
    node_type = heads.schema["node"].dataType.simpleString()
    bands = heads.select("node", F.explode("bands").alias("key"))
    first = bands.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first")
    members = written(bands.join(written(first, "near-bands"), "key").select("key", "node", "first").distinct(), "near-members")
    nodes = written(members.select("node").distinct(), "near-nodes")
    sets = written(_full_sets(docs, nodes, id_col, text_col), "near-sets")
    words = written(heads.select("node", "words").join(sized(nodes), "node", "left_semi"), "near-words")

    pairs = written(members.where("node <> first").select("first", "node").distinct(), "near-pairs")
    pairs = hub_join(pairs, words.select(F.col("node").alias("first"), F.col("words").alias("first_words")), "first").join(words, "node")
    differ = F.transform(F.arrays_zip("words", "first_words"), lambda x: x["words"].bitwiseXOR(x["first_words"]))
    unlike = F.aggregate(
        differ, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(int(_ODD)))).cast("int")
    )
    estimate = ((1 - unlike / HASHES) - 2.0**-BITS) / (1 - 2.0**-BITS)
    pairs = written(pairs.where(estimate >= threshold - MARGIN).select("first", "node"), "near-passing")
    pairs = salted_join(pairs, sets.select(F.col("node").alias("first"), F.col("elements").alias("first_elements")), "first", "node").join(sets, "node")
    common = F.size(F.array_intersect("elements", "first_elements"))
    confirmed = 100 * common >= F.lit(100 * threshold) * (F.size("elements") + F.size("first_elements") - common) - 1e-6
    stars = written(pairs.where(confirmed).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")

    joined = components(stars).withColumnRenamed("component", "comp")
    placed = written(members.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "near-placed")
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    open_ = written(open_.select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("tbs"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("qbs")), "near-open")
    spread = placed.join(open_, "key").withColumn("query", F.col("comp") != F.col("main"))
    own_t, own_q = F.pmod(F.xxhash64("node"), "tbs").cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), "qbs").cast("int")
    as_target = F.transform(F.sequence(F.lit(0), F.col("qbs") - 1), lambda q: F.struct(own_t.alias("tb"), q.alias("qb"), F.lit(True).alias("target"), (F.col("query") & (q == own_q)).alias("query")))
    as_query = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("tbs") - 1), lambda t: F.col("query") & (t != own_t)),
        lambda t: F.struct(t.alias("tb"), own_q.alias("qb"), F.lit(False).alias("target"), F.lit(True).alias("query")),
    )
    rows = spread.select("key", "node", "comp", F.inline(F.concat(as_target, as_query))).join(words, "node")
    rows = rows.select("key", "tb", "qb", "node", "comp", "target", "query", "words")
    dealt = lambda x: x.repartition("key", "tb", "qb").sortWithinPartitions("key", "tb", "qb")
    need = written(map_batches(dealt(rows), _taking_part(threshold), rows.schema), "near-taking-part")
    crossing = map_batches(dealt(need.join(sets, "node")), _block_links(threshold), f"a {node_type}, b {node_type}")
    return stars.unionByName(crossing)


def near_groups(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = written(signatures(docs, id_col, text_col), "near-signatures")
    takes = "bands IS NOT NULL AND doc_id IS NOT NULL"
    keys = ["s1", "s2", "n_shingles"]
    classes = rows.where(takes).groupBy(*keys).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    classes = written(classes, "near-classes")
    placed = grouped_join(rows.where(takes).select("doc_id", *keys), classes, keys, "n").select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("head"))
    #: Rows of no set or id take part in no class.
    alone = rows.where(f"NOT ({takes})").select("doc_id", "n_shingles", F.col("doc_id").alias("head"))
    headed = written(placed.unionByName(alone), "near-heads")
    heads = rows.where(takes).join(sized(classes.select(*keys, "head")), keys, "left").where("head IS NULL OR head = doc_id").select(F.col("doc_id").alias("node"), "bands", "words")
    found = written(components(near_links(docs, heads, threshold, id_col, text_col)), "near-components").withColumnRenamed("node", "head")
    component = F.coalesce("component", "head")
    return hub_join(headed, found, "head", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one per component stays, with all their columns."""
    gone = written(near_groups(docs, threshold, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "near-gone")
    return docs.join(sized(gone), id_col, "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and the smallest id it is linked to."""
    return near_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), items AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS common
  FROM items a JOIN items b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM inter WHERE 100 * common >= 75 * (na + nb - common)
), sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT x, x FROM sym UNION SELECT reach.doc_id, sym.y FROM reach JOIN sym ON reach.r = sym.x
), comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, s.doc_id = coalesce(c.c, s.doc_id) AS kept
FROM sets s LEFT JOIN comp c USING (doc_id)
"""
