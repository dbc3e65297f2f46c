"""Byte-level BPE encoding and decoding by merge replay over the corpus.

All texts are cut by the tokenizer's pattern and their distinct words counted. This word table is dealt to tasks by hash;
each task lays its words end to end as bytes, and an inverted index lists, for every mergeable pair of tokens, the
positions where it stands. Merges are replayed over all those words at once in rank order, each touching only the
positions its pair is listed at and their neighbours. This is done once for the corpus's most frequent words, whose ids are
sent to every worker. Words beyond these are rare; they are replayed in the same way where they are met, all new words of a
batch at once, because joining their ids back to every text would move more than the texts themselves. Texts are read
back from the ids by the token table.

Results in special cases: null and empty texts have no ids and decode to nothing; repeated rows give equal results; an
empty table gives an empty result; other columns are not read. Texts of any length are cut piece by piece and never
shortened.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import map_batches, table, written

NO_RANK = np.iinfo(np.int32).max
PIECES = 1 << 18
#: Letters of the Latin blocks. Texts of these, ASCII and plain white space are cut by Python's own regular expressions:
#: the default pattern with its classes written out, which is faster and cuts those texts alike.
LATIN = "A-Za-zÀ-ÖØ-öø-ʯ"
DEFAULT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^{LATIN}0-9\t\n\r ]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
NOT_PLAIN = rf"[^\t\n\r -~{LATIN[6:]}]"


class MergeReplay:
    """Encoder and decoder for one rank file.

    ``known`` are words and their ids, one after another, with the number of ids of each word; these are always
    remembered, and ``most_words`` bounds the words that are remembered besides.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_words: int = 150_000, known: tuple[list[str], np.ndarray, np.ndarray] | None = None):
        import regex

        self.cut = regex.compile(pattern)
        self.plain = re.compile(PLAIN) if pattern == DEFAULT_PATTERN else self.cut
        self.not_plain = re.compile(NOT_PLAIN)
        self.most_words = most_words
        self.known = known or ([], np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.width = size
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self._forget()

    def _forget(self) -> None:
        words, self.ids, self.lengths = self.known
        self.words: dict[str, int] = defaultdict(None, zip(words, range(len(words)), strict=True))
        self.words.default_factory = self.words.__len__
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after another; number of ids of each word)."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        if not n:
            return ids, sizes
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = n
        before = np.arange(-1, n - 1)
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NO_RANK, np.int32)
        inner = np.flatnonzero(after < n)
        rank[inner] = self._ranks_of(ids[inner], ids[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enlist(positions: np.ndarray) -> None:
            found = rank[positions]
            positions, found = positions[found < NO_RANK], found[found < NO_RANK]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, part in zip(found[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        enlist(inner)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            other = after[at]
            if len(at) > 1:
                chained = np.append(False, at[1:] == other[:-1])
                if chained.any():  # of overlapping pairs, every second one from the left
                    heads = np.maximum.accumulate(np.where(chained, -1, np.arange(len(at))))
                    take = (np.arange(len(at)) - heads) % 2 == 0
                    at, other = at[take], other[take]
            ids[at] = r
            alive[other] = False
            rank[other] = NO_RANK
            beyond = after[other]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            rank[at] = NO_RANK
            right = at[inside]
            rank[right] = self._ranks_of(ids[right], ids[beyond[inside]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self._ranks_of(ids[left], ids[after[left]])
            enlist(np.concatenate([right, left]))
        return ids[alive], np.add.reduceat(alive, (ends - sizes)[sizes > 0]).astype(np.int64)

    def _learn(self) -> None:
        """Ids of the words met since the last call."""
        new = [w.encode() for w in islice(self.words, len(self.lengths), None)]
        if new:
            ids, lengths = self.replay(new)
            self.ids = np.append(self.ids, ids)
            self.lengths = np.append(self.lengths, lengths)
            self.starts = np.cumsum(self.lengths) - self.lengths

    def cuts(self, text: str):
        """The words of a text, in blocks."""
        cut = self.cut if self.not_plain.search(text) else self.plain
        if len(text) < PIECES:
            yield cut.findall(text)
            return
        found = cut.finditer(text)
        while block := [m.group() for m in islice(found, PIECES)]:
            yield block

    def _pieces(self, text: str):
        """Numbers of the words of a text, in blocks."""
        for words in self.cuts(text):
            yield np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > len(self.known[0]) + self.most_words:
            self._forget()
        numbers = [np.concatenate([np.zeros(0, np.int32), *self._pieces(text)]) for text in texts]
        self._learn()
        return [self._spread(self.ids, self.starts[x], self.lengths[x]) for x in numbers]

    def decode(self, ids: np.ndarray) -> bytes:
        return self._spread(self.token_bytes, self.token_starts[ids], self.token_lengths[ids]).tobytes()

    @staticmethod
    def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slices of ``values`` that begin at ``starts``, one after another."""
        ends = np.cumsum(lengths)
        return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


_REPLAYS: dict[str, MergeReplay] = {}


def _replay(key: str, ranks: dict[bytes, int], pattern: str, known=None) -> MergeReplay:
    """This worker's replay for the vocabulary; a worker that is used again keeps it."""
    if key not in _REPLAYS:
        _REPLAYS.clear()
        _REPLAYS[key] = MergeReplay(ranks, pattern, known=known)
    return _REPLAYS[key]


def _digest(*what) -> str:
    return hashlib.sha256(repr(what).encode()).hexdigest()


def corpus_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n) of every distinct word of all texts; written."""
    import pyarrow as pa

    key, sent = _digest(sorted(ranks.items()), pattern), docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches):
        replay = _replay(key, sent.value, pattern)
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                for words in replay.cuts(text or ""):
                    found.update(words)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return written(map_batches(docs.select(text_col), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")


def frequent(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent words, ``most`` at most: all from some number of occurrences on, so that no task ranks them.

    The numbers are looked at in classes (single ones below 1,024, then 64 for each doubling), of which a few thousand exist.
    """
    kind = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64)).cast("int")
    sizes = counted.groupBy(kind.alias("kind")).agg(F.count("*").alias("words")).collect()
    least, room = None, most
    for row in sorted(sizes, reverse=True):
        room -= row.words
        if room < 0:
            break
        least = row.kind
    return counted.where(kind >= least) if least is not None else counted.limit(0)


def word_table(counted: DataFrame, ranks: dict[bytes, int], pattern: str, words_a_task: int = 50_000) -> DataFrame:
    """(word, n, ids) of a table of distinct words, by replay over all of them."""
    import pyarrow as pa

    key, sent = _digest(sorted(ranks.items()), pattern), counted.sparkSession.sparkContext.broadcast(ranks)
    tasks = max(1, -(-counted.count() // words_a_task))

    def merge(batches):
        replay = _replay(key, sent.value, pattern)
        for batch in batches:
            ids, lengths = replay.replay([w.encode() for w in batch.column(0).to_pylist()])
            bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))], ["word", "n", "ids"])

    return map_batches(counted.repartition(tasks, "word"), merge, "word string, n long, ids array<int>")


def _known(words: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A word table of bounded size, as ``MergeReplay`` takes it."""
    rows = words.select("word", "ids").toArrow()
    ids = rows["ids"].combine_chunks()
    return rows["word"].to_pylist(), ids.flatten().to_numpy().astype(np.int32), np.diff(ids.offsets.to_numpy()).astype(np.int64) if len(rows) else np.zeros(0, np.int64)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text", hot: int = 150_000, batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, ids array<int>[, decoded binary]) of every row; ``decoded`` adds the bytes that the ids read back to.

    The rank file at ``path`` (a vocabulary, of fixed size) is read on the driver and broadcast, and so are the ids of the
    corpus's ``hot`` most frequent words.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ranks = read_ranks(path)
    known = _known(word_table(frequent(corpus_words(docs, ranks, pattern, text_col), hot), ranks, pattern))
    key = _digest(sorted(ranks.items()), pattern, hashlib.sha256("\n".join(known[0]).encode()).hexdigest(), len(known[0]))
    sent = docs.sparkSession.sparkContext.broadcast((ranks, known))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def out(replay, keys, texts):
        ids = replay.encode(texts)
        columns = [keys, pa.array(ids, pa.list_(pa.int32()))]
        if decoded:
            columns.append(pa.array([replay.decode(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        ranks, known = sent.value
        replay = _replay(key, ranks, pattern, known)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + batch_bytes, "right")))
                part = batch.slice(first, last - first)
                yield out(replay, part.column(0), [x or "" for x in part.column(1).to_pylist()])
                first = last

    schema = f"doc_id {id_type}, ids array<int>" + ", decoded binary" * decoded
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids); null ids decode to nothing."""
    import pyarrow as pa

    ranks = read_ranks(path)
    key = _digest(sorted(ranks.items()), pattern)
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        replay = _replay(key, sent.value, pattern)
        for batch in batches:
            back = [replay.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {id_type}, decoded binary")


def token_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode(docs, path, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
