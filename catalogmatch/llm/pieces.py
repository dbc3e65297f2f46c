"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text is cut where no piece of the vocabulary can stand across (before each run of spaces, and before signs and
characters that no piece holds behind a letter); what stands between two cuts, a chunk, is encoded for itself and remembered. An agenda lists the adjacent
symbol pairs of a chunk that form a piece; the pair of highest score, the leftmost of several, becomes one symbol, and the pairs
around it are listed anew, until the agenda is empty. The agendas of all new chunks of an Arrow batch run side by side as
arrays: in each round every chunk takes the first entry of its own agenda. Long chunks, which need many rounds, have a heap each.
Characters outside the vocabulary become their bytes' ids. What is learnt of a batch's chunks is checked against the
sentencepiece library in the same batch; a difference is an error, so ids that the library would not give are never returned.

Results in special cases: null and empty texts have the end id alone and decode to an empty text; repeated rows give equal
results; an empty table gives an empty result; other columns are not read. Texts of any length are encoded whole, in parts
between cuts. Vocabularies that normalise texts, or hold user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import defaultdict
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import map_batches, table

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: No pair; above the rank of every piece.
NO_PAIR = np.iinfo(np.int32).max
#: Chunks of more characters have a heap for their agenda.
LONG = 96
_PART = 1 << 18
#: So many chunks are checked at a time.
_CHECKED = 1024


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; values are integers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the pairs that merge."""

    def __init__(self, model: bytes):
        self.pieces, scores, self.kinds, self.prefix = [], [], [], True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2 and dict(fields(value)).get(3, 1) != 2:
                raise ValueError("the vocabulary is not of the merge type")
            elif number == 3:
                rules = dict(fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or not self.prefix:
                    raise ValueError("vocabularies that normalise texts, or have no dummy prefix, are not supported")
        if {USER, UNUSED} & {*self.kinds}:
            raise ValueError("user-defined and unused pieces are not supported")
        if self.kinds.count(BYTE) < 256:
            raise ValueError("vocabularies without pieces for all bytes are not supported")
        ids = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] == NORMAL}
        self.byte_ids = {int(self.pieces[k][1:-1], 16): k for k, kind in enumerate(self.kinds) if kind == BYTE}
        letters = sorted({c for p in ids for c in p})
        #: Symbols: ids of pieces, then the letters that are no piece themselves.
        self.symbols = {c: ids[c] if c in ids else len(self.pieces) + k for k, c in enumerate(letters)}
        known = ids | {c: s for c, s in self.symbols.items() if c not in ids}
        self.width = len(self.pieces) + len(letters)
        ranks = {s: k for k, s in enumerate(sorted({scores[k] for k in ids.values()}, reverse=True))}
        pairs = {}
        for piece, number in ids.items():
            for k in range(1, len(piece)):
                left, right = known.get(piece[:k]), known.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (ranks[scores[number]], number)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        if SPACE in {c for p in ids for c in p.lstrip(SPACE)}:
            raise ValueError("pieces with a space behind other characters are not supported")
        #: ASCII characters that no piece holds, and signs, which pieces hold behind a space, other signs and a few characters only.
        foreign = {chr(c) for c in range(128)} - {*letters}
        self.mark = min(foreign)
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - foreign
        few = {a for p in ids for a, b in zip(p, p[1:]) if b in signs and a not in signs and a != SPACE}
        f, o, c = ("".join(re.escape(x) for x in sorted(xs)) for xs in (foreign, signs, few))
        rest = f"[^{SPACE}{f}{o}]*" + (f"(?:(?<=[{c}])[{o}]+[^{SPACE}{f}{o}]*)*" if c else "")
        #: A chunk: spaces, foreign characters or signs, and what follows them.
        self.chunk = re.compile(f"{SPACE}+[{o}]*{rest}|[{f}]+[{o}]*{rest}|[{o}]+{rest}" if f and o else f"{SPACE}+[^{SPACE}]*")
        self.texts = [b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, kind in zip(self.pieces, self.kinds, strict=True)]
        for byte, k in self.byte_ids.items():
            self.texts[k] = bytes([byte])
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.is_byte = np.array([kind == BYTE for kind in self.kinds])
        self.table = np.full(0x110000, -1, np.int32)
        self.table[[ord(c) for c in letters]] = [self.symbols[c] for c in letters]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; ``NO_PAIR`` where they form no piece."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NO_PAIR), self.merged[at]


def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Agenda:
    """Encoder and decoder for one model file; remembers the chunks it has met, ``most_chunks`` at most and one batch's."""

    def __init__(self, model: bytes, most_chunks: int = 400_000):
        import sentencepiece

        self.vocabulary = Vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = self.library.eos_id()
        self.most_chunks = most_chunks
        self._forget()

    def _forget(self) -> None:
        self.chunks: dict[str, int] = defaultdict(None)
        self.chunks.default_factory = self.chunks.__len__
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _heap(self, symbols: list[int]) -> list[int]:
        """The places of ``symbols`` that stay, after all merges in ``symbols`` itself: one chunk, by a heap."""
        v, n = self.vocabulary, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive, sizes, queue = [True] * n, [1] * n, []
        ranks, merged = (x.tolist() for x in v.of_pairs(np.array(symbols[:-1]), np.array(symbols[1:])))
        queue = [(r, k, 2, m) for k, (r, m) in enumerate(zip(ranks, merged, strict=True)) if r < NO_PAIR]
        heapq.heapify(queue)

        def enlist(left: int, right: int) -> None:
            at = np.searchsorted(v.keys, key := symbols[left] * v.width + symbols[right]) if min(symbols[left], symbols[right]) >= 0 else len(v.keys)
            if at < len(v.keys) and v.keys[at] == key:
                heapq.heappush(queue, (int(v.ranks[at]), left, sizes[left] + sizes[right], int(v.merged[at])))

        while queue:
            _, left, size, number = heapq.heappop(queue)
            right = after[left]
            if not alive[left] or right < 0 or sizes[left] + sizes[right] != size:
                continue
            symbols[left], alive[right] = number, False
            sizes[left] = size
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                enlist(left, after[left])
            if before[left] >= 0:
                enlist(before[left], left)
        return [k for k in range(n) if alive[k]]

    def _rounds(self, symbols: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Merges of many chunks side by side, in ``symbols`` itself; a mask of the places that stay. ``chunk`` numbers each place's chunk."""
        v = self.vocabulary
        stays = np.ones(len(symbols), bool)
        place = np.arange(len(symbols))
        own, at = symbols.copy(), chunk
        inner = np.append(at[1:] == at[:-1], False)
        rank, made = np.full(len(own), NO_PAIR, np.int32), np.zeros(len(own), np.int32)
        k = np.flatnonzero(inner)
        rank[k], made[k] = v.of_pairs(own[k], own[k + 1])
        while len(own):
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(own)))
            live = np.repeat(best < NO_PAIR, sizes)
            if not live.all():  # chunks whose agendas are empty are done
                symbols[place[~live]] = own[~live]
                place, own, at, rank, made = (x[live] for x in (place, own, at, rank, made))
                sizes, best = sizes[best < NO_PAIR], best[best < NO_PAIR]
                first = np.cumsum(sizes) - sizes
                if not len(own):
                    break
            top = np.flatnonzero(rank == np.repeat(best, sizes))
            top = top[np.append(True, at[top[1:]] != at[top[:-1]])]  # the leftmost of each chunk
            own[top] = made[top]
            gone = np.zeros(len(own), bool)
            gone[top + 1] = True
            stays[place[top + 1]] = False
            new = top - np.cumsum(gone)[top]  # the places of the merged symbols when the others have gone
            place, own, at, rank, made = (x[~gone] for x in (place, own, at, rank, made))
            for k in (new, new[new > 0] - 1):
                k = k[k + 1 < len(own)]
                inside = at[k] == at[k + 1]
                rank[new[new + 1 >= len(own)]] = NO_PAIR
                rank[k[~inside]] = NO_PAIR
                k = k[inside]
                rank[k], made[k] = v.of_pairs(own[k], own[k + 1])
        return stays

    def replay(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, one after another; number of ids of each)."""
        v = self.vocabulary
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        symbols, sizes = v.table[code], np.array([len(c) for c in chunks], np.int64)
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        stays = np.ones(len(code), bool)
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(sizes > LONG).tolist():
            span = slice(int(ends[k] - sizes[k]), int(ends[k]))
            own = symbols[span].tolist()
            kept = self._heap(own)
            stays[span] = False
            stays[np.array(kept) + span.start] = True
            symbols[span] = own
        short = np.flatnonzero((sizes <= LONG)[chunk])
        own = symbols[short]
        stays[short] = self._rounds(own, chunk[short])
        symbols[short] = own
        symbols, code, chunk = symbols[stays], code[stays], chunk[stays]
        foreign = np.flatnonzero((symbols < 0) | (symbols >= len(v.pieces)))
        if not len(foreign):
            return symbols, np.bincount(chunk, minlength=len(chunks))
        raw = [chr(c).encode() for c in code[foreign].tolist()]
        bytes_of = [[v.byte_ids[b] for b in c] for c in raw]
        widths = np.ones(len(symbols), np.int64)
        widths[foreign] = [len(x) for x in bytes_of]
        out = np.repeat(symbols, widths)
        inside = np.zeros(len(symbols), bool)
        inside[foreign] = True
        out[np.repeat(inside, widths)] = [x for found in bytes_of for x in found]
        return out.astype(np.int32), np.bincount(np.repeat(chunk, widths), minlength=len(chunks))

    def _learn(self) -> None:
        """Ids of the chunks met since the last call, checked against the library."""
        new = list(islice(self.chunks, len(self.lengths), None))
        if not new:
            return
        ids, lengths = self.replay(new)
        self._check(new, ids, lengths)
        self.ids, self.lengths = np.append(self.ids, ids), np.append(self.lengths, lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _check(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Compares with the library, which reads many chunks as one text, a foreign character before each."""
        mark = self.vocabulary.mark
        before = self.library.encode(mark, num_threads=1)
        ends = np.cumsum(lengths)
        for first in range(0, len(chunks), _CHECKED):
            part, own = chunks[first : first + _CHECKED], lengths[first : first + _CHECKED]
            starts = ends[first : first + _CHECKED] - own
            ours = np.insert(ids[starts[0] : starts[-1] + own[-1]], starts - starts[0], before[-1])
            if self.library.encode(mark + mark.join(part), num_threads=1) != before[:-1] + ours.tolist():
                raise ValueError(f"ids differ from the library's between {part[0]!r} and {part[-1]!r}")

    def _numbers(self, text: str):
        """Numbers of the chunks of a text, in parts."""
        if not text:
            return
        found = self.vocabulary.chunk.finditer(SPACE + text.replace(" ", SPACE)) if len(text) > _PART else None
        if found is None:
            chunks = self.vocabulary.chunk.findall(SPACE + text.replace(" ", SPACE))
            yield np.fromiter(map(self.chunks.__getitem__, chunks), np.int32, len(chunks))
            return
        while chunks := [m.group() for m in islice(found, _PART)]:
            yield np.fromiter(map(self.chunks.__getitem__, chunks), np.int32, len(chunks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        if len(self.chunks) > self.most_chunks:
            self._forget()
        numbers = [np.concatenate([np.zeros(0, np.int32), *self._numbers(text)]) for text in texts]
        self._learn()
        return [np.append(_spread(self.ids, self.starts[x], self.lengths[x]), np.int32(self.end)) for x in numbers]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the first space goes, bytes that are no UTF-8 are U+FFFD each."""
        v = self.vocabulary
        ids = np.asarray(ids, np.int64)
        out = _spread(v.bytes, v.starts[ids], v.lengths[ids]).tobytes()
        first = np.flatnonzero(v.lengths[ids] > 0)
        if len(first) and v.pieces[ids[first[0]]].startswith(SPACE):
            out = out[1:]
        if not v.lengths[ids[:-1]].all():
            return self._mended(ids)
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._mended(ids)

    def _mended(self, ids: np.ndarray) -> str:
        v, out, run, begun = self.vocabulary, [], b"", False
        for k in [*ids.tolist(), -1]:
            if k >= 0 and v.is_byte[k]:
                run += v.texts[k]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            begun, run = begun or bool(out), b""
            if k >= 0 and v.texts[k]:
                piece = v.texts[k].decode()
                out.append(piece[1:] if not begun and v.pieces[k].startswith(SPACE) else piece)
                begun = True
        return "".join(out)


_AGENDAS: dict[str, Agenda] = {}


def _agenda(model: bytes) -> Agenda:
    """This worker's encoder; a worker that is used again keeps it."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _AGENDAS:
        _AGENDAS.clear()
        _AGENDAS[key] = Agenda(model)
    return _AGENDAS[key]


def encode_pieces(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, ids array<int>[, decoded string]) of every row, the end id last; ``decoded`` adds the text that the ids read back to.

    The model file at ``path`` (a vocabulary, of fixed size) is read on the driver and broadcast.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    with open(path, "rb") as file:
        model = file.read()
    Vocabulary(model)  # refuses what is not supported before any job starts
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def run(batches):
        agenda = _agenda(sent.value)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + batch_bytes, "right")))
                part = batch.slice(first, last - first)
                ids = agenda.encode([x or "" for x in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([agenda.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
                first = last

    schema = f"doc_id {id_type}, ids array<int>" + ", decoded string" * decoded
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded string) from (doc_id, ids); null ids decode to an empty text."""
    import pyarrow as pa

    with open(path, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        agenda = _agenda(sent.value)
        for batch in batches:
            back = [agenda.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {id_type}, decoded string")


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode_pieces(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    import public_tokenizers

    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
