"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical words: lower-case, without punctuation, numbers, names and units replaced by typed
placeholders. A number starts with a digit or is a number word ("half", with an article behind it, is one); a unit is a known
unit word after a number, also one written onto it; a name is a word that begins with a capital letter, of any script. Number words that follow one another are one number, and so are names one
name, so that "Alice" and "Mary Ann" fill one slot. A capitalised word that opens a sentence or a line may be a name or
an ordinary word, so every text has two readings: openers as words, and openers as names; each reading is compared with
the same reading. Windows of canonical words are hash-joined between documents and benchmark items, so that a question
with other numbers or names still meets its template. The windows of an item that meet the document at nearly the same
distance (shifts that differ by ``BAND`` words at most) form a match, which inserted or dropped words do not end; they
must be ``least_share`` of its windows or cover ``COVERED`` of its words.

In a match the slots must agree: an item's value stands for one value of the document, and a document's name or unit for
one of the item. Numbers of the item may fall together by chance, but two thirds as many different ones must remain.

Not every shared window joins: of an item, only its rarest windows do; the others together cover less than
``least_share`` of it. Sentences that many items share thus make no pairs. The documents' windows pass a
Bloom filter of the benchmark's windows first, whose size is fixed; the joins decide.

Results in special cases: null and empty texts match nothing; items shorter than a window are looked for as a whole, and
those shorter than ``least_words`` only as sentences of their own with the same values; windows with fewer ordinary words
than a quarter do not count unless the item is that short; rows that share an id are one document, rows without an id are
one if their texts are equal; of an item id with several texts each is looked for; an empty table gives an empty result; other columns of any name pass through ``drop_leaking``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.llm.common import map_batches, mixed, sized, table, unused, word_hashes, written
from catalogmatch.llm.common import _IS_SPACE, _LOWER, _STEP, _powers

WINDOW = 7
#: Of an item's words so many must be covered where its windows are fewer than asked for: edits break windows that their words survive.
COVERED = 0.7
#: How far shifts may lie apart in a match.
BAND = 8
FILTER_BITS = 23
#: Bytes of a document from which on it is worked on in parts.
LONG = 1 << 22
#: Units.
UNITS = (
    "mm cm m km mg g kg t ml l s sec min h hr ms hz khz mhz ghz w kw mw v a j kj cal kcal k c f % percent inch inches foot feet yard yards "
    "mile miles ounce ounces pound pounds lb lbs oz gallon gallons liter liters litre litres meter meters metre metres gram grams kilogram "
    "kilograms second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp"
).split()
#: Number words.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = [*ONES, *TENS, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen half".split(), *(t + o for t in TENS for o in ONES)]
TYPES = ["", "number", "name", "unit"]
READINGS = (0, 1)
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%")]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_MARKS = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Canonical:
    """The canonical words of a group of texts: numbers, types, places in the joined bytes, first word of each text.

    In ``reading`` 0 capitalised words that open a sentence are ordinary words, in reading 1 they are names. ``opens`` says
    which words open one; that of the very first word can be told.
    """

    def __init__(self, texts: list[bytes], reading: int = 0, first_opens: bool = True):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        space = np.concatenate([[True], _IS_SPACE[raw]])
        turns = np.flatnonzero(space[1:] != space[:-1])
        first, last = turns[::2], turns[1::2]
        keep = _KEEP[raw]
        digit = (raw >= 48) & (raw <= 57)
        #: A unit written onto a number is a word of its own.
        cuts = np.flatnonzero(digit[:-1] & keep[1:] & ~digit[1:] & (raw[1:] < 128)) + 1
        if len(cuts):
            led = digit[first] | (~keep[first] & digit[np.minimum(first + 1, len(raw) - 1)])
            cuts = cuts[led[np.searchsorted(first, cuts, "right") - 1]]
            first, last = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
        rank = np.concatenate([[0], np.cumsum(keep)])
        solid = rank[last] > rank[first]  # words of punctuation alone are left out
        lines = np.concatenate([[0], np.cumsum(raw == 10)])
        opens = np.ones(len(first), bool)
        if len(first) > 1:
            opens[1:] = _ENDS[raw[last[:-1] - 1]] | (lines[first[1:]] > lines[last[:-1]])
        begins = np.searchsorted(first, starts[starts <= (first[-1] if len(first) else -1)])
        opens[begins] = True
        opens[:1] = first_opens
        follows = np.zeros(len(first), bool)  # directly after a word without a mark between them
        follows[1:] = solid[:-1] & keep[last[:-1] - 1] & ~opens[1:]
        follows[begins] = False
        first, last, opens, follows = first[solid], last[solid], opens[solid], follows[solid]
        ahead, back = (p[: rank[-1] + 1] for p in _powers(int(rank[-1]) + 1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(keep, (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * ahead[rank[:-1]], np.uint64(0)))])
        size = (rank[last] - rank[first]).astype(np.uint64)
        words = mixed((sums[last] - sums[first]) * back[rank[first]] + size)
        at = np.append(np.flatnonzero(keep), len(raw) - 1)[rank[first]]
        lead = raw[at]
        spelled = np.isin(words, _NUMBER_WORDS)
        halved = np.zeros(len(first), bool)
        halved[1:] = (words[:-1] == _HALF) & np.isin(words[1:], _ARTICLES) & follows[1:]
        spelled |= halved
        types = np.zeros(len(first), np.int8)
        types[_is_name(raw, at, size) & (~opens | (reading == 1))] = 2
        types[spelled | ((lead >= 48) & (lead <= 57))] = 1
        bounds = np.searchsorted(first, starts)
        after_number = np.concatenate([[False], types[:-1] == 1])[: len(first)]
        after_number[bounds[:-1][bounds[:-1] < len(first)]] = False
        types[after_number & np.isin(words, _UNIT_WORDS) & (types != 1)] = 3
        #: Runs of names, and of numbers of which one is spelled, are one slot.
        joins = np.zeros(len(first), bool)
        joins[1:] = follows[1:] & (types[1:] == types[:-1]) & ((types[1:] == 2) | ((types[1:] == 1) & (spelled[1:] | spelled[:-1])))
        heads = np.flatnonzero(~joins)
        self.first, self.last = first[heads], last[np.append(heads[1:], len(first)) - 1] if len(first) else last
        self.types, self.opens, self.bounds = types[heads], opens[heads], np.searchsorted(heads, bounds)
        self.words = words[heads]
        slot = self.types > 0
        self.words[slot] = _MARKS[self.types[slot]]

    def windows(self, size: int) -> np.ndarray:
        """A number for each run of ``size`` words, also where it runs over the end of a text."""
        if len(self.words) < size:
            return np.zeros(0, np.uint64)
        rolled = self.words[: len(self.words) - size + 1] + np.uint64(size)
        for j in range(1, size):
            rolled = mixed(rolled * _STEP + self.words[j : len(self.words) - size + 1 + j])
        return rolled

    def slots(self, at: int, size: int) -> list[str]:
        """type:value of the placeholders among the words at ``at`` and after; "" for ordinary words."""
        out = []
        for k in range(at, at + size):
            value = ""
            if self.types[k]:
                kept = np.frombuffer(self.data, np.uint8, self.last[k] - self.first[k], self.first[k])
                value = f"{TYPES[self.types[k]]}:{kept[_KEEP[kept]].tobytes().lower().decode('utf-8', 'replace')}"
            out.append(value)
        return out


    def tells(self, at: int, size: int, end: int, least: int) -> bool:
        """Whether a window may count: a quarter of ordinary words, or, below ``least`` words, sentences of their own."""
        if size < least:
            return bool(self.opens[at]) and (at + size == end or bool(self.opens[at + size]))
        return 4 * np.count_nonzero(self.types[at : at + size] == 0) >= size


#: Capital letters of all scripts that have them, by code point.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])


def _is_name(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words that begin ``at``, of ``size`` bytes, begin with a capital letter and have more than that."""
    more = np.append(raw, [0, 0])
    lead = raw[at].astype(np.int32)
    second, third = (more[at + k].astype(np.int32) & 63 for k in (1, 2))
    width = np.select([lead < 128, (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0)], [1, 2, 3], 4)
    code = np.select([width == 1, width == 2, width == 3], [lead, (lead & 31) << 6 | second, (lead & 15) << 12 | second << 6 | third], 0)
    return _CAPITAL[code] & (size > width.astype(np.uint64))


_HALF, _ARTICLES = word_hashes(b"half")[0], word_hashes(b"a an")
_UNIT_WORDS = word_hashes(" ".join(UNITS).encode())
_NUMBER_WORDS = word_hashes(" ".join(NUMBERS).encode())


def _hits(batches, sizes: list[int], wanted: np.ndarray | None, least: int, most: int = 1 << 18):
    """(id, n_words, at, size, hash, slots, reading) of windows; with ``wanted`` (a bit set) only of those in it."""
    import pyarrow as pa

    low = np.uint64((1 << FILTER_BITS) - 1)

    def passing(rolled):
        bits = rolled & low
        return np.flatnonzero((wanted[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1))

    def found(keys, texts, reading):
        group = Canonical(texts, reading)
        rows = []
        for size in sizes:
            rolled = group.windows(size)
            begin = np.arange(len(rolled)) if wanted is None else passing(rolled)
            text = np.searchsorted(group.bounds, begin, "right") - 1
            inside = begin + size <= group.bounds[np.minimum(text + 1, len(group.bounds) - 1)]
            for k, t in zip(begin[inside].tolist(), text[inside].tolist(), strict=True):
                a, b = int(group.bounds[t]), int(group.bounds[t + 1])
                if (wanted is not None or size == min(b - a, sizes[-1])) and group.tells(k, size, b, least):
                    rows.append((keys[t], b - a, k - a, size, int(rolled[k].view(np.int64)), group.slots(k, size), reading))
        return rows

    def found_in_parts(key, text, reading):
        """As ``found`` for one long document: each part begins with the last words of the part before it."""
        rows, begin, done, before, carried, opens = [], 0, 0, 0, 0, True
        while done < len(text):
            stop = min(len(text), done + LONG)
            while stop < len(text) and not _IS_SPACE[text[stop]]:
                stop += 1
            group = Canonical([text[begin:stop]], reading, opens)
            #: The last word may go on in the next part, and what follows it decides about short sentences.
            n = len(group.words) if stop == len(text) else max(0, len(group.words) - 1)
            for size in sizes:
                rolled = group.windows(size)
                hit = passing(rolled)
                #: Windows of carried words alone were looked at in the part before.
                for k in hit[(hit >= (carried - size + 1 if carried else 0)) & (hit + size <= n)].tolist():
                    if group.tells(k, size, len(group.words), least):
                        rows.append((key, 0, before + k, size, int(rolled[k].view(np.int64)), group.slots(k, size), reading))
            carried = min(n, sizes[-1] + 1)
            before += n - carried
            if len(group.words):
                opens = bool(group.opens[n - carried])
                begin += int(group.first[n - carried])
            done = stop
        return rows

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
        rows, begin, length = [], 0, 0
        for k, text in enumerate(texts):
            if wanted is not None and len(text) > LONG:
                rows += [x for reading in READINGS for x in found_in_parts(keys[k], text, reading)]
                texts[k] = text = b""
            length += len(text)
            if length >= most or k == len(texts) - 1:
                rows += [x for reading in READINGS for x in found(keys[begin : k + 1], texts[begin : k + 1], reading)]
                begin, length = k + 1, 0
        if rows:
            ids, *rest, slots, readings = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True)), pa.array(slots, pa.list_(pa.string())), pa.array(readings, pa.int32())],
                ["id", "n_words", "at", "size", "hash", "slots", "reading"],
            )


def template_windows(items: DataFrame, id_col: str, text_col: str = "text", window: int = WINDOW, least_words: int = 5) -> DataFrame:
    """(id, n_words, at, size, hash, slots, reading) of every window of the items; an item shorter than ``window`` is one window."""
    texts = items.select(_key(id_col, text_col, False).alias("id"), F.col(text_col).alias("text")).distinct()
    kind = texts.schema["id"].dataType.simpleString()
    return map_batches(texts, lambda batches: _hits(batches, list(range(1, window + 1)), None, least_words), f"id {kind}, {_HIT}")


_HIT = "n_words long, at long, size int, hash long, slots array<string>, reading int"


def _key(id_col: str, text_col: str, unless_id: bool = True):
    """What makes a document: its id, or its text where it has none; what makes an item: both."""
    text = F.xxhash64(text_col)
    return F.struct(F.col(id_col).alias("id"), (F.when(F.col(id_col).isNull(), text) if unless_id else text).alias("text"))


def _probes(least_share: float):
    """Of an item's windows all but the most common ones, as long as these cover less than ``least_share`` of its words."""
    import pyarrow as pa

    def chosen(rows: pa.Table) -> pa.Table:
        at, size, holders = (rows[c].to_numpy() for c in ("item_at", "size", "holders"))
        begin, covered, spared = at.min(), np.zeros((at + size).max() - at.min(), bool), np.zeros(len(at), bool)
        every = covered.copy()
        for a, n in zip(at.tolist(), size.tolist(), strict=True):
            every[a - begin : a - begin + n] = True
        left = least_share * np.count_nonzero(every)
        for k in np.lexsort((at, -holders)).tolist():
            new = int(size[k] - np.count_nonzero(covered[at[k] - begin : at[k] - begin + size[k]]))
            if new >= left:
                break
            covered[at[k] - begin : at[k] - begin + size[k]] = True
            left -= new
            spared[k] = True
        return rows.filter(pa.array(~spared)).select(["size", "hash", "reading", "item"])

    return chosen


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    least_share: float = 0.5,
    least_words: int = 5,
    window: int = WINDOW,
) -> DataFrame:
    """(id struct<id, text>, item, n, share, changed): documents that hold an item's template, by what makes a document."""
    items = written(template_windows(benchmark, item_col, text_col, window, least_words), "leak-items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` numbers
    bit = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = items.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast((hash & {(1 << FILTER_BITS) - 1}) & 63 AS int)))").alias("bits"))
    words = words.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    wanted = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    wanted[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    texts = docs.select(_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    hits = written(map_batches(texts, lambda batches: _hits(batches, sizes, sent.value, least_words), f"id {kind}, {_HIT}"), "leak-hits")

    ours = items.select(F.col("id").alias("item"), F.col("n_words").alias("item_words"), F.col("at").alias("item_at"), "size", "hash", F.col("slots").alias("item_slots"), "reading")
    holders = items.groupBy("hash", "size", "reading").agg(F.countDistinct("id").alias("holders"))
    held = ours.join(holders, ["hash", "size", "reading"]).select("item", "reading", "item_at", "size", "hash", "holders")
    probes = held.groupBy("item", "reading").applyInArrow(_probes(least_share), "size int, hash long, reading int, item " + ours.schema["item"].dataType.simpleString())
    probes = sized(written(probes, "leak-probes"))
    words = F.explode(F.sequence("item_at", F.col("item_at") + F.col("size") - 1))
    of = ours.select("item", "reading", "item_at", words.alias("word")).groupBy("item", "reading").agg(F.countDistinct("word").alias("of"), F.countDistinct("item_at").alias("windows"))
    ours = ours.join(of, ["item", "reading"])
    pairs = written(hits.join(probes, ["hash", "size", "reading"]).select("id", "item", "reading").distinct(), "leak-candidates")
    ours = sized(written(ours, "leak-windows"))
    met = hits.drop("n_words").join(sized(pairs), ["id", "reading"]).join(ours, ["item", "hash", "size", "reading"])
    met = met.withColumn("shift", F.col("at") - F.col("item_at"))
    #: A window that the document holds at several places counts where most of the item's windows are.
    met = met.withColumn("support", F.count("*").over(Window.partitionBy("id", "item", "reading", "shift")))
    cell = F.floor(F.col("shift") / BAND)
    met = met.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    best = F.row_number().over(Window.partitionBy("id", "item", "reading", "cell", "item_at").orderBy(F.desc("support"), "shift", "size"))
    match = ["id", "item", "reading", "cell"]
    met = met.withColumn("place", best).where("place = 1")
    met = written(met.select(*match, "item_at", "size", "of", "windows", "item_words", F.arrays_zip("item_slots", "slots").alias("slots")), "leak-met")
    whole = ["of", "windows", "item_words"]
    covered = met.select(*match, "item_at", *whole, words.alias("word")).groupBy(*match)
    counts = covered.agg(F.countDistinct("word").alias("covered"), F.countDistinct("item_at").alias("n"), *(F.max(c).alias(c) for c in whole))
    counts = counts.where((F.col("n") >= F.lit(least_share) * F.col("windows")) | (F.col("covered") >= F.lit(max(least_share, COVERED)) * F.col("of")))
    values = met.select(*match, "item_at", F.posexplode("slots").alias("k", "x")).where("x.item_slots <> ''")
    values = values.select(*match, (F.col("item_at") + F.col("k")).alias("place"), F.col("x.item_slots").alias("theirs"), F.col("x.slots").alias("own"))
    per_value = values.groupBy(*match, "theirs").agg(
        F.min("own").alias("own"), F.max("own").alias("other"), F.countDistinct(F.when(F.col("own") != F.col("theirs"), F.col("place"))).alias("changed")
    )
    strict = F.when(~F.col("theirs").startswith("number:"), F.col("theirs"))
    number = F.when(F.col("theirs").startswith("number:"), F.col("own"))
    slots = per_value.groupBy(*match).agg(
        F.bool_and(F.col("own") == F.col("other")).alias("agree"),
        (F.countDistinct(F.when(strict.isNotNull(), F.col("own"))) == F.count(strict)).alias("apart"),
        (3 * F.countDistinct(number) >= 2 * F.count(number)).alias("different"),
        F.sum("changed").alias("changed"),
    )
    fits = counts.join(slots, match, "left").where(F.coalesce(F.expr("agree AND apart AND different"), F.lit(True)))
    fits = fits.withColumn("changed", F.coalesce("changed", F.lit(0))).where((F.col("item_words") >= least_words) | (F.col("changed") == 0))
    x = F.max(F.struct(F.round(F.col("covered") / F.col("of"), 6).alias("share"), (-F.col("changed")).alias("changed"), "n"))
    return fits.groupBy("id", F.col("item.id").alias("item")).agg(x.alias("x")).select("id", "item", "x.n", "x.share", (-F.col("x.changed")).alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, item_id, n_windows, share, changed_slots) of every document that holds an item's template.

    ``n_windows`` of the item's windows meet the document and cover ``share`` of its words; in ``changed_slots`` placeholders the document has another value than the item. ``limits`` are those of ``matches``.
    """
    found = matches(docs, benchmark, id_col, item_col, text_col, **limits)
    return found.select(
        F.col("id.id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_windows"), "share", F.col("changed").cast("long").alias("changed_slots")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    (gone,) = unused(docs, "gone")
    found = written(matches(docs, benchmark, id_col, item_col, text_col).select(F.col("id").alias(gone)).distinct(), "leak-gone")
    return docs.join(sized(found), _key(id_col, text_col) == F.col(gone), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items they hold."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
