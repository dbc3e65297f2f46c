"""Latin spelling of any text: a table from characters, or short sequences of them, to ASCII, and the column function that applies it.

The table is data. ``spelling_table`` makes one by rule from the Unicode character database: compatibility forms are folded, marks dropped,
and letters spelled by their names. A table may be longer, shorter or another; its longest sources win.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogmatch.functions.text import LETTERS, SPELLED

#: Cyrillic letters of languages other than Russian, and letters whose names mislead.
OTHERS = {"і": "i", "ї": "i", "є": "ie", "ґ": "g", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ѓ": "gj", "ќ": "kj", "ρ": "r", "ς": "s", "ı": "i", "ð": "d", "þ": "th", "ŋ": "ng"}
#: Scripts whose letters are spelled by how their names begin, and those spelled by the whole name.
BY_BEGINNING = ("GREEK SMALL LETTER ", "GEORGIAN LETTER ", "ARMENIAN SMALL LETTER ", "HEBREW LETTER ", "ARABIC LETTER ")
BY_NAME = ("HIRAGANA LETTER ", "KATAKANA LETTER ")
RANGES = ((0x80, 0x0600), (0x0620, 0x0650), (0x10D0, 0x1100), (0x1D00, 0x2300), (0x2460, 0x2500), (0x2C60, 0x2C80), (0x3040, 0x3100), (0x3200, 0x3400), (0xA720, 0xA800), (0xFB00, 0xFB50), (0xFF00, 0xFFF0), (0x1D400, 0x1D800))


def _letter(c: str) -> str | None:
    """The spelling of a lower-case letter without marks; None of what has none."""
    own = dict(zip(*LETTERS, strict=True)) | SPELLED | OTHERS
    if c in own or c.isascii():
        return own.get(c, c)
    name = unicodedata.name(c, "")
    for script in BY_NAME:
        if name.startswith(script):
            return name.removeprefix(script).removeprefix("SMALL ").split(" ")[0].lower()
    for script in BY_BEGINNING:
        if name.startswith(script):
            first = name.removeprefix(script).removeprefix("FINAL ").split(" ")[0]
            return re.match("[^AEIOU]+|[AEIOU]", first)[0].lower()
    if found := re.match(r"LATIN SMALL LETTER ([A-Z]{1,2})( WITH .*)?$", name):
        return found[1].lower()
    return None


def _spelled(c: str) -> str | None:
    own = _letter(c)
    if own is not None and not c.isascii():
        return own
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c).lower())
    parts = [_letter(x) for x in folded if not unicodedata.category(x).startswith("M")]
    if folded == c and (not parts or parts == [None]):
        return "" if unicodedata.category(c).startswith("M") else None
    return "".join(" " if x is None else x for x in parts)


@functools.cache
def spelling_table() -> dict[str, str]:
    """Lower-case sources of one to three characters and their spelling; what is not in it stays as it is."""
    table = {}
    for c in (chr(k) for low, high in RANGES for k in range(low, high)):
        if c.lower() == c and (spelled := _spelled(c)) is not None:
            table[c] = spelled
    for c, spelled in list(table.items()):  # letters that are spelled otherwise than their base, written with a mark of its own
        apart = unicodedata.normalize("NFD", c)
        if apart != c and len(apart) <= 3 and spelled != "".join(table.get(x, x) for x in apart):
            table[apart] = spelled
    for script in ("HIRAGANA", "KATAKANA"):  # small letters join the syllable before or double the one behind
        kana = {unicodedata.name(c, ""): c for c in table if len(c) == 1}
        small = {v: kana[f"{script} LETTER SMALL Y{v}"] for v in "AUO"}
        syllables = {n.removeprefix(f"{script} LETTER "): c for n, c in kana.items() if re.fullmatch(rf"{script} LETTER [A-Z]{{1,2}}", n)}
        joined = {c + y: name[:-1].lower() + "y" + v.lower() for name, c in syllables.items() if len(name) == 2 and name.endswith("I") for v, y in small.items()}
        table |= joined
        double = kana[f"{script} LETTER SMALL TU"]
        table |= {double + c: table[c][0] + table[c] for c in [*syllables.values(), *joined] if table[c][0] not in "aeioun"}
    return table


def _ranges(characters) -> str:
    """The inside of a character class, neighbours as ranges."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def spelled(text: Column, table: dict[str, str] | None = None) -> Column:
    """``text`` in lower case with every source of the table replaced, the longest that fits first; in the JVM.

    Characters that become one or none, and begin or continue no longer source, are translated first; of what is left, a pattern
    cuts out the sources, each of which is looked up, and runs of other characters.
    """
    table = spelling_table() if table is None else table
    longer = sorted((s for s in table if len(s) > 1), key=lambda s: (-len(s), s))
    inside = {c for s in longer for c in s}
    plain = sorted((s for s, t in table.items() if len(s) == 1 and len(t) <= 1 and s not in inside and not {*table[s]} & {*table, *inside}), key=lambda s: (table[s] == "", s))
    text = F.translate(F.lower(text.cast("string")), "".join(plain), "".join(table[s] for s in plain)) if plain else F.lower(text.cast("string"))
    rest = {s: t for s, t in table.items() if s not in {*plain}}
    if not rest:
        return text
    single = _ranges({s for s in rest if len(s) == 1} | {s[0] for s in longer})
    ascii_too = any(s[0].isascii() for s in rest)
    cut = "|".join([*([] if ascii_too else [r"[\x00-\x7f]+"]), *map(re.escape, longer), f"[{single}]", f"[^{single}]+" if ascii_too else rf"[^{single}\x00-\x7f]+"])
    known = F.str_to_map(F.lit("\x01".join(f"{s}\x02{t}" for s, t in rest.items())), F.lit("\x01"), F.lit("\x02"))  # folded to a constant
    most = max(map(len, rest))
    cuts = F.regexp_extract_all(text, F.lit(f"(?s){cut}"), F.lit(0))
    looked_up = F.array_join(F.transform(cuts, lambda x: F.when(F.length(x) > most, x).otherwise(F.coalesce(F.try_element_at(known, x), x))), "")
    return looked_up if ascii_too else F.when(text.rlike(r"[^\x00-\x7f]"), looked_up).otherwise(text)


def normalize_spelled(text: Column, table: dict[str, str] | None = None) -> Column:
    """Lower case, Latin letters by ``table``, everything else one space; null stays null."""
    return F.trim(F.regexp_replace(spelled(text, table), "[^a-z0-9]+", " "))
