"""Secrets, licences, leaks and tokens against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest_llm import prose

from catalogmatch.llm import bpe, decontaminate, licenses, secrets

P = pytest.importorskip("public_tokenizers")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text, found = text or "", []
    found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x[2] for x in sorted(found)]


def test_base_spans(spark, odd, none):
    made, bits = random.Random(4), ["token", "Secret", "API_KEY", "apikey", "=", ": ", "'", '"', "abcd1234", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", " ", "😀", "x", "\n", "\n\n", "ß"]
    texts = ["".join(made.choice(bits) for _ in range(made.randint(0, 40))) for _ in range(300)] + ["token: secret: abcdefghijk"]
    rows = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in secrets.secret_report(rows).join(rows.select("doc_id", "text").distinct(), "doc_id").collect():
        spans = base_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("part")] == spans
    assert secrets.secret_report(rows).count() == rows.count() and secrets.secret_report(none).count() == 0


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("username: bob_smith pwd=hunter22 https://db.example.com/x", ["part_id", "part_secret", "part_endpoint"]),
        ("username: bob_smith and https://db.example.com/x", []),
        ("pwd=hunter22 only", []),
        ("username: bob_smith\n\npwd=hunter22", []),
        ("username: bob_smith" + " " * 150 + "pwd=hunter22", ["part_id", "part_secret"]),
        ("username: bob_smith" + " " * 250 + "pwd=hunter22", []),
        ("token=abcdefgh12 login=alice", ["assign", "part_id"]),
    ],
)
def test_parts_link_only_together(spark, text, kinds):
    row = secrets.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.split(":")[0] for s in row.spans.split(",") if s] == kinds


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("https://db.example.com/" + "x" * 300 + " pwd=hunter22", ["part_endpoint", "part_secret"]),
        ("private_key=" + "Q" * 450 + "\nclient_id=robot", ["part_secret", "part_id"]),
        ("https://db.example.com/" + "x" * 300 + " " * 201 + "pwd=hunter22", []),
    ],
)
def test_long_parts_link_from_their_end(spark, text, kinds):
    test_parts_link_only_together(spark, text, kinds)


PART = {k: re.compile(p.replace("(?i)", ""), re.I | re.A) for k, p in (("part_id", secrets.PART_ID), ("part_secret", secrets.PART_SECRET), ("part_endpoint", secrets.PART_ENDPOINT))}


def plain_spans(text, reach=200):
    """Base spans, and of all pairs of parts those that link."""
    scopes = [0] + [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(text))]
    parts = [(k, m.start(), m.end()) for k, p in PART.items() for m in p.finditer(text)]
    role = {"assign": "s", "hex": "s", "part_secret": "s", "access": "i", "part_id": "i", "part_endpoint": "e"}
    scope = lambda x: sum(s <= x[1] for s in scopes)
    out = list(base)
    for x in parts:
        for y in [*base, *parts]:
            gap = max(y[1] - x[2], x[1] - y[2])
            if scope(x) == scope(y) and gap <= reach and (role[x[0]] == "s") != (role[y[0]] == "s"):
                out.append(x)
                break
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0]))))


def test_links_equal_all_pairs(spark):
    made, bits = random.Random(9), ["user_id=bobby", "login: anna_k", "pwd=hunter22", "passcode: 998877", "https://a.example/x", "redis://h:1/0", "token=abcdefgh12", "AKIA" + "A" * 14, "ab12" * 9, "\n\n", "\n", "x" * 90, "y " * 60, "z" * 150]
    texts = [" ".join(made.choice(bits) for _ in range(made.randint(2, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])] * 3, "doc_id long, text string")
    got = secrets.secret_report(rows).collect()
    assert len(got) == 303
    for r in got:
        assert r.spans == plain_spans(texts[r.doc_id or 0])


def test_licenses(spark, odd, none):
    rows = [(1, "Text.\nReleased under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "My driving license expired and the licence office was closed"), (4, "Licensed under CC BY-SA 4.0.\nReleased under the MIT License."), (5, "All about rights and permission in the village")]
    made = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {r.doc_id: (r.licenses, r.lines) for r in licenses.license_report(made).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5)] == ["MIT", "GPL-2.0", "", "CC-BY-SA-4.0,MIT", ""] and got[1][1] == "1" and got[101] == ("", "")
    assert licenses.license_report(made).count() == made.count() and licenses.license_report(none).count() == 0


BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by the
# Free Software Foundation, either version 3 of the License, or (at your
# option) any later version."""
MIT = """// Permission is hereby granted, free of charge, to any person obtaining a
// copy of this software and associated documentation files (the "Software"),
// to deal in the Software without restriction, including without limitation"""
STRANGE = """Holders of the Frobnicate Community Covenant may recite this poem on
Tuesdays, provided a licence fee in turnips is sent to the village elder."""


def test_licenses_in_wrapped_paragraphs(spark):
    texts = [BSD, f"{prose(3, 200)}\n\n{GPL}\n\n{prose(4, 90)}", MIT, "// SPDX-License-Identifier: MIT", STRANGE, f"/* SPDX-License-Identifier: EUPL-1.2 */\n{prose(5, 40)}", prose(6, 900), f"{prose(7, 300)} {MIT} {prose(8, 300)}"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.lines) for r in licenses.license_report(made).collect()}
    assert [got[k][0] for k in range(8)] == ["BSD-3-Clause", "GPL-3.0", "MIT", "MIT", "", "EUPL-1.2", "", "MIT"]
    assert got[0][1] == "0-2" and got[1][1] == "2-5" and got[3][1] == "0"


def test_versions_and_families_are_told_apart(spark):
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {
        lesser.format("2.1"): "LGPL-2.1", lesser.format("3"): "LGPL-3.0", lesser.format("2.1").replace("library", "program"): "LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Released under the BSD 2-Clause License.": "BSD-2-Clause", "Released under the BSD 3-Clause License.": "BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
        "Licensed under the Artistic License 2.0.": "Artistic-2.0", "This program is made available under the terms of the Eclipse Public License 2.0": "EPL-2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license": "Apache-2.0,MIT", "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY': "MIT",
        "This work is licensed under the GNU General Public License, version 4.": "", "Licensed under the Apache License, Version 1.1.": "",
    }
    rows = [(k, f"{prose(k, 120)}\n\n{text}\n\n{prose(k + 50, 60)}") for k, text in enumerate(cases)]
    got = {r.doc_id: r.licenses for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_licenses_learn_from_all_windows(spark):
    """Words tell by their share of all different windows, licences left out; a part of the corpus has other shares."""
    made, near = random.Random(4), ["software", "granted", "copies", "redistribution", "warranty", "clause", "creative", "copyright", "holder", "permission", "notice", "forms", "mozilla", "public", "eclipse", "domain"]
    texts = [f"plain{k} words " + " ".join(made.choice("abcdefgh") * 3 for _ in range(5)) for k in range(2_400)]
    often = {}
    for i, word in enumerate(near):  # 22 or 26 of 2,400 windows hold it, where 24 are the most
        often[word] = 22 + 4 * (i % 2)
        for k in made.sample(range(len(texts)), often[word]):
            texts[k] += f" {word}"
    held = {w: sum(w in t.split() for t in texts) for w in near}
    assert held == often
    licences = [f"Released under the MIT License. mark{k}" for k in range(300)]
    rows = list(enumerate(texts + texts[:700] + licences))
    telling = licenses.fit_licenses(spark.createDataFrame(rows, "doc_id long, text string"))[3]
    assert {w for w in near if w in telling} == {w for w in near if often[w] == 22} and {"mit", "license", "released"} <= set(telling)


def test_license_words_are_cut_once(spark):
    """The pass over the whole corpus cuts its texts into words once, by a class of ranges; the words are those of the plain class."""
    made = spark.createDataFrame([("One of two.\n\nThree",), ("",), (None,), (" \n\n ",), ("...\n\n,",)], "text string")
    windows = licenses.paragraph_windows(made)
    assert sorted(tuple(r.words) for r in windows.collect()) == [("one", "of", "two"), ("three",)]
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1
    assert "[^a-z" not in plan
    each = [chr(c) for c in range(1, 0x3000)] + [chr(c) for c in (0xD7FF, 0xE000, 0xFF10, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    texts = [f"a{x}b 1{x}2 {x}" for x in each] + ["v2.1. 3.x .5 a..b x.-y -"]
    cut = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("low", licenses.F.lower("text")).select("low", licenses._words(licenses.F.col("text")).alias("words"))
    for r in cut.collect():
        assert r.words == [w for w in re.split(r"[^a-z0-9.-]+|\.(?![0-9])", r.low) if w]


def test_license_similarity_equals_brute_force(spark):
    cut = lambda t: [w for w in re.split(r"[^a-z0-9.-]+|\.(?![0-9])", t.lower()) if w]
    pairs = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    rows = [(k, cut(t)[k % 4 :], f) for k, (f, t) in enumerate(licenses.NOTICES)]
    made = spark.createDataFrame(rows, "n int, words array<string>, family string")
    for r in licenses._compared(made).collect():
        of = [pairs(cut(t)) for f, t in licenses.NOTICES if f == r.family]
        assert abs(r.similarity - max(len(x & pairs(r.words)) / len(x) for x in of)) < 1e-9
    long = spark.createDataFrame([([str(k) for k in range(1_000)],)], "words array<string>")
    got = long.select(licenses._windows(licenses.F.col("words")).alias("x")).first().x
    assert [(int(w[0]), len(w)) for w in got] == [(0, 384), (256, 384), (512, 384), (768, 232)]


ITEM = "A train travels 60 km in 2 hours, and then Alice walks 5 km. How far did Alice go in 2 hours?"


def test_leaks(spark, odd, none):
    texts = [
        f"Intro words. {ITEM} More words.",
        "so A train travels 75 km in 3 hours, and then Bob walks 9 km. How far did Bob go in 3 hours?",
        "so A train travels 75 km in 3 hours, and then Bob walks 9 km. How far did Carl go in 8 hours?",
        "A train travels far.", prose(3, 400), prose(3, 3_000) + " " + ITEM + " " + prose(4, 40_000), "five words are here now",
    ]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame([(7, ITEM), (8, "Short one"), (9, "five words are here now"), (10, None), (11, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.changed_slots) for r in decontaminate.leaks(made, bench).collect())
    assert got == [(0, 7, 0), (0, 11, 0), (1, 7, 6), (1, 11, 6), (5, 7, 0), (5, 11, 0), (6, 9, 0)]
    kept = decontaminate.drop_leaking(made, bench)
    assert sorted(r.doc_id for r in kept.where("doc_id < 10").collect()) == [2, 3, 4] and kept.where("doc_id IS NULL").count() == 1
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(made, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaking(odd, bench).columns == odd.columns


def test_leaks_with_names_that_open_sentences(spark):
    texts = [
        "Sara has 7 apples. Sara buys 9 more. How many apples does she have?", "Sara has 7 apples. Bob buys 9 more. How many apples does she have?",
        "Tom has 5 apples Tom buys 3 more How many apples does she have", "Tom went home. Nobody bought any more apples. How many does she have?",
    ]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Tom has 5 apples. Tom buys 3 more. How many apples does she have?"), (2, "Anna Bert Carl Dora Emil")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.changed_slots) for r in decontaminate.leaks(made, bench).collect())
    assert got == [(0, 1, 4), (2, 1, 0)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (ITEM.replace("Alice", "Mary Ann"), True), (ITEM.replace("Alice", "ALICE"), True), (ITEM.replace("Alice", "Élodie"), True), (ITEM.replace("Alice", "Мария"), True),
        (ITEM.replace("2 hours", "half an hour"), True), (ITEM.replace("Alice", "Élodie", 1), False), (ITEM.replace("Alice", "é"), False), (ITEM.replace("2 hours", "two hours"), True),
        (ITEM.replace("60", "twenty three").replace("5 km", "5km"), True), (ITEM.replace("and then ", ""), True),
        (ITEM.replace("How far", "So tell me now, how far"), True), (ITEM.replace("5", "2").replace("60", "2"), False),
        (ITEM.replace("Alice", "Bob", 1), False), (ITEM.replace("2 hours", "2 days", 1), False), (ITEM.replace("walks 5 km", "walks 5 miles"), False),
    ],
)
def test_other_values_in_slots(spark, text, found):
    made = spark.createDataFrame([(1, f"Some words before it. {text} And some after.")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert decontaminate.leaks(made, bench).count() == found


def test_short_items_are_sentences_of_their_own(spark):
    texts = ["We asked. What is DNA? Nobody knew.", "They know what is DNA and more.", "What is DNA?", "What is RNA?", "Yes", "yes and no"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is DNA?"), (2, "Yes."), (3, "..."), (4, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(made, bench).collect()) == [(0, 1), (2, 1), (4, 2)]


def plain_words(text, reading):
    """Canonical words one by one: (what is compared, slot or "", opens a sentence)."""
    tokens, opens = [], True
    for part in re.finditer(r"[^\x20\x09-\x0D]+", text):
        raw = part[0]
        line = "\n" in text[: part.start()][len(text[: part.start()].rstrip(" \t\n\r\x0b\x0c")) :]
        bits = re.findall(r"^\W?[0-9]+|(?<=[0-9])[a-zA-Z%]+[^a-zA-Z%]*|.+", raw) if re.match(r"[^0-9a-zA-Z]?[0-9]+[a-zA-Z%]", raw) else [raw]
        for bit in bits:
            kept = "".join(c for c in bit if c.isalnum() or c == "%")
            tokens.append([kept, opens or line, bit])
            opens, line = bit[-1] in ".!?", False
    out = []
    for k, (kept, starts, bit) in enumerate(tokens):
        if not kept:
            continue
        low = kept.lower()
        near = k and tokens[k - 1][0] and (tokens[k - 1][2][-1].isalnum() or tokens[k - 1][2][-1] == "%") and not starts
        spelled = low in decontaminate.NUMBERS or (low in ("a", "an") and bool(near) and tokens[k - 1][0].lower() == "half")
        kind = "number" if spelled or kept[0].isdigit() else "name" if kept[0].isupper() and len(kept) > 1 and (not starts or reading) else ""
        if not kind and low in decontaminate.UNITS and out and out[-1][1].startswith("number:"):
            kind = "unit"
        if near and out and ((kind == "name" and out[-1][1].startswith("name:")) or (kind == "number" and out[-1][1].startswith("number:") and (spelled or out[-1][3]))):
            out[-1][1] += low
            out[-1][3] = spelled
        else:
            out.append([kind or low, f"{kind}:{low}" if kind else "", starts, spelled])
    return out


def plain_leaks(docs, items):
    found = set()
    for d, text in docs:
        for i, item in items:
            for reading in (0, 1):
                a, b = plain_words(text, reading), plain_words(item, reading)
                size = min(decontaminate.WINDOW, len(b))
                windows = [k for k in range(len(b) - size + 1) if size and 4 * sum(not w[1] for w in b[k : k + size]) >= size]
                hits = [(k, j) for k in windows for j in range(len(a) - size + 1) if [w[0] for w in a[j : j + size]] == [w[0] for w in b[k : k + size]]]
                support = Counter(j - k for k, j in hits)
                for cell in {s + d for s in {(j - k) // 8 for k, j in hits} for d in (0, -1)}:
                    chosen = {}
                    for k, j in hits:
                        if cell * 8 <= j - k < cell * 8 + 16:
                            chosen[k] = min(chosen.get(k, (0, 0)), (-support[j - k], j - k))
                    covered, of = ({k + n for k in x for n in range(size)} for x in (chosen, windows))
                    if not windows or (2 * len(chosen) < len(windows) and 10 * len(covered) < 7 * len(of)):
                        continue
                    pairs = {(b[k + n][1], a[k + s + n][1]) for k, (_, s) in chosen.items() for n in range(size) if b[k + n][1]}
                    numbers = [p for p in pairs if p[0].startswith("number:")]
                    rest = [p for p in pairs if not p[0].startswith("number:")]
                    if len({p[0] for p in pairs}) == len(pairs) and len({p[1] for p in rest}) == len(rest) and 3 * len({p[1] for p in numbers}) >= 2 * len(numbers):
                        found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark):
    made = random.Random(3)
    names, plain = ["Alice", "Bob", "Mary Ann", "NASA", "Élodie", "Мария", "Ōta Ệ"], "the train goes to a town and then home with some red apples for tea".split()

    def sentence():
        return " ".join(made.choice([made.choice(plain)] * 5 + [made.choice(names), str(made.randint(1, 9)), "two", "5km", "7 hours", "half an", "half a"]) for _ in range(made.randint(4, 9))).capitalize() + "."

    items = [(k, " ".join(sentence() for _ in range(made.randint(2, 5)))) for k in range(30)]
    docs = []
    for k in range(160):
        text = items[k % 30][1]
        for _ in range(made.randint(0, 4)):
            words = text.split(" ")
            at = made.randrange(len(words))
            words[at : at + made.randint(0, 1)] = [made.choice([*names, *plain, "3", "five", "9 km"])]
            text = " ".join(words)
        docs.append((k, f"{sentence()} {text} {sentence()}" if k % 5 else " ".join(sentence() for _ in range(6))))
    bench = [x for x in items if len(plain_words(x[1], 0)) >= 8 and len(plain_words(x[1], 1)) >= 8]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    want = plain_leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 60 < len(want) < 400


def test_long_texts_are_read_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = f"{prose(3, 700)} Then Bob has 5km. {ITEM} {prose(4, 900)} In twenty three days Mary Ann Lee 9 kg. {ITEM} So it is. Yes.".encode()
    every = np.full(1 << (decontaminate.FILTER_BITS - 6), 2**64 - 1, np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text.decode()])], ["id", "text"])
    rows = lambda: sorted((r["at"], r["size"], r["hash"], tuple(r["slots"])) for b in decontaminate._hits([batch], [2, 5, 8], every, 3) for r in b.to_pylist())
    whole = rows()
    for size in (64, 700, 3_000):
        monkeypatch.setattr(decontaminate, "LONG", size)
        assert rows() == whole


def test_tokens_equal_tiktoken(spark, odd, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    made, letters = random.Random(1), "aaabcdeё жßé日本😀'’0123456789  \n\t.,!?|²ⅫÅ"
    texts = ["".join(made.choice(letters) for _ in range(made.randint(0, 60))) for _ in range(300)] + ["aaaaaaaaaaaaaaa", "he's they'll we'd   ", " \n\n \t x"]
    rows = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts_by = {r.doc_id: r.text or "" for r in rows.collect()}
    assert bpe.DEFAULT_PATTERN == P.PATTERN
    found = bpe.encode(rows, path, P.PATTERN, decoded=True).collect()
    assert len(found) == rows.count()
    for r in found:
        assert r.ids == enc.encode_ordinary(texts_by[r.doc_id]) and bytes(r.decoded).decode() == texts_by[r.doc_id]
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(rows, path, P.PATTERN), path, P.PATTERN).collect()}
    assert all(back[r.doc_id] == bytes(r.decoded) for r in found)
    one = bpe.token_digest(rows.where("doc_id = 1301"), path, P.PATTERN).first()
    ids = enc.encode_ordinary(texts_by[1301])
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts_by[1301].encode()).hexdigest())
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_word_table_equals_tiktoken(spark, none):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [prose(k % 7, 40) for k in range(60)] + ["naïve café 日本語 ９", "", None]
    counted = bpe.corpus_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), ranks, P.PATTERN)
    words = bpe.word_table(counted, ranks, P.PATTERN, words_a_task=50)
    import regex

    want = Counter(w for t in texts for w in regex.findall(P.PATTERN, t or ""))
    rows = words.collect()
    assert {r.word: r.n for r in rows} == want and len(rows) == len(want)
    assert all(r.ids == enc.encode_ordinary(r.word) for r in rows)
    for most in (5, 40, 10_000):
        hot = {r.word: r.n for r in bpe.frequent(counted, most).collect()}
        least = min(hot.values(), default=max(want.values()) + 1)
        assert len(hot) <= most and hot == {w: n for w, n in want.items() if n >= least}
        below = max((n for n in want.values() if n < least), default=0)
        assert len(hot) == len(want) or sum(n >= below for n in want.values()) > most
    known = bpe._known(bpe.word_table(bpe.frequent(counted, 40), ranks, P.PATTERN))
    assert set(known[0]) == {r.word for r in bpe.frequent(counted, 40).collect()} and known[2].sum() == len(known[1])
    large = spark.createDataFrame([(f"w{k}", 1000 + 37 * k) for k in range(300)], "word string, n long")
    assert 60 < bpe.frequent(large, 100).count() <= 100 and bpe.frequent(large, 100).agg({"n": "max"}).first()[0] == 1000 + 37 * 299
    assert bpe._known(bpe.word_table(bpe.frequent(bpe.corpus_words(none, ranks, P.PATTERN), 5), ranks, P.PATTERN))[0] == []


def test_forgetting_words_changes_nothing():
    replay = bpe.MergeReplay(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, most_words=3)
    texts = [prose(k, 30) for k in range(5)]
    first = [x.tolist() for x in replay.encode(texts)]
    assert first == [replay.encode([t])[0].tolist() for t in texts]
