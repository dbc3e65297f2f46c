"""Exact copies, near copies, components and sharding against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import prose

from catalogmatch.llm import exact, graph, minhash, sharding
from catalogmatch.llm.common import batch_shingles, shingles, word_hashes

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), (i == keep) if known and i is not None else not known, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_groups(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(9, "one  two"), (8, "one two"), (7, "one\ttwo "), (6, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, exact.exact_groups(made, piece=64).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute_exact(rows)
    assert exact.exact_groups(none).count() == 0
    kept = exact.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 102").count() == 0 and kept.where("doc_id = 101").count() == 1


def test_equal_fingerprints_of_different_texts_are_told_apart(spark):
    rows = [(k, f"text {k % 5}") for k in range(30)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact.exact_groups(made, primes=(3, 2), bases=(1, 1))
    got = sorted(map(tuple, weak.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute_exact(rows)


def test_many_rows_without_id_and_clashing_columns(spark):
    rows = [(None, f"text {k % 3}  end") for k in range(2_000)] + [(k, f"text {k % 3} end") for k in range(2)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, exact.exact_groups(made).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute_exact(rows)
    other = made.selectExpr("doc_id", "text", "1 AS gone_id", "'x' AS gone_sha", "2 AS keep_id", "3 AS k", "'y' AS piece", "true AS kept", "4 AS group_size")
    kept = exact.drop_exact_copies(other)
    assert kept.columns == other.columns and kept.count() == 2 + sum(t == "text 2  end" for _, t in rows)


def test_fingerprints_combine(spark):
    text = prose(3, 5_000)
    made = spark.createDataFrame([(1, text), (1, text), (2, text[:700])], "doc_id long, text string")
    whole = sorted(map(tuple, exact.fingerprints(made).collect()))
    assert whole == sorted(map(tuple, exact.fingerprints(made, piece=997).collect())) and len(whole) == 3


def test_shingles_agree_and_follow_words():
    texts = [b"", b"  ", b"A b", b"a B c d e f", "é É x".encode(), prose(1, 900).encode(), b"x" * 400_000 + b" y z w v u"]
    for one, two in zip(batch_shingles(texts), map(shingles, texts)):
        assert (one == two).all() and len(one) == len(two)
    assert len(word_hashes(b"A a\x0ba")) == 3 and len(set(word_hashes(b"A a\x0ba").tolist())) == 1
    words = prose(1, 900).split()
    assert len(shingles(" ".join(words).encode())) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})


def brute_near(rows):
    sets = []
    for i, t in rows:
        words = [w for w in SPACE.split("".join(c.lower() if c.isascii() else c for c in t or "")) if w]
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and i is not None and j is not None and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=repr)


def test_near_groups(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    base = prose(2, 120).split()
    for k in range(60):  # copies with changed words around the threshold, and a chain
        words = list(base)
        for j in range(k % 9):
            words[(k * 7 + j * 13) % len(words)] = f"new{k}x{j}"
        rows.append((k, " ".join(words)))
    rows += [(60 + k, " ".join(prose(9, 200).split()[k * 8 : k * 8 + 90])) for k in range(10)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_groups(made).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute_near(rows)
    assert minhash.near_groups(none).count() == 0
    kept = minhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_estimates_are_corrected_for_chance():
    family, made = minhash._family(1), np.random.default_rng(0)
    both = made.integers(0, 2**64, 900, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        n = round(900 * share)
        other = np.unique(np.concatenate([both[:n], made.integers(0, 2**64, 900 - n, dtype=np.uint64)]))
        true = n / (900 + len(other) - n)
        got = minhash.similarity(minhash.packed(minhash.minima(both, family)), minhash.packed(minhash.minima(other, family)))
        assert abs(got - true) < 0.16


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (7, 9), (20, 10), (20, 11), (11, 12), (1, 2)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 10: 10, 11: 10, 12: 10, 20: 10}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, odd, none, tmp_path):
    rows = [(k, prose(k % 90, 5 + k % 40)) for k in range(400)] + [(1000 + k, "a hot text " * 3) for k in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.where("doc_id <> 108").select("doc_id", "text"))
    got = sharding.shard(made).collect()
    assert len(got) == made.count() and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in made.collect())
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(8))
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    split = [k for k, v in homes.items() if len(v) > 1]
    assert len(split) == 1  # only the group that no shard can hold
    assert sharding.shard(none).count() == 0
    for docs in (odd, odd.selectExpr("doc_id", "text", "1 AS shard", "'x' AS slot", "2 AS home_id", "3 AS size")):
        path = str(tmp_path / docs.columns[2])
        home = sharding.write_shards(docs, path)
        back = spark.read.parquet(path)
        assert back.count() == odd.count() and set(back.columns) == {*docs.columns, home}


def test_groups_are_packed_one_by_one(spark):
    rows = [(k, prose(k % 70, 3 + k % 90)) for k in range(300)] + [(1000 + k, "a hot text") for k in range(150)]
    got = {r.doc_id: r for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), fineness=8).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    of = {t: np.array([len(ids) * (len(t) + 1), len(ids) * len(t.split()), len(ids)], float) for t, ids in groups.items()}
    total = sum(of.values())
    share = {t: v / total * 8 for t, v in of.items()}
    homes = {t: {got[i].shard for i in ids} for t, ids in groups.items()}
    assert all(len(x) == 1 for x in homes.values())  # no group has more bytes than a shard
    left = np.ones((8, 3))
    key = {r.text: r.grp for r in sharding.measured(spark.createDataFrame(rows, "doc_id long, text string")).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").select("text", "grp").distinct().collect()}
    large = sorted((t for t in of if max(share[t]) > 1 / 8), key=lambda t: (-max(share[t]), key[t]))
    for t in large:
        best, fits = left @ (share[t] * sharding.WEIGHTS), left[:, 0] >= share[t][0]
        best = np.where(fits, best, -np.inf) if fits.any() else best
        at = homes[t].pop()
        assert best[at] >= best.max() - 1e-9
        left[at] -= share[t]
    rest = [t for t in of if t not in large]
    free = np.maximum(left, 1e-9)
    free = free / free.sum(axis=0) * 8
    own = sum(of[t] for t in rest)
    for t in sorted(rest, key=lambda t: (-max(of[t] / own), key[t])):
        item = of[t] / own * 8
        best, fits = free @ (item * sharding.WEIGHTS), free[:, 0] >= item[0]
        best = np.where(fits, best, -np.inf) if fits.any() else best
        at = homes[t].pop()
        assert best[at] >= best.max() - 1e-9
        free[at] -= item


def test_pack_keeps_dimensions_level():
    made = np.random.default_rng(1).lognormal(size=(3000, 3))
    load = np.zeros((8, 3))
    np.add.at(load, sharding.pack(made / made.sum(axis=0) * 8, np.ones((8, 3))), made)
    assert (load.max(axis=0) / load.min(axis=0)).max() < 1.05


def test_rows_without_id_that_share_a_text_are_numbered_in_many_cells(spark):
    made = spark.createDataFrame([(None, "one hot text")] * 900 + [(k, prose(k, 9)) for k in range(60)], "doc_id long, text string").repartition(5)
    for how in ({"cells": 16}, {"cells": 1, "rows_a_cell": 7}):
        got = sharding.shard(made, **how)
        slots = defaultdict(list)
        for r in got.collect():
            slots[r.shard].append(r.slot)
        assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
