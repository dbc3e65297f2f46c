"""Signature trees and versions of feature tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from catalogmatch.sources.files import SignatureTree, levels_for
from catalogmatch.sources.versions import FeatureVersions


def nodes(tree):
    return sorted(map(tuple, tree.nodes.select("level", "node", "n", "digest").collect()))


def plain_root(rows, levels):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    groups = {}
    for key, text in sorted({*rows}):
        place = hashlib.md5(key.encode()).hexdigest()
        groups.setdefault(place[:levels], []).append(f"{key}:{digest(text or '')}:{rows.count((key, text))}")
    level = {k: digest("\n".join(sorted(v))) for k, v in groups.items()}
    for k in range(levels, 0, -1):
        up = {}
        for node in sorted(level):
            up.setdefault(node[: k - 1], []).append(f"{node}:{level[node]}")
        level = {n: digest("\n".join(v)) for n, v in up.items()}
    return level.get("", digest(""))


def test_tree_equals_plain_and_updates_equal_rebuilds(spark):
    rng = random.Random(2)
    rows = [(f"k{k}", f"text {rng.randrange(50)}") for k in range(700)] + [("", None), ("k1", "second text of a key"), ("k2", "x"), ("k2", "x")]
    shape = "slug string, text string"
    tree = SignatureTree.of(spark.createDataFrame(rows, shape))
    assert tree.levels == levels_for(703) == 2 and tree.root().first().signature == plain_root(rows, 2)
    assert tree.nodes.where("level < 2").selectExpr("max(n)").first()[0] <= 16
    changed = [("k5", "new"), ("k6", "new"), ("fresh", "x"), ("k2", "one")]
    gone = [("k7",), ("k8",), ("never was",)]
    after = [r for r in rows if r[0] not in {"k5", "k6", "k2", "k7", "k8"}] + changed
    updated = tree.updated(spark.createDataFrame(changed, shape), spark.createDataFrame(gone, "slug string"))
    assert nodes(updated) == nodes(SignatureTree.of(spark.createDataFrame(after, shape), levels=2))
    emptied = updated.updated(spark.createDataFrame([], shape), spark.createDataFrame([(k,) for k in {r[0] for r in after}], "slug string"))
    assert emptied.nodes.count() == 0 and emptied.root().first().signature == plain_root([], 2)
    assert SignatureTree.of(spark.createDataFrame([], shape)).root().first().signature == plain_root([], 0)


def test_a_node_that_is_too_full_is_an_error(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("slug"), F.lit("x").alias("text"))
    with pytest.raises(Exception, match="too many rows"):
        SignatureTree.of(rows, levels=0).root().first()


def test_a_tree_of_fixed_depth_holds_any_corpus(spark):
    rows = [(f"k{k}", f"t{k % 7}") for k in range(3000)]
    tree = SignatureTree.of(spark.createDataFrame(rows, "slug string, text string"), levels=1, most=None)
    assert tree.root().first().signature == plain_root(rows, 1) and tree.nodes.selectExpr("max(n)").first()[0] > 128
    more = [(f"n{k}", "x") for k in range(200)]
    updated = tree.updated(spark.createDataFrame(more, "slug string, text string"))
    assert updated.root().first().signature == plain_root(rows + more, 1)


def test_versions_redo_nothing_that_is_unchanged(spark, tmp_path):
    known = FeatureVersions(spark, str(tmp_path / "v"))
    rows = lambda **x: spark.createDataFrame(list(x.items()), "slug string, hash string")
    todo = lambda df: {r.slug: (r.action, r.reason) for r in df.collect()}
    size = {"image": "384", "source": "s1"}
    one, two, three = rows(a="1", b="2", c="3"), rows(a="1", b="9", d="4", n=None), rows(a="1", b="2", d="5", c="3", n=None)
    assert todo(known.worklist(one, size)) == {k: ("recompute", "new") for k in "abc"}
    assert known.commit(one, size) == 1 and todo(known.worklist(one, size)) == {}
    assert todo(known.worklist(two, size)) == {"b": ("recompute", "changed"), "c": ("drop", "gone"), "d": ("recompute", "new"), "n": ("recompute", "new")}
    assert known.commit(two, size) == 2 and known.commit(two, size) == 2  # nothing has changed
    assert known.deltas(2, 2).count() == 4
    assert known.commit(three, size) == 3
    assert {tuple(r) for r in known.state().collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "5"), ("n", "")}
    assert {tuple(r) for r in known.state(1).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert {tuple(r) for r in known.changes(1, 3).collect()} == {("d", "recompute"), ("n", "recompute")}  # b and c are as they were
    assert {tuple(r) for r in known.changes(2, 3).collect()} == {("b", "recompute"), ("c", "recompute"), ("d", "recompute")}
    other = {"image": "512", "source": "s1"}
    assert todo(known.worklist(rows(a="1", z="0"), other)) == {"a": ("recompute", "image"), "z": ("recompute", "new"), **{k: ("drop", "gone") for k in "bcdn"}}
    (tmp_path / "v" / "rows" / "half-written").mkdir()  # a version without a commit does not exist
    assert FeatureVersions(spark, str(tmp_path / "v")).last().version == 3
