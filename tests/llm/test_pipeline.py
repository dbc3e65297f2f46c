"""The pipeline's stages on special cases, and its run against a plainer version of its decisions."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("place", range(5))
def test_stages_take_special_cases(spark, odd, none, place):
    _, stage = corpus_pipeline.STAGES[place]
    for docs in (odd, none):
        out = stage(spark, docs, SF)
        if place < 4:
            assert out.columns == docs.columns
        assert out.count() <= docs.count()


CLASHES = "id key n k row gone gone_id gone_sha text_sha256 keep_id group_size piece hash words ids size shard slot grp part units tails label score stats head node component_id bands kind family line".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three four five six. token=abcdefgh12"), (1, "one two three four five six. token=abcdefgh12"), (2, "Released under the MIT License."), (3, None), (None, ""), (4, "one  two three four five six. token=abcdefgh12")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *(f"{k} AS {name}" for k, name in enumerate(CLASHES)))


@pytest.mark.parametrize("place", range(5))
def test_stages_pass_clashing_columns_through(spark, clashing, place):
    out = corpus_pipeline.STAGES[place][1](spark, clashing, SF)
    if place < 4:
        assert out.columns == clashing.columns
        assert all([r[name] for name in CLASHES] == list(range(len(CLASHES))) for r in out.collect())
    assert 0 < out.count() <= clashing.count()


def test_operators_take_clashing_columns(spark, clashing):
    from catalogmatch.llm import decontaminate, exact, licenses, lm, minhash, secrets, sharding, toxicity

    n = clashing.count()
    labels = clashing.selectExpr("doc_id", "cast(doc_id = 2 AS int) AS toxic")
    counts = (
        exact.exact_groups(clashing).count(), minhash.near_groups(clashing).count(), sharding.shard(clashing).count(), secrets.secret_report(clashing).count(),
        licenses.license_report(clashing).count(), lm.score_documents(clashing, n_words=lm.WIDTH).count(), toxicity.fit_toxicity(clashing, labels).score(clashing).count(),
    )
    assert counts == (n,) * 7
    bench = clashing.where("doc_id = 1").selectExpr("doc_id AS item_id", "text", "1 AS id", "2 AS hash")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(clashing, bench).collect()} == {(1, 1), (4, 1)}


def test_run_follows_the_operators(spark):
    from catalogmatch.llm.decontaminate import leaks
    from catalogmatch.llm.exact import exact_groups
    from catalogmatch.llm.minhash import near_groups
    from catalogmatch.llm.quality import fit_quality

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    left = docs.where(docs.doc_id.isin(ids(fit_quality(docs, labels).score(docs).where("score >= 0.3"))))
    left = left.where(left.doc_id.isin(ids(exact_groups(left).where("kept"))))
    left = left.where(left.doc_id.isin(ids(near_groups(left).where("kept"))))
    left = ids(left) - ids(leaks(left, bench))
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == left and 0 < len(left) < docs.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_registered_queries_and_sql():
    from catalogmatch.llm.registry import ORACLES, QUERIES

    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
