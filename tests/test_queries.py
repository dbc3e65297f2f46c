"""Every registered query of the library against its SQL twin at the smallest size."""

import glob
import hashlib
import os
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

from catalogmatch.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    same = lambda v: None if v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(names), sorted(repr(tuple(same(r[k]) for k in order)) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    found = sql.execute(ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_shortlists_are_made_for_every_question_that_has_a_vector(spark, sql):
    asked = {r[0] for r in sql.execute("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)").fetchall()}
    got = QUERIES["i2_shortlists"](spark, SF).collect()
    assert {r.question_id for r in got} == {r[0] for r in sql.execute(ORACLES["i2_shortlists"]).fetchall()} == asked
    assert {r.question_id for r in got if r.slug == f"p-{r.question_id}" and r.position == 1} >= {k for k in asked if k % 60 == 0}


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(ORACLES) == {"h3_blake_vectors", "h1_normalize_exactly"}


def plain_normalized(value):
    from catalogmatch.functions.text import LETTERS, SPELLED

    low = unicodedata.normalize("NFKC", value).lower()
    spelled = "".join(SPELLED.get(c) or dict(zip(*LETTERS)).get(c, c) for c in low)
    return re.sub("[^a-z0-9]+", " ", spelled).strip()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_exact_normalisation_and_blake_vectors(spark):
    texts = {r.conv_id * 1000 + r.turn: f"{r.text} ﬁn Ⅻ ９ ½ {r.role}" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = QUERIES["h1_normalize_exactly"](spark, SF).collect()
    assert len(got) == len(texts) and all(r.text == plain_normalized(texts[r.id]) for r in got)
    want = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        text, sums = plain_normalized(r.text), Counter()
        padded = f" {text} "
        for gram in (padded[i : i + n] for n in range(2, 6) for i in range(len(padded) - n + 1)) if text else ():
            number = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
            sums[number % 512] += 1 if number >> 63 else -1
        norm = sum(v * v for v in sums.values()) ** 0.5
        want |= {(r.item_id, b): round(v / norm, 6) for b, v in sums.items() if v}
    found = {(r.item_id, r.bucket): r.value for r in QUERIES["h3_blake_vectors"](spark, SF).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
