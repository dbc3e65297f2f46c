"""The spelling table in the JVM against plain Python, and the stored search index."""

import random

from pyspark.sql import functions as F

from catalogmatch.functions.spelling import normalize_spelled, spelled, spelling_table
from catalogmatch.operators import catalog
from catalogmatch.operators.search_index import SearchIndex


def plain(text, table):
    out, at, longest = [], 0, max(map(len, table))
    while at < len(text):
        for n in range(longest, 0, -1):
            if text[at : at + n] in table:
                out.append(table[text[at : at + n]])
                at += n
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_the_longest_source_wins_and_all_of_the_table_is_used(spark):
    table = spelling_table()
    rng = random.Random(9)
    sources = sorted(table)
    texts = ["".join(rng.choice(sources) if rng.random() < 0.5 else rng.choice("abc 9,.-中🙂") for _ in range(40)) for _ in range(150)] + sources[::7] + ["", "plain ascii", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.s for r in rows.select("id", spelled(F.col("text")).alias("s")).collect()}
    low = {r.id: r.s for r in rows.select("id", F.lower("text").alias("s")).collect()}
    assert got == {k: None if t is None else plain(low[k], table) for k, t in enumerate(texts)}


def test_names_in_many_scripts(spark):
    names = {"Щука й ёж": "shchuka i ezh", "ΩΜΈΓΑ": "omega", "Łódź": "lodz", "きゃっと カッパ": "kyatto kappa", "თბილისი": "tbilisi", "ﬁn Ⅻ ９ ½": "fin xii 9 1 2", "Việt": "viet", "𝓪㎏ №": "akg no", "«—»": "", "i̇": "i"}
    rows = spark.createDataFrame(list(names.items()), "text string, want string")
    assert [(r.text, r.got) for r in rows.select("text", "want", normalize_spelled(F.col("text")).alias("got")).collect()] == list(names.items())


def test_another_table(spark):
    rows = spark.createDataFrame([("a.b*c^d]",)], "text string")
    own = {"a.": "1", "b": "two", "*": "", "^": "-", "d]": "END"}
    assert rows.select(spelled(F.col("text"), own).alias("s")).first().s == "1twoc-END"
    assert rows.select(spelled(F.col("text"), {}).alias("s")).first().s == "a.b*c^d]"


def test_a_page_of_the_stored_index_stops_early(spark, tmp_path):
    rows = [(f"s{k}", k, f"Rosso {'riserva' if k % 50 == 7 else 'di'} b{k}", "w", "red" if k % 2 else "", "r", "g") for k in range(300)]
    cards = spark.createDataFrame(rows, "slug string, pos long, name string, winery string, category string, region string, grapes string")
    index = SearchIndex.write(cards.where("pos < 200"), str(tmp_path / "i"), 10).append(cards.where("pos >= 200"), 10)
    queries = spark.createDataFrame([(1, "rosso", ""), (2, "RISERVA rosso", "red"), (3, "", "red"), (4, None, None), (5, "b1", ""), (6, "nowhere", ""), (7, "di", "red"), (8, "  ", "")], "query_id int, query string, category string")
    want = sorted(map(tuple, catalog.token_search(cards, queries).select("query_id", "slug", "pos").collect()))
    assert sorted(map(tuple, index.search(queries).select("query_id", "slug", "pos").collect())) == want and len(want) > 900
    for offset, limit in ((0, 4), (3, 5), (250, 100)):
        page = catalog.paged(catalog.token_search(cards, queries), offset, limit).select("query_id", "n", "slug", "pos").collect()
        assert sorted(map(tuple, index.page(queries, offset, limit).collect())) == sorted(map(tuple, page))
    read = []
    hits = SearchIndex._hits
    index._hits = lambda rarest, wanted, segments=None: read.append((segments, wanted.count())) or hits(index, rarest, wanted, segments)
    assert index.page(queries.where("query_id IN (1, 7)"), 0, 4).count() == 8 and read == [([0], 2)]
    read.clear()
    assert index.page(queries.where("query_id IN (1, 2)"), 0, 4).count() == 8
    assert [(len(s), n) for s, n in read] == [(1, 2), (1, 1), (2, 1), (4, 1), (8, 1), (14, 1)][: len(read)] and len(read) > 3


def test_search_broadcasts_nothing_and_its_index_has_few_folders(spark, tmp_path):
    """Repeated texts make small files of many cards: file sizes must choose no join, and segments no folders."""
    cards = spark.range(400).select(
        F.concat(F.lit("s"), "id").alias("slug"), F.col("id").alias("pos"), F.concat(F.lit("rosso b"), (F.col("id") % 9).cast("string")).alias("name"), *(F.lit("x").alias(c) for c in ("winery", "category", "region", "grapes"))
    )
    queries = spark.createDataFrame([(1, "rosso b1", ""), (2, "ROSSO b2", "x"), (3, "osso", "y")], "query_id int, query string, category string")
    found = catalog.token_search(cards, queries)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.pos) for r in found.collect()) == sorted((q, k) for q in (1, 2) for k in range(400) if k % 9 == q)
    index = SearchIndex.write(cards, str(tmp_path / "i"), 4)
    assert len(list((tmp_path / "i" / "cards").glob("*=*"))) == 8  # of 100 segments
    assert sorted(r.pos for r in index.page(queries.where("query_id = 2"), 1, 3).collect()) == [11, 20, 29]
