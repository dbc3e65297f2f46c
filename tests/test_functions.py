"""Column functions and operators on small inputs whose results are known."""

import math

import pytest
from pyspark.sql import functions as F

from catalogmatch.functions import filters, geometry, text, vectors
from catalogmatch.operators import vector_index, catalog, detections, history, metrics, mining, pairing, resolve, retrieval
from catalogmatch.sources import catalog as sources
from catalogmatch.sources import files


def boxes(spark, rows):
    rows = [(*r[:3], *map(float, r[3:])) for r in rows]
    made = spark.createDataFrame(rows, "image_id int, det_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    return made.withColumn("box", F.struct("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


def frame100(spark):
    return spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "image_id int, width int, height int")


def test_catalog_reader_and_checks(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text('﻿slug,name,category,winery\nred,"A ""big"", name\nin two lines",Красное,\nwhite,B,Белое,В\nred,C,Красное,А\na/b,D,,Б\n', encoding="utf-8")
    cards = sources.read_catalog(spark, str(path))
    rows = {r.pos: r for r in sources.checked_catalog(cards).collect()}
    first = [rows[k] for k in sorted(rows)]
    assert [r.reason for r in first] == [None, None, "repeated_slug", "separator_in_slug"]
    assert first[0].name == 'A "big", name\nin two lines' and first[0].winery == "" and first[0].region == ""
    good, bad = sources.split_catalog(cards)
    assert (good.count(), bad.count()) == (2, 2)
    with pytest.raises(Exception, match="unusable catalog row"):
        sources.strict_catalog(cards).collect()
    assert sources.is_empty_catalog(cards.limit(0)).first().empty
    url = sources.with_urls(spark.createDataFrame([("a b/ü~",)], "slug string")).first()
    assert url.image_url == "/api/catalog/a%20b/%C3%BC~/image"


def test_profiles_last_line_wins(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"slug":"a","profile":{"body":"1"},"problems":[]}\n{"slug":"a","profile":{"body":"2"},"problems":[]}\n{"slug":"a","profile":{"body":"3"},"problems":["x"]}\n{"slug":"z","profile":{"body":"4"},"problems":[]}\n')
    cards = spark.createDataFrame([("a",)], "slug string")
    assert [(r.slug, r.profile.body) for r in sources.usable_profiles(sources.read_profiles(spark, str(path)), cards).collect()] == [("a", "2")]


def test_images_and_gallery(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    for name in ("x.PNG", "y.txt", "refs/a.jpg", "refs/b.webp"):
        (tmp_path / name).write_bytes(b"\xff\xd8\xff" + name.encode())
    images = sources.read_images(spark, str(tmp_path))
    assert images.count() == 3
    gallery, repeated = sources.gallery_files(images)
    assert [r.slug for r in gallery.collect()] == ["a", "b"] and repeated.count() == 0
    assert sources.required_images(images).count() == 3
    with pytest.raises(Exception, match="no images found"):
        sources.required_images(images.limit(0))
    assert {r.f for r in images.select(files.image_format(F.col("content")).alias("f")).collect()} == {"JPEG"}
    sums = files.with_sha256(images)
    expected = sums.withColumn("sha256", F.when(F.col("path").endswith("x.PNG"), "0").otherwise(F.col("sha256")))
    assert sorted(r.status for r in files.manifest_status(expected, sums).collect()) == ["match", "match", "mismatch"]


def test_corpus_signature_follows_content_not_order(spark):
    a = spark.createDataFrame([("b", "2"), ("a", "1")], "slug string, text string")
    b = a.orderBy("slug").repartition(3)
    changed = a.withColumn("text", F.concat("text", F.lit("!")))
    for parts in (None, 4):
        one, two, three = (files.corpus_signature(x, parts=parts).first().signature for x in (a, b, changed))
        assert one == two != three


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("Красное сухое вино", ("Красное", None, ["сухое", "брют", "экстра брют", "брют натюр"], False)),
        ("не игристое белое", ("Белое", False, None, False)),
        ("Игристое розе к торту", ("Розовое", True, ["сладкое", "полусладкое"], False)),
        ("полусладкое к мясу", (None, None, ["полусладкое"], False)),
        ("Утка с вишнёвым соусом", (None, None, None, True)),
        ("к сыру", (None, None, None, False)),
        ("", (None, None, None, False)),
    ],
)
def test_read_filters(spark, question, expected):
    row = spark.createDataFrame([(question,)], "q string").select(filters.read_filters(F.col("q")).alias("f")).first().f
    assert (row.category, row.sparkling, row.sweetness, row.not_sweet) == expected


def test_allowed_null_rules(spark):
    rows = spark.createDataFrame([("Белое", None, None), ("Белое", True, "сухое"), ("Белое", False, "сладкое")], "category string, sparkling boolean, sweetness string")
    ask = lambda q: [r.ok for r in rows.select(filters.allowed(filters.read_filters(F.lit(q)), F.col("category"), F.col("sparkling"), F.col("sweetness")).alias("ok")).collect()]
    assert ask("не игристое") == [True, False, True]
    assert ask("сухое") == [False, True, False]
    assert ask("к мясу") == [True, True, False]
    assert ask("красное") == [False, False, False]


def test_text_normalisation_and_ngrams(spark):
    rows = spark.createDataFrame([(1, "Шато Тамань"), (2, "shato taman"), (3, ""), (4, None)], "id int, t string")
    found = {r.id: r.n for r in rows.select("id", text.normalize_text(F.col("t")).alias("n")).collect()}
    assert found == {1: "shato taman", 2: "shato taman", 3: "", 4: None}
    exact = {r.id: r.n for r in rows.select("id", text.normalize_exactly()(F.col("t")).alias("n")).collect()}
    assert exact == found
    for kind in ("md5", "blake2b"):
        vecs = {r.id: r.vec for r in text.densified(text.ngram_vectors(rows, "id", "t", hash=kind), "id").collect()}
        assert set(vecs) == {1, 2} and abs(sum(x * y for x, y in zip(vecs[1], vecs[2])) - 1) < 1e-9


def test_blake_buckets_match_hashlib(spark):
    import hashlib

    row = spark.createDataFrame([("ab",)], "t string").select(text.hashed_token(F.col("t"), 512, "blake2b").alias("h")).first().h
    number = int.from_bytes(hashlib.blake2b(b"ab", digest_size=8).digest(), "little")
    assert (row.bucket, row.sign) == (number % 512, 1.0 if number >> 63 else -1.0)


def test_geometry(spark):
    row = spark.range(1).select(F.struct(*(F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 10.0), ("y2", 10.0)))).alias("a"), F.struct(*(F.lit(v).alias(n) for n, v in (("x1", 5.0), ("y1", 0.0), ("x2", 15.0), ("y2", 10.0)))).alias("b"))
    got = row.select(
        geometry.iou(F.col("a"), F.col("b")).alias("iou"), geometry.point_distance(F.lit(13.0), F.lit(14.0), F.col("a")).alias("d"), geometry.padded_box(F.col("b"), F.lit(15), F.lit(12), 0.1).alias("p"),
        geometry.axis_distance(F.col("a"), F.lit(100)).alias("x"),
    ).first()
    assert abs(got.iou - 1 / 3) < 1e-9 and got.d == 5.0 and tuple(got.p) == (4, 0, 15, 11) and abs(got.x - 0.45) < 1e-9
    with pytest.raises(Exception, match="width must be positive"):
        row.select(geometry.axis_distance(F.col("a"), F.lit(0))).collect()


def test_target_selection(spark):
    rows = boxes(spark, [(1, 1, 1, 0.80, 0, 0, 10, 10), (1, 2, 1, 0.70, 45, 0, 55, 10), (2, 1, 1, 0.80, 30, 0, 50, 40), (2, 2, 1, 0.79, 52, 0, 72, 40), (2, 3, 1, 0.2, 45, 0, 55, 9)])
    chosen = detections.select_targets(detections.scored(rows, frame100(spark)))
    assert sorted((r.image_id, r.det_id, r.place, r.ambiguous) for r in chosen.collect()) == [(1, 2, 1, False), (2, 1, 1, True), (2, 2, 2, True)]
    twins = boxes(spark, [(1, 1, 0, 0.9, 40, 0, 60, 50), (1, 2, 0, 0.89, 40, 1, 60, 51)])
    assert detections.select_targets(detections.scored(twins, frame100(spark)), detections.BOTTLES).count() == 1


def test_the_last_bit_of_a_score_decides_nothing(spark):
    """Mirrored boxes tie though their distances differ in the last bit; a gap of 0.06 is one, though 0.06 + e less e is more."""
    rows = boxes(spark, [(1, 1, 1, 0.72, 50.1, 0, 60.1, 10), (1, 2, 1, 0.72, 39.9, 0, 49.9, 10), (2, 1, 1, 0.06, -5, 0, 5, 10), (2, 2, 1, 0.0, -5, 20, 5, 30)])
    chosen = detections.select_targets(detections.scored(rows, frame100(spark))).collect()
    assert sorted((r.image_id, r.det_id, r.place, r.ambiguous) for r in chosen) == [(1, 1, 1, True), (1, 2, 2, True), (2, 1, 1, True), (2, 2, 2, True)]
    assert sorted((r.image_id, r.view, r.label_det) for r in detections.views(frame100(spark), rows).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    assert {r.image_id: r["mode"] for r in detections.selection_modes(frame100(spark), rows).collect()} == {1: "ambiguous_two_pairs", 2: "ambiguous_two_pairs"}


def test_pairing_of_labels_and_bottles(spark):
    labels = boxes(spark, [(1, 9, 1, 0.9, 40, 40, 60, 60), (2, 9, 1, 0.9, 0, 0, 4, 4)])
    bottles = boxes(spark, [(1, 1, 0, 0.9, 0, 0, 100, 100), (1, 2, 0, 0.5, 35, 30, 65, 90), (2, 3, 0, 0.9, 50, 50, 60, 60), (2, 4, 0, 0.9, 20, 20, 30, 30)])
    found = {r.image_id: r.bottle_det for r in detections.pair_bottles(labels, bottles).collect()}
    assert found == {1: 2, 2: 4}
    assert detections.pair_bottles(labels, bottles.limit(0)).where("bottle_det IS NULL").count() == 2


def test_views_without_labels_and_without_boxes(spark):
    rows = boxes(spark, [(1, 1, 0, 0.6, 40, 0, 60, 50)])
    found = {r.image_id: (r.view, r.label_det, r.bottle_det, r.bottle_mode) for r in detections.views(frame100(spark), rows).collect()}
    assert found == {1: (1, None, 1, "original_low_bottle_confidence"), 2: (1, None, None, "original_no_bottle")}
    modes = {r.image_id: r.mode for r in detections.selection_modes(frame100(spark), rows).collect()}
    assert modes == {1: "no_label_detection", 2: "no_label_detection"}


CARDS = [("red", 0, "Каберне", "Красное", "А"), ("white", 1, "Рислинг брют", "Белое", "Б"), ("rose", 2, "Розе", "Розовое", "В"), ("white2", 3, "Шардоне", "Белое", "Б")]


def cards(spark):
    made = spark.createDataFrame(CARDS, "slug string, pos long, name string, category string, winery string")
    return made.withColumns({c: F.lit("") for c in ("region", "grapes", "description")})


def test_search_paging_facets_featured(spark):
    assert [r.slug for r in catalog.search_one(cards(spark), "б").collect()] == ["red", "white", "white2"]
    assert [r.slug for r in catalog.search_one(cards(spark), "", "Белое", 1, 5).collect()] == ["white2"]
    queries = spark.createDataFrame([(1, "рислинг Б", ""), (2, "", "Белое"), (3, "нет такого", ""), (4, None, None)], "query_id int, query string, category string")
    found = catalog.token_search(cards(spark), queries)
    assert sorted((r.query_id, r.slug) for r in found.collect()) == [(1, "white"), (2, "white"), (2, "white2"), (4, "red"), (4, "rose"), (4, "white"), (4, "white2")]
    page = catalog.paged(found, 1, 2).where("query_id = 4").orderBy("n").collect()
    assert [(r.slug, r.total) for r in page] == [("white", 4), ("rose", 4)]
    facets = catalog.facets(cards(spark)).first()
    assert (facets.total, facets.categories, facets.n_wineries) == (4, ["Белое", "Красное", "Розовое"], 3)
    assert [r.slug for r in catalog.featured(cards(spark)).orderBy("place").collect()] == ["white", "white2"]
    assert [r.slug for r in catalog.featured(cards(spark), ("нет",), 2).orderBy("place").collect()] == ["red", "white"]


def test_recommend(spark):
    requests = spark.createDataFrame([(1, "fish", "any"), (2, "fish", "red"), (3, "meat", "sparkling"), (4, "dessert", "any")], "request_id int, dish string, preference string")
    got = {(r.request_id, r.place): r.slug for r in pairing.recommend(cards(spark), requests).collect()}
    assert got == {(1, 1): "white", (2, 1): "red", (3, 1): "white", (4, None): None}
    assert {r.request_id: r.question for r in pairing.pairing_question(requests).collect()}[2] == "Подбери красное вино к рыбе и морепродуктам."


@pytest.mark.parametrize(
    ("candidates", "abstain", "margin", "expected"),
    [
        ([("a", 0.91), ("b", 0.05)], False, 0.0, ("matched", "a")),
        ([("a", 0.50), ("b", 0.45)], False, 0.1, ("uncertain", None)),
        ([("a", 0.50), ("b", 0.45)], False, 0.0, ("matched", "a")),
        ([("a", 0.30), ("b", 0.10)], False, 0.0, ("uncertain", None)),
        ([("a", 0.15), ("b", 0.10)], False, 0.0, ("not_found", None)),
        ([("a", 0.60), ("a", 0.55), ("b", 0.1)], False, 0.3, ("matched", "a")),
        ([("a", 0.60), ("zz", 0.1)], False, 0.0, ("catalog_mismatch", None)),
        ([("a", 0.91)], True, 0.0, ("not_found", None)),
        ([("a", 0.45)], False, 0.5, ("matched", "a")),
        ([], False, 0.0, ("not_found", None)),
    ],
)
def test_resolution(spark, candidates, abstain, margin, expected):
    known = spark.createDataFrame([("a",), ("b",)], "slug string")
    rows = spark.createDataFrame([(1, k + 1, s, c) for k, (s, c) in enumerate(candidates)], "query_id int, rank int, slug string, confidence double")
    got = resolve.resolve(spark.createDataFrame([(1, abstain)], "query_id int, abstain boolean"), rows, known, least_margin=margin).first()
    assert (got.status, got.slug) == expected


def test_blocks_equal_expressions(spark):
    import numpy as np

    made = np.random.default_rng(3)
    rows = [(k, b, made.normal(size=8).tolist()) for k in range(60) for b in ("label", "bottle")]
    rows += [(60, "label", rows[0][2]), (61, "label", [0.0] * 8)]
    gallery = mining.prepared(spark.createDataFrame(rows, "slug int, branch string, vec array<double>")).repartition(5)
    queries = gallery.where("slug % 7 = 0").withColumnRenamed("slug", "query_id")
    skip = queries.select("query_id", F.col("query_id").alias("slug")).distinct()
    for exclude in (None, skip):
        one = mining.top_k(mining.similarities(queries, gallery, exclude), 5)
        two = mining.branch_top_k(queries, gallery, 5, exclude, query_block=4, gallery_parts=3, query_parts=2)
        key = lambda df: sorted((r.query_id, r.branch, r.slug, r.branch_rank) for r in df.collect())
        assert key(one) == key(two)
    near = vector_index.approximate_top_k(queries, gallery, "label", 5)
    assert 0.9 <= mining.recall_against(near, mining.top_k(mining.similarities(queries, gallery), 5).where("branch = 'label'")).first().recall <= 1


def test_best_of_producers_without_sorting_every_column():
    import numpy as np

    made = np.random.default_rng(5)
    for t in range(300):
        n, k = int(made.integers(1, 150)), int(made.integers(1, 7))
        makers = made.integers(0, made.integers(1, 50), n) if t % 3 else np.where(np.arange(n) < n - 2, 0, np.arange(n))  # every third time one of them has nearly all
        sims, shares = np.round(made.normal(size=(4, n)), int(made.integers(0, 4))) + 0.0, made.integers(1, 4, 4)
        sims[made.random((4, n)) < (t % 5 == 0) * 0.3] = np.nan
        want = []
        for row in range(4):
            taken, listed = {}, []
            for c in sorted(range(n), key=lambda c: (True, 0, c) if np.isnan(sims[row, c]) else (False, -sims[row, c], c)):
                if taken.setdefault(makers[c], 0) < shares[row] and len(listed) < k:
                    taken[makers[c]] += 1
                    listed.append((row, c))
            want += listed
        rows, columns = mining._first_of_producers(sims, np.unique(makers, return_inverse=True)[1], shares, k)
        assert list(zip(rows.tolist(), columns.tolist())) == want


def test_shortlists_by_hand_in_parts_of_each_filter(spark, monkeypatch):
    import numpy as np

    made = np.random.default_rng(11)
    words = ["Красное", "Белое сухое", "Игристое", "Просто вино", "Розовое"]  # no card is rosé: these fall back
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    cards = [(f"c{k}", unit(made.normal(size=6)), ["Красное", "Белое"][k % 2], None if k % 3 == 0 else f"w{k % 5}", ("сухое" if k % 4 else None, k % 7 == 0)) for k in range(90)]
    asked = [(q, words[q % 5], f"c{q}" if q % 8 == 0 else "gone" if q == 33 else None, unit(made.normal(size=6))) for q in range(60)]
    vecs, want = {c[0]: np.array(c[1]) for c in cards}, set()
    passes = [lambda c: c[2] == "Красное", lambda c: c[2] == "Белое" and c[4][0] == "сухое", lambda c: c[4][1], lambda c: True, lambda c: False]
    for q, _, about, vec in asked:
        if about == "gone":
            continue
        good = [c for c in cards if passes[q % 5](c) and c[0] != about] or (cards if about is None else [])
        start, taken, place = vecs[about] if about else np.array(vec), {}, 1 if about else 0
        want |= {(q, 1, about)} if about else set()
        for c in sorted(good, key=lambda c: (-round(float(start @ vecs[c[0]]), 6), c[0])):
            if taken.setdefault(c[3] or "", 0) < 2 and place < 6:
                taken[c[3] or ""], place = taken[c[3] or ""] + 1, place + 1
                want.add((q, place, c[0]))
    cards = spark.createDataFrame(cards, "slug string, vec array<double>, category string, winery string, profile struct<sweetness: string, sparkling: boolean>")
    asked = spark.createDataFrame(asked, "question_id int, question string, about_slug string, vec array<double>")
    for gallery, queries in ((10_000, 5_000), (20, 3)):
        monkeypatch.setattr(retrieval, "GALLERY_ROWS", gallery)
        monkeypatch.setattr(retrieval, "QUERY_ROWS", queries)
        assert {tuple(r) for r in retrieval.shortlists(asked, cards).collect()} == want
    assert retrieval.shortlists(asked, cards.limit(0)).where("position > 1").count() == 0 == retrieval.shortlists(asked.limit(0), cards).count()


def test_matrices_of_a_task_are_bounded():
    import numpy as np

    assert mining.block_rows(512, 40) == 512 and mining.block_rows(512, 1 << 30) == 1
    for width in (mining.GALLERY_ROWS, 3 * mining.GALLERY_ROWS, 4096):
        assert 0 < mining.block_rows(10_000, width) * width <= mining.MOST_PAIRS
    made = np.random.default_rng(3)
    vectors, centroids = made.normal(size=(700, 3)), made.normal(size=(4096, 3))  # several blocks
    cell, r = vector_index._nearest(vectors, centroids)
    every = np.linalg.norm(vectors[:, None] - centroids[None], axis=2)
    assert (cell == every.argmin(axis=1)).all() and np.allclose(r, every.min(axis=1)) and len(vector_index._nearest(vectors[:0], centroids)[0]) == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_an_index_finds_the_exact_top_and_scores_few_pairs_of_clusters(spark, tmp_path, clustered):
    import numpy as np

    made = np.random.default_rng(7)
    centres = made.normal(size=(12, 6)) * 4
    rows = [(k, "label", (centres[k % 12] + made.normal(size=6) * (0.1 if clustered else 9)).tolist()) for k in range(600)]
    rows += [(k, "bottle", made.normal(size=6).tolist()) for k in range(40)] + [(700, "label", [0.0] * 6), (701, "label", rows[3][2]), (702, "label", None), (703, "label", rows[3][2])]
    gallery = mining.prepared(spark.createDataFrame(rows, "slug int, branch string, vec array<double>"))
    queries = gallery.where("slug % 25 = 3 OR slug = 700").withColumnRenamed("slug", "query_id").unionByName(spark.createDataFrame([(1, "none", [1.0] * 6)], "query_id int, branch string, vec array<double>"))
    skip = queries.select("query_id", F.col("query_id").alias("slug")).distinct()
    index = vector_index.build_index(gallery.where("slug < 500"), str(tmp_path / "index"), cells=12).append(gallery.where("slug >= 500"))
    key = lambda df: sorted((r.query_id, r.branch, r.slug, r.sim, r.branch_rank) for r in df.collect())
    for exclude, probes in ((None, 1), (skip, 3)):
        assert key(index.top_k(queries, 5, exclude, probes)) == key(mining.top_k(mining.similarities(queries, gallery, exclude), 5))
    again = vector_index.VectorIndex(spark, str(tmp_path / "index"))
    assert key(again.top_k(queries, 700)) == key(mining.top_k(mining.similarities(queries, gallery), 700))  # more than any cell holds
    found = again.scored(queries, 5, probes=1, part_rows=30)
    assert key(mining.top_k(found.where("slug IS NOT NULL").drop("scored"), 5)) == key(mining.top_k(mining.similarities(queries, gallery), 5))
    work = {r.branch: r.share for r in vector_index.index_work(found, queries, gallery).collect()}
    first = again.scored(queries, 5, probes=1, part_rows=30, exact=False).where("slug IS NOT NULL").drop("scored")
    last = mining.top_k(first, 5).where("branch_rank = 5").select("query_id", "branch", F.col("sim").alias("least"))
    more = found.where("slug IS NOT NULL").drop("scored").exceptAll(first).join(last, ["query_id", "branch"])
    assert more.where("sim < least").count() == 0  # the further cells give only what can still take a place
    assert work["label"] < 0.2 if clustered else work["label"] <= 1
    assert vector_index.build_index(gallery.limit(0)).top_k(queries, 5).count() == 0


def test_fused_evidence(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1.0, True), (1, 1, "b", 3.0, True), (2, 1, "a", 1.0, True), (2, 1, "b", 9.0, False), (3, 1, "a", 1.0, False)], "query_id int, slug int, branch string, value double, available boolean")
    gates = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "branch string, gate double")
    assert {r.query_id: r.fused for r in mining.fused_evidence(rows, gates).collect()} == {1: 2.0, 2: 1.0, 3: 0.0}
    vecs = rows.withColumn("value", F.array("value", F.col("value") * 2))
    assert {r.query_id: r.fused for r in mining.fused_vectors(vecs, gates).collect()}[1] == [2.0, 4.0]


def test_ranking_report_by_hand(spark):
    rows = spark.createDataFrame([(1, "a", 2.0, 1.0, 0.5, True), (1, "b", 1.0, 0.0, 0.5, False), (2, "a", 0.0, 3.0, 0.1, False), (2, "b", 1.0, 1.0, 0.0, True), (2, "c", 0.0, 0.0, 0.0, False)], "query_id int, slug string, score double, base_logit double, residual double, is_positive boolean")
    got = metrics.ranking_report(rows).first()
    lse = lambda *x: math.log(sum(map(math.exp, x)))
    assert abs(got.ranking - ((lse(2, 1) - 2) + (lse(0, 1, 0) - 1)) / 2) < 1e-6
    assert abs(got.pairwise - (math.log1p(math.exp(0.5 - 2 + 1)) + math.log1p(math.exp(0.5 - 1 + 0))) / 2) < 1e-6
    assert got.base_correct_rate == 0.5 and abs(got.protection) < 1e-6 and abs(got.residual_guard - 0.5 / 3) < 1e-6
    lone = rows.where("query_id = 1 AND NOT is_positive")
    with pytest.raises(Exception, match="without a positive"):
        metrics.ranking_report(lone, strict=True).collect()
    assert metrics.ranking_report(rows.limit(0)).first().n_queries == 0


def test_citations(spark):
    shortlist = spark.createDataFrame([(q, p, f"s{p}") for q in (1, 2, 3, 4) for p in (1, 2, 3)], "question_id int, position int, slug string")
    answers = spark.createDataFrame([(1, "[3] и [2], [3], [9]", None), (2, "нет", None), (3, "[2] [1]", "s1"), (4, "[99999999999999]", "s1")], "question_id int, answer string, about_slug string")
    assert {r.question_id: r.cited for r in retrieval.citations(answers, shortlist).collect()} == {1: [3, 2], 2: [1], 3: [1, 2], 4: [1]}
    notes = sorted((r.question_id, r.place, r.slug, r.footnote) for r in retrieval.cited_items(answers, shortlist).where("question_id = 3").collect())
    assert notes == [(3, 1, "s1", None), (3, 2, "s2", 1)]


def test_history_and_saves(spark):
    rows = [(k, s, f"2024-01-{d:02d} 00:00:00", "matched") for k, s, d in ((1, "x", 1), (2, "x", 2), (3, "x", 3), (4, "y", 3), (5, "x", 30))]
    scans = spark.createDataFrame(rows, "id int, session string, created_at string, status string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    now = F.lit("2024-02-01 00:00:00.9").cast("timestamp")
    got = sorted((r.session, r.place, r.id) for r in history.history(scans, now, 2).collect())
    assert got == [("x", 1, 5), ("x", 2, 3), ("y", 1, 4)]
    clears = spark.createDataFrame([("x", "2024-01-03 00:00:00")], "session string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.id for r in history.history(scans, now, 9, clears=clears).collect()) == [4, 5]
    events = spark.createDataFrame([("u", "a", 1, 1), ("u", "b", 2, 2), ("u", "a", 3, 3), ("u", "a", 4, 4)], "user string, slug string, ts int, id int")
    assert [(r.place, r.slug) for r in history.saved_items(events).orderBy("place").collect()] == [(1, "b"), (2, "a")]


def test_vectors(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    got = row.select(vectors.normalized(F.col("v")).alias("n"), vectors.normalized(F.col("z")).alias("z"), vectors.pair_features(F.col("v"), F.col("z")).alias("p"), vectors.masked(F.col("v"), F.lit(False)).alias("m")).first()
    assert got.n == [0.6, 0.8] and got.z == [0.0, 0.0] and len(got.p) == 8 and got.m == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.base_logit(F.lit(1.0), 0)
