"""Queries over questions, answers, prediction logs and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogmatch.functions.filters import DEFAULT_LEXICON as L
from catalogmatch.functions.filters import allowed, read_filters
from catalogmatch.functions.vectors import normalized
from catalogmatch.operators import history as H
from catalogmatch.operators import metrics as M
from catalogmatch.operators import retrieval as R
from catalogmatch.plans.catalog_queries import LINE_SQL
from catalogmatch.plans.inputs import INPUTS, cte, frame, table, with_profile
from catalogmatch.sources import catalog as S
from catalogmatch.sources import files as X
from catalogmatch.sources.sinks import append_scans, compact_scans, kept_table, read_scans, work_dir
from catalogmatch.streaming import history as SH

AS_OF = "2024-01-31 00:00:00.5"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def h4_read_filters(spark, sf):
    f = read_filters(F.col("question"))
    return frame(spark, sf, "questions").select(
        "question_id", f.category.alias("category"), f.sparkling.alias("sparkling"), F.array_join(F.array_sort(f.sweetness), ",").alias("sweetness"), f.not_sweet.alias("not_sweet")
    )


def h5_allowed_counts(spark, sf):
    """How many cards pass the filters of each distinct question."""
    return _passing(spark, sf, with_profile(frame(spark, sf, "catalog")))


def _passing(spark, sf, cards):
    asked = frame(spark, sf, "questions").select("question").distinct().withColumn("filters", read_filters(F.col("question")))
    passes = allowed(F.col("filters"), F.col("category"), F.col("profile.sparkling"), F.col("profile.sweetness"))
    kinds = F.broadcast(asked.select("filters").distinct())  # the lexicon bounds the different filters
    counts = cards.join(kinds, passes).groupBy(F.to_json("filters", {"ignoreNullFields": "false"}).alias("kind")).agg(F.count("*").alias("n"))
    return asked.withColumn("kind", F.to_json("filters", {"ignoreNullFields": "false"})).join(counts, "kind").select("question", "n")


def c2_carded(spark, sf):
    """Cards of which every third has no profile: how many pass the filters of each question."""
    cards = frame(spark, sf, "catalog")
    profiles = with_profile(cards).where("pos % 3 <> 0").select("slug", "profile")
    return _passing(spark, sf, R.carded(cards.select("slug", "pos", "category"), profiles))


def _cards(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), normalized(F.col("embedding")).alias("vec"))
    return with_profile(frame(spark, sf, "catalog")).join(vectors, "pos")


#: The query set of prompts and similar items; shortlists are made for every question that has a vector.
QUERY_SET = "vec_id % 20 = 0"


def _questions(spark, sf, condition="true"):
    vectors = table(spark, sf, "embeddings").where(condition).select(F.col("vec_id").alias("question_id"), normalized(F.col("embedding")).alias("vec"))
    asked = frame(spark, sf, "questions").join(vectors, "question_id")
    return asked.withColumn("about_slug", F.when(F.col("question_id") % 60 == 0, F.concat(F.lit("p-"), F.col("question_id").cast("string"))))


def i2_shortlists(spark, sf):
    return R.shortlists(_questions(spark, sf), _cards(spark, sf)).select("question_id", F.col("position").cast("int").alias("position"), "slug")


def i3_prompts(spark, sf):
    questions, cards = _questions(spark, sf, QUERY_SET), _cards(spark, sf)
    return R.prompts(questions, R.shortlists(questions, cards), cards)


def g8_similar_items(spark, sf):
    """The five nearest items of each item of the query set, itself first, at most two per producer."""
    own = _questions(spark, sf, QUERY_SET).withColumn("question", F.lit("")).withColumn("about_slug", F.concat(F.lit("p-"), F.col("question_id").cast("string")))
    return R.shortlists(own, _cards(spark, sf)).select("question_id", F.col("position").cast("int").alias("position"), "slug")


def _answered(spark, sf):
    answers = frame(spark, sf, "answers")
    places = F.explode(F.sequence(F.lit(1), (F.col("question_id") % 4 + 2).cast("int"))).alias("position")
    slug = F.concat(F.lit("s-"), F.floor(F.col("question_id") / 1000).cast("string"), F.lit("-"), F.col("position").cast("string"))
    return answers, answers.select("question_id", places).withColumn("slug", slug)


def h9_citations(spark, sf):
    return R.citations(*_answered(spark, sf)).select("question_id", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


def i4_cited_items(spark, sf):
    return R.cited_items(*_answered(spark, sf)).select("question_id", F.col("place").cast("int").alias("place"), "position", "slug", "footnote")


def d11_log_summary(spark, sf):
    return M.log_summary(frame(spark, sf, "predictions"))


def d11_sketched_summary(spark, sf):
    """Summaries of each of four quarters and of all days from sketches kept per day: what is exact, and whether the estimates keep their bounds."""
    rows = kept_table(frame(spark, sf, "predictions").withColumn("day", (F.col("query_id") % 28).cast("int")), "log-days")
    kept = kept_table(M.log_sketches(rows.where("query_id % 3 = 0")).unionByName(M.log_sketches(rows.where("query_id % 3 > 0"))), "log-sketches")
    quarter = F.floor(F.col("day") / 7).cast("int").alias("quarter")
    found = M.merged_summary(kept.withColumn("quarter", quarter), ("quarter",)).unionByName(M.merged_summary(kept).withColumn("quarter", F.lit(-1)))
    both = rows.withColumn("quarter", F.explode(F.array(F.lit(-1), quarter)))
    share = lambda p: (F.count_if(F.col("latency_ms") < F.col(f"p{p}")) / F.count("latency_ms"), F.count_if(F.col("latency_ms") <= F.col(f"p{p}")) / F.count("latency_ms"))
    near = lambda p: (share(p)[0] <= p / 100 + 0.014) & (share(p)[1] >= p / 100 - 0.014)
    asked = F.broadcast(found.select("quarter", F.col("images").alias("estimate"), *(F.col(f"latency_p{p}").alias(f"p{p}") for p in (50, 90, 95, 99))))  # a row for each range
    held = both.join(asked, "quarter").groupBy("quarter").agg(
        *(near(p).alias(f"p{p}_within") for p in (50, 90, 95, 99)), (F.abs(F.count_distinct("image_sha256") - F.max("estimate")) <= 0.05 * F.count_distinct("image_sha256")).alias("images_within")
    )
    return found.select("quarter", "n", "answered", "abstained", "latency_min", "latency_mean", "latency_max").join(held, "quarter")


def d12_repeated_images(spark, sf):
    return M.repeated_images(frame(spark, sf, "predictions"))


def d13_truth_report(spark, sf):
    rows = frame(spark, sf, "predictions")
    return M.truth_report(rows, rows.select("query_id", "true_slug", "split"))


def d13_threshold_sweep(spark, sf):
    rows = frame(spark, sf, "predictions").select("query_id", F.col("predicted_slug").alias("slug"), "confidence", "true_slug")
    return M.threshold_sweep(rows, [0.2, 0.45, 0.7])


def _scans(spark, sf):
    return frame(spark, sf, "scans").withColumn("created_at", F.col("created_at").cast("timestamp"))


def _clears(spark, sf):
    return frame(spark, sf, "clears").withColumn("ts", F.col("ts").cast("timestamp"))


def e13_latest(spark, sf):
    return H.latest(_scans(spark, sf), 5).select("session", "id", F.col("place").cast("int").alias("place"))


def b11_without_demo(spark, sf):
    return H.without_demo(_scans(spark, sf)).groupBy("session").agg(F.count("*").alias("n"))


def j1_history(spark, sf):
    return H.history(_scans(spark, sf), _as_of(), 100, 14).select("session", "id", F.col("place").cast("int").alias("place"))


def j3_cleared_history(spark, sf):
    return H.history(_scans(spark, sf), _as_of(), 100, 30, clears=_clears(spark, sf), hide_demo=True).select("session", "id", F.col("place").cast("int").alias("place"))


def j5_saved_items(spark, sf):
    return H.saved_items(frame(spark, sf, "saves")).select("user", F.col("place").cast("int").alias("place"), "slug")


def _stream(spark, sf, name):
    """An input over the events table as a stream of its files."""
    source = spark.read.parquet(f"{sf}/events.parquet")
    events = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).parquet(f"{sf}/events.parquet*")
    _, expressions, condition = INPUTS[name]
    return events.where(condition).selectExpr(*expressions)


def _finished(spark, rows, tag):
    """All rows a stream emits over what is there now."""
    path = work_dir(spark, tag)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    #: A batch that is processed again replaces what it wrote.
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def j1_stream_history(spark, sf):
    """The streamed history, cut at the same moment as the batch view."""
    scans = _stream(spark, sf, "scans").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = _finished(spark, SH.stream_history(scans, 100, 30), "stream-history")
    newest = rows.groupBy("session").agg(F.max("newest").alias("newest"))
    current = rows.join(newest, ["session", "newest"]).select("session", "id", "created_at", "status").distinct()
    return H.history(current, _as_of(), 100, 30).select("session", "id", F.col("place").cast("int").alias("place"))


def j5_stream_saved(spark, sf):
    events = _stream(spark, sf, "saves").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _finished(spark, SH.stream_saved(events), "stream-saved")
    current = rows.groupBy("user", "slug").agg(F.max_by("saved", "ts").alias("saved"))
    return current.where("saved").select("user", "slug")


def _predicted(spark, sf):
    """Predictions that arrive as a stream."""
    shape = F.array(F.struct(F.concat(F.lit("p-"), (F.col("id") % 50).cast("string")).alias("slug"), ((F.col("id") * 7 % 100) / 100.0).cast("double").alias("confidence")),
                    F.struct(F.concat(F.lit("p-"), (F.col("id") % 30).cast("string")).alias("slug"), ((F.col("id") * 7 % 100) / 300.0).cast("double").alias("confidence")))
    return _stream(spark, sf, "scans").select(
        F.col("id").alias("query_id"), "session", F.col("created_at").cast("timestamp").alias("created_at"), (F.col("id") % 9 == 0).alias("abstain"), shape.alias("candidates")
    )


def j6_stream_scans(spark, sf):
    """Predictions that arrive as a stream, resolved and appended to the scan log, then read back."""
    catalog = frame(spark, sf, "catalog").where("pos % 50 <> 3").select("slug")
    path = work_dir(spark, "stream-scans")
    SH.stream_scans(_predicted(spark, sf), catalog, f"{path}/log", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return read_scans(spark, f"{path}/log").select("id", "status", "slug", F.round("confidence", 6).alias("confidence"))


def _in_any_order(spark, rows, tag):
    """``rows`` as a stream of eight files in an order of their own, every fifth row once more in a later one."""
    path = work_dir(spark, tag)
    at = F.pmod(F.xxhash64("id"), F.lit(7)).cast("int")
    dealt = rows.withColumn("file", F.explode(F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, F.array(at, F.lit(7))).otherwise(F.array(at))))
    dealt.repartition(8, "file").write.partitionBy("file").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/file=*")


def j3_stream_cleared(spark, sf):
    """Scans and clears as streams, in any order and partly delivered twice; the last lists, cut at the same moment as the batch view."""
    scans = _in_any_order(spark, _scans(spark, sf).select("session", "id", "created_at", "status"), "scans-in")
    clears = _in_any_order(spark, _clears(spark, sf).withColumn("id", F.xxhash64("session", "ts")), "clears-in")
    rows = _finished(spark, SH.stream_cleared_history(scans, clears, 100, 30, hide_demo=True), "stream-cleared")
    return H.history(SH.current_lists(rows), _as_of(), 100, 30).select("session", "id", F.col("place").cast("int").alias("place"))


def j6_shared_log(spark, sf):
    """One log, two streams with overlapping scans, and the first again after its checkpoint was lost: every scan is in the log once."""
    path, log = work_dir(spark, "stream-shared"), work_dir(spark, "shared-log")
    catalog = frame(spark, sf, "catalog").where("pos % 50 <> 3").select("slug")
    for name, part in (("one", "query_id % 3 < 2"), ("two", "query_id % 3 > 0"), ("one-again", "query_id % 3 < 2")):
        SH.stream_scans(_predicted(spark, sf).where(part), catalog, log, f"{path}/{name}").trigger(availableNow=True).start().awaitTermination()
    compact_scans(spark, log)
    return read_scans(spark, log).select("id", "status", "slug", F.round("confidence", 6).alias("confidence"))


def a13_append_scans(spark, sf):
    """The scan log written in two appends, one of them repeated, and read back."""
    path = work_dir(spark, "scan-log")
    scans = _scans(spark, sf)
    append_scans(scans.where("id % 2 = 0"), path, "even")
    append_scans(scans.where("id % 2 = 1"), path)
    append_scans(scans.where("id % 2 = 0"), path, "even")
    return read_scans(spark, path).groupBy("session", "status").agg(F.count("*").alias("n"))


def _requests(spark, sf):
    """Customers who ask for a session's listing."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 60).alias("session"))


def j2_session_listing(spark, sf):
    found = H.session_listings(_scans(spark, sf), _requests(spark, sf), _as_of(), 100, 14)
    return found.select("request_id", "id", "status", F.col("place").cast("int").alias("place"))


def j4_isolation(spark, sf):
    """Per request: the rows it was shown, and those of them that the log has under another session."""
    shown = H.session_listings(_scans(spark, sf), _requests(spark, sf), _as_of(), 100, 14)
    owner = _scans(spark, sf).select("id", F.col("session").alias("owner"))
    return shown.join(owner, "id").groupBy("request_id").agg(F.count("*").alias("n"), F.count_if(F.col("owner") != F.col("session")).alias("foreign_rows"))


def a1_catalog_scan(spark, sf):
    """The catalog written as CSV with quotes and line breaks in its fields, and read back."""
    path = work_dir(spark, "catalog-csv")
    cards = frame(spark, sf, "catalog")
    cards = cards.select("slug", F.concat(F.lit('"'), "name", F.lit('",\n'), "region").alias("name"), "winery", F.when(F.col("pos") % 5 != 0, F.col("category")).alias("category"))
    cards.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return S.read_catalog(spark, path).select("slug", "name", "winery", "category", "color", "description")


def a5_collected_files(spark, sf):
    """Pages written as text files into folders, collected from the folder and from one inside it, each file once."""
    path = work_dir(spark, "pages")
    table(spark, sf, "pages").select((F.col("page_id") % 4).alias("part"), F.coalesce("html", F.lit("")).alias("value")).write.partitionBy("part").text(path)
    files = S.required_images(S.read_images(spark, path, f"{path}/part=1", suffixes=("txt",)))
    return files.groupBy(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part")).agg(F.sum("length").alias("bytes"))


def a6_gallery(spark, sf):
    """One file per slug, repeated slugs left out; only those in the preferred folder count."""
    name = F.concat(F.lit("p-"), (F.col("p_partkey") % 900 + F.floor(F.col("p_partkey") / 1000) * 300).cast("string"), F.lit(".webp"))
    folder = F.when(F.col("p_size") % 5 == 0, "s3://cards/other/").otherwise("s3://cards/refs/")
    good, _ = S.gallery_files(table(spark, sf, "part").select(F.concat(folder, name).alias("path")))
    return good.select("slug", "path")


def a11_prediction_log(spark, sf):
    """The prediction log written as JSON lines, read back and summed up."""
    path = work_dir(spark, "prediction-log")
    rows = frame(spark, sf, "predictions")
    rows.select(F.col("query_id").cast("string").alias("query_id"), F.concat(F.lit("photos/"), "image_sha256").alias("image_path"), "image_sha256", "predicted_slug", "latency_ms").write.json(path)
    read = S.read_predictions(spark, path)
    return read.groupBy("image_path").agg(F.count("*").alias("n"), F.count("predicted_slug").alias("answered"), F.sum("latency_ms").alias("latency"), F.max("query_id").alias("last_query"))


def b12_request_checks(spark, sf):
    """Questions and predictions with the checks they fail: lengths, number and values of candidates, allowed values."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 7 != 6, F.concat("text", F.repeat(F.lit("?"), F.col("turn").cast("int") * 30))).alias("question"))
    n = (F.col("conv_id") % 24 + 1).cast("int")
    made = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.concat(F.lit("c-"), k.cast("string")).alias("slug"), (k * F.col("turn") / 100.0).cast("double").alias("confidence")))
    checks = X.question_checks(F.col("question")) | X.prediction_checks(made) | X.value_checks(known_role=(F.col("role"), ("user", "assistant")))
    return rows.select("conv_id", "turn", F.array_join(X.violations(**checks), ",").alias("violations"))


QUERIES = {
    f.__name__: f
    for f in (
        h4_read_filters, h5_allowed_counts, i2_shortlists, i3_prompts, g8_similar_items, h9_citations, i4_cited_items, d11_log_summary, d11_sketched_summary, d12_repeated_images, d13_truth_report, d13_threshold_sweep,
        e13_latest, b11_without_demo, j1_history, j3_cleared_history, j5_saved_items, j1_stream_history, j5_stream_saved, j6_stream_scans, j3_stream_cleared, j6_shared_log, a13_append_scans,
        c2_carded, j2_session_listing, j4_isolation, a1_catalog_scan, a5_collected_files, a6_gallery, a11_prediction_log, b12_request_checks,
    )
}


def _says(pattern):
    """A pattern with Unicode word boundaries for an engine whose own are ASCII."""
    body = pattern.replace(r"тих(ое|ого|им)\b", r"тих(ое|ого|им)([^\p{L}\p{N}_]|$)").replace(r"\b", r"(^|[^\p{L}\p{N}_])")
    return f"regexp_matches(qt, '{body}')"


def _first(choices):
    return "CASE " + " ".join(f"WHEN {_says(chr(92) + 'b' + stem)} THEN {value}" for stem, value in choices) + " END"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FILTERS = f"""asked AS (SELECT *, translate(lower(question), 'ё', 'е') AS qt FROM questions), f0 AS (
  SELECT *, {_first([(s, f"'{v}'") for s, v in L.colours])} AS fc, CASE WHEN {_says(L.still)} THEN false WHEN {_says(L.fizzy)} THEN true END AS fs,
  coalesce({_first([(s, _list(v)) for s, v in L.sweetness])}, CASE WHEN {_says(L.dessert)} THEN {_list(L.sweet_styles)} END) AS fw, {_says(L.savoury)} AS sav FROM asked
), filters AS (SELECT *, fw IS NULL AND sav AS fn FROM f0)"""
PASSES = "(fc IS NULL OR c.category = fc) AND (fs IS NULL OR coalesce(c.sparkling, false) = fs) AND (fw IS NULL OR coalesce(list_contains(fw, c.sweetness), false)) AND NOT (fn AND coalesce(c.sweetness IN ('сладкое', 'полусладкое'), false))"
_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"


def _search(name, questions, passes, exclude, k):
    return f"""{name}_p AS (SELECT q.question_id, c.slug, c.winery, round(list_dot_product(q.vec, c.vec), 6) AS sim FROM {questions} q JOIN cards c ON {passes} AND {exclude}),
{name}_w AS (SELECT *, row_number() OVER (PARTITION BY question_id, winery ORDER BY sim DESC, slug) AS own FROM {name}_p),
{name} AS (SELECT question_id, position, slug FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, slug) AS position FROM {name}_w WHERE own <= 2) WHERE position <= {k})"""


def _shortlists(about, filters=True, only=f" WHERE u.{QUERY_SET}"):
    source = FILTERS if filters else "filters AS (SELECT *, CAST(NULL AS VARCHAR) AS fc, CAST(NULL AS BOOLEAN) AS fs, CAST(NULL AS VARCHAR[]) AS fw, false AS fn FROM questions)"
    return f"""WITH {cte("catalog", "questions")}, {source}, unit AS (SELECT vec_id, {_UNIT} AS vec FROM embeddings), cards AS (SELECT c.*, u.vec FROM catalog c JOIN unit u ON c.pos = u.vec_id),
qs AS (SELECT f.*, u.vec, {about} AS about FROM filters f JOIN unit u ON f.question_id = u.vec_id{only}), free AS (SELECT * FROM qs WHERE NOT about), items AS (SELECT * FROM qs WHERE about),
{_search("found", "free", PASSES, "true", 6)}, left_over AS (SELECT * FROM free WHERE question_id NOT IN (SELECT question_id FROM found)),
{_search("plain", "left_over", "true", "true", 6)}, {_search("near", "items", PASSES, "c.pos <> q.question_id", 5)},
shortlist AS (SELECT * FROM found UNION ALL SELECT * FROM plain UNION ALL SELECT question_id, position + 1, slug FROM near UNION ALL SELECT question_id, 1, concat('p-', CAST(question_id AS VARCHAR)) FROM items)"""


_ABOUT = "f.question_id % 60 = 0"
_SHORT = "SELECT question_id, CAST(position AS INT) AS position, slug FROM shortlist"
CITED = f"""WITH {cte("answers")}, s AS (SELECT *, CAST(question_id % 4 + 2 AS INT) AS n, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS m FROM answers),
i AS (SELECT *, list_filter(list_transform(m, lambda x: TRY_CAST(x AS INT)), lambda x: x IS NOT NULL AND x >= 1 AND x <= n) AS inside FROM s),
d AS (SELECT *, list_filter(inside, lambda x, k: NOT list_contains(inside[1:k - 1], x)) AS once FROM i),
c AS (SELECT question_id, about_slug, CASE WHEN about_slug IS NOT NULL THEN list_prepend(1, list_filter(once, lambda x: x <> 1)) WHEN len(once) > 0 THEN once ELSE [1] END AS cited FROM d)"""
_PLACES = "SELECT session, id, CAST(row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id DESC) AS INT) AS place FROM {0}"
_HISTORY = f"WITH {cte('scans', 'clears')}, kept AS (SELECT * FROM scans WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {{0}} DAY){{1}}, p AS ({_PLACES.format('{2}')}) SELECT * FROM p WHERE place <= 100"
_SAVED = f"WITH {cte('saves')}, t AS (SELECT \"user\", slug, count(*) AS n, max(ts) AS ts, arg_max(id, (ts, id)) AS id FROM saves GROUP BY \"user\", slug), k AS (SELECT * FROM t WHERE n % 2 = 1)"
_LISTED = f"""WITH {cte('scans')}, kept AS (SELECT * FROM scans WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id DESC) AS INT) AS place FROM kept),
shown AS (SELECT c.c_custkey AS request_id, p.* FROM customer c JOIN p ON p.session = c.c_custkey % 60 AND p.place <= 100)"""
ORACLES = {
    "c2_carded": f"""WITH {cte('questions', 'catalog')}, {FILTERS}, q AS (SELECT DISTINCT question, fc, fs, fw, fn FROM filters),
      cards AS (SELECT slug, category, CASE WHEN pos % 3 <> 0 THEN sparkling END AS sparkling, CASE WHEN pos % 3 <> 0 THEN sweetness END AS sweetness FROM catalog)
      SELECT question, count(*) AS n FROM q JOIN cards c ON {PASSES} GROUP BY question""",
    "j2_session_listing": f"{_LISTED} SELECT request_id, id, status, place FROM shown",
    "j4_isolation": f"{_LISTED} SELECT request_id, count(*) AS n, CAST(0 AS BIGINT) AS foreign_rows FROM shown GROUP BY request_id",
    "a1_catalog_scan": f"WITH {cte('catalog')} SELECT slug, '\"' || name || '\",' || chr(10) || region AS name, winery, CASE WHEN pos % 5 <> 0 THEN category ELSE '' END AS category, '' AS color, '' AS description FROM catalog",
    "a5_collected_files": "SELECT page_id % 4 AS part, CAST(sum(strlen(coalesce(html, '')) + 1) AS BIGINT) AS bytes FROM pages GROUP BY page_id % 4",
    "a6_gallery": """WITH f AS (SELECT concat('p-', CAST(p_partkey % 900 + (p_partkey // 1000) * 300 AS VARCHAR)) AS slug, p_size FROM part WHERE p_size % 5 <> 0)
      SELECT slug, concat('s3://cards/refs/', slug, '.webp') AS path FROM f GROUP BY slug HAVING count(*) = 1""",
    "a11_prediction_log": f"WITH {cte('predictions')} SELECT concat('photos/', image_sha256) AS image_path, count(*) AS n, count(predicted_slug) AS answered, CAST(sum(latency_ms) AS BIGINT) AS latency, max(CAST(query_id AS VARCHAR)) AS last_query FROM predictions GROUP BY image_sha256",
    "b12_request_checks": """WITH r AS (SELECT conv_id, turn, role, CASE WHEN turn % 7 <> 6 THEN text || repeat('?', turn * 30) END AS q, conv_id % 24 + 1 AS n FROM conversations)
      SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT coalesce(length(q) BETWEEN 2 AND 500, false) THEN 'question_length' END, CASE WHEN n > 20 THEN 'candidate_count' END,
      CASE WHEN n * turn > 100 THEN 'candidates' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'known_role' END) AS violations FROM r""",
    "h4_read_filters": f"WITH {cte('questions')}, {FILTERS} SELECT question_id, fc AS category, fs AS sparkling, array_to_string(list_sort(fw), ',') AS sweetness, fn AS not_sweet FROM filters",
    "h5_allowed_counts": f"WITH {cte('questions', 'catalog')}, {FILTERS}, q AS (SELECT DISTINCT question, fc, fs, fw, fn FROM filters) SELECT question, count(*) AS n FROM q JOIN catalog c ON {PASSES} GROUP BY question",
    "i2_shortlists": f"{_shortlists(_ABOUT, only='')} {_SHORT}",
    "i3_prompts": f"""{_shortlists(_ABOUT)}, lines AS (SELECT s.question_id, s.position, {LINE_SQL.format(position='s.position')} AS line FROM shortlist s JOIN cards c ON s.slug = c.slug),
      l AS (SELECT question_id, string_agg(line, chr(10) ORDER BY position) AS listing, count(*) AS n FROM lines GROUP BY question_id)
      SELECT q.question_id, CASE WHEN about THEN 'Ответь про вино [1]; похожие вина — [2]–[' || CAST(n AS VARCHAR) || '].' ELSE 'Выбери от одного до трёх вин из списка и назови их номера в квадратных скобках.' END
        || chr(10) || chr(10) || 'Список вин:' || chr(10) || listing || chr(10) || chr(10) || 'Вопрос гостя: ' || question AS prompt FROM qs q JOIN l ON q.question_id = l.question_id""",
    "g8_similar_items": f"{_shortlists('true', filters=False)} {_SHORT}",
    "h9_citations": f"{CITED} SELECT question_id, array_to_string(cited, ',') AS cited FROM c",
    "i4_cited_items": f"""{CITED}, u AS (SELECT question_id, about_slug, unnest(cited) AS position, generate_subscripts(cited, 1) AS place FROM c),
      n AS (SELECT *, concat('s-', CAST(question_id // 1000 AS VARCHAR), '-', CAST(position AS VARCHAR)) AS slug FROM u)
      SELECT question_id, CAST(place AS INT) AS place, position, slug, CASE WHEN slug IS DISTINCT FROM about_slug THEN CAST(count(*) FILTER (slug IS DISTINCT FROM about_slug) OVER (PARTITION BY question_id ORDER BY place) AS INT) END AS footnote FROM n""",
    "d11_log_summary": f"""WITH {cte('predictions')} SELECT count(*) AS n, count(predicted_slug) AS answered, count(*) - count(predicted_slug) AS abstained, count(DISTINCT image_sha256) AS images, min(latency_ms) AS latency_min,
      round(avg(latency_ms), 6) AS latency_mean, max(latency_ms) AS latency_max, {', '.join(f'round(quantile_cont(latency_ms, {p}), 6) AS latency_p{round(100 * p)}' for p in (0.5, 0.9, 0.95, 0.99))} FROM predictions""",
    "d12_repeated_images": f"WITH {cte('predictions')} SELECT image_sha256, count(*) AS n, count(DISTINCT coalesce(predicted_slug, '∅')) AS answers, count(DISTINCT coalesce(predicted_slug, '∅')) = 1 AS consistent FROM predictions GROUP BY image_sha256 HAVING count(*) > 1",
    "d13_truth_report": f"""WITH {cte('predictions')}, p AS (SELECT *, coalesce(predicted_slug = true_slug, false) AS same FROM predictions) SELECT split, count(*) AS n, count(*) FILTER (same) AS correct,
      count(*) FILTER (predicted_slug IS NULL AND true_slug IS NULL) AS correct_abstain, count(*) FILTER (predicted_slug IS NOT NULL AND NOT same) AS wrong, count(*) FILTER (predicted_slug IS NULL AND true_slug IS NOT NULL) AS missed,
      round(avg(CASE WHEN same OR (predicted_slug IS NULL AND true_slug IS NULL) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY split""",
    "d13_threshold_sweep": f"""WITH {cte('predictions')}, t AS (SELECT p.*, CAST(t.th AS DOUBLE) AS threshold, confidence >= t.th AS says, coalesce(predicted_slug = true_slug, false) AS same FROM predictions p, (VALUES (0.2), (0.45), (0.7)) AS t(th))
      SELECT threshold, count(*) FILTER (says) AS answered, count(*) FILTER (says AND same) AS correct, count(*) FILTER (NOT says AND true_slug IS NULL) AS correct_abstain, count(*) FILTER (says AND NOT same) AS wrong FROM t GROUP BY threshold""",
    "e13_latest": f"WITH {cte('scans')}, p AS ({_PLACES.format('scans')}) SELECT * FROM p WHERE place <= 5",
    "b11_without_demo": f"WITH {cte('scans')} SELECT session, count(*) AS n FROM scans WHERE status <> 'demo' GROUP BY session",
    "j1_history": _HISTORY.format(14, "", "kept"),
    "j3_cleared_history": _HISTORY.format(
        30, ", last AS (SELECT session, max(ts) AS cleared FROM clears GROUP BY session), open AS (SELECT k.* FROM kept k LEFT JOIN last USING (session) WHERE status <> 'demo' AND (cleared IS NULL OR created_at > cleared))", "open"
    ),
    "j5_saved_items": f"{_SAVED}, p AS (SELECT \"user\", CAST(row_number() OVER (PARTITION BY \"user\" ORDER BY ts, id, slug) AS INT) AS place, slug FROM k) SELECT * FROM p WHERE place <= 500",
    "j1_stream_history": _HISTORY.format(30, "", "kept"),
    "j5_stream_saved": f"{_SAVED} SELECT \"user\", slug FROM k",
    "j6_stream_scans": f"""WITH {cte('catalog', 'scans')}, known AS (SELECT slug FROM catalog WHERE pos % 50 <> 3),
      r AS (SELECT id, concat('p-', CAST(id % 50 AS VARCHAR)) AS s1, concat('p-', CAST(id % 30 AS VARCHAR)) AS s2, CAST(id * 7 % 100 AS DOUBLE) / 100 AS c1, CAST(id * 7 % 100 AS DOUBLE) / 300 AS c2, id % 9 = 0 AS abstain FROM scans),
      v AS (SELECT *, s1 NOT IN (SELECT slug FROM known) OR s2 NOT IN (SELECT slug FROM known) AS bad FROM r),
      t AS (SELECT id, s1, c1, CASE WHEN bad THEN 'catalog_mismatch' WHEN abstain THEN 'not_found' WHEN c1 >= 0.45 THEN 'matched' WHEN c1 >= 0.2 THEN 'uncertain' ELSE 'not_found' END AS status FROM v)
      SELECT id, status, CASE WHEN status = 'matched' THEN s1 END AS slug, round(c1, 6) AS confidence FROM t""",
    "a13_append_scans": f"WITH {cte('scans')} SELECT session, status, count(*) AS n FROM scans GROUP BY session, status",
}
ORACLES |= {"j3_stream_cleared": ORACLES["j3_cleared_history"], "j6_shared_log": ORACLES["j6_stream_scans"]}
ORACLES["d11_sketched_summary"] = f"""WITH {cte('predictions')}, r AS (SELECT *, CAST((query_id % 28) // 7 AS INT) AS quarter FROM predictions UNION ALL SELECT *, -1 FROM predictions)
  SELECT quarter, count(*) AS n, count(predicted_slug) AS answered, count(*) - count(predicted_slug) AS abstained, min(latency_ms) AS latency_min, round(avg(latency_ms), 6) AS latency_mean, max(latency_ms) AS latency_max,
  true AS p50_within, true AS p90_within, true AS p95_within, true AS p99_within, true AS images_within FROM r GROUP BY quarter"""
