"""How the given tables stand in for catalogs, questions, detections and logs.

Every input is a list of select expressions that Spark and DuckDB read alike, so a query and its SQL twin start from the
same rows: ``frame`` makes the DataFrame, ``cte`` the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.functions.vectors import normalized

#: table, expressions, condition
INPUTS: dict[str, tuple[str, list[str], str]] = {
    "catalog": (
        "part",
        [
            "concat('p-', cast(p_partkey as string)) AS slug",
            "p_partkey AS pos",
            "concat(p_name, case when p_size % 11 = 0 then ' брют' when p_size % 7 = 0 then ' сладкое' else '' end) AS name",
            "p_brand AS winery",
            "case p_type when 'ECONOMY' then 'Красное' when 'STANDARD' then 'Белое' when 'PROMO' then 'Розовое' when 'SMALL' then '' else 'Оранжевое' end AS category",
            "p_type AS region",
            "case p_size % 3 when 0 then 'рислинг' when 1 then 'пино нуар' else 'саперави' end AS grapes",
            "case when p_size % 9 = 0 then '' else concat('size ', cast(p_size as string)) end AS description",
            "case p_size % 5 when 1 then 'сухое' when 2 then 'полусухое' when 3 then 'сладкое' when 4 then 'полусладкое' end AS sweetness",
            "case p_size % 4 when 0 then true when 1 then null else false end AS sparkling",
            "case p_size % 6 when 0 then 'неизвестно' when 1 then null else 'полное' end AS body",
            "case p_size % 10 when 0 then '' else 'высокая' end AS acidity",
            "cast(null as string) AS tannins",
            "case p_size % 8 when 0 then 'неизвестно' when 1 then null else '8–10 °C' end AS serve_temp",
            "case when p_size % 2 = 0 then split('вишня,дуб', ',') end AS aromas",
            "case when p_size % 3 = 0 then split('рыба,сыр', ',') end AS pairing",
        ],
        "true",
    ),
    "raw_catalog": (
        "part",
        [
            "case p_partkey % 40 when 0 then '' when 1 then concat('a/b', cast(p_partkey as string)) when 2 then 'p-3' when 3 then null else concat('p-', cast(p_partkey as string)) end AS slug",
            "p_partkey AS pos",
        ],
        "true",
    ),
    "requests": (
        "customer",
        [
            "c_custkey AS request_id",
            "case c_custkey % 5 when 0 then 'meat' when 1 then 'fish' when 2 then 'cheese' when 3 then 'vegetables' else 'dessert' end AS dish",
            "case c_nationkey % 5 when 0 then 'any' when 1 then 'red' when 2 then 'white' when 3 then 'rose' else 'sparkling' end AS preference",
        ],
        "true",
    ),
    "questions": (
        "part",
        [
            "p_partkey AS question_id",
            "case p_partkey % 12 when 0 then 'Посоветуй красное сухое к ужину' when 1 then 'Есть ли не игристое белое?' when 2 then 'Хочу игристое на праздник' when 3 then 'Что взять на десерт?' "
            "when 4 then 'Полусладкое розовое, пожалуйста' when 5 then 'Вино к стейку и грибам' when 6 then 'Утка с вишнёвым соусом' when 7 then 'Тихое оранжевое' "
            "when 8 then 'Сладкое к шоколаду' when 9 then 'Полусухое без пузырьков' when 10 then 'Расскажи про регион' else 'Брют к устрицам' end AS question",
        ],
        "true",
    ),
    "detections": (
        "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS det FROM lineitem)",
        [
            "l_orderkey AS image_id",
            "cast(det as int) AS det_id",
            "cast((l_partkey + l_linenumber) % 2 as int) AS class_id",
            "cast((l_suppkey * 37 + l_partkey * 11) % 100 as double) / 100 AS confidence",
            "cast((l_partkey * 13) % 800 as double) AS x1",
            "cast((l_suppkey * 29) % 900 as double) AS y1",
            "cast((l_partkey * 13) % 800 + 60 + l_linenumber * 20 as double) AS x2",
            "cast((l_suppkey * 29) % 900 + 120 + l_linenumber * 40 as double) AS y2",
        ],
        "true",
    ),
    "scans": (
        "events",
        [
            "event_id AS id",
            "user_id AS session",
            "ts AS created_at",
            "case event_type when 'error' then 'demo' when 'purchase' then 'matched' when 'signup' then 'not_found' else 'uncertain' end AS status",
            "props AS result",
        ],
        "true",
    ),
    "clears": ("events", ["user_id AS session", "ts"], "event_type = 'signup'"),
    "saves": ("events", ["user_id AS user", "concat('p-', cast(event_id % 40 as string)) AS slug", "ts", "event_id AS id"], "event_type IN ('click', 'view')"),
    "predictions": (
        "(SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)",
        [
            "doc_id AS query_id",
            "concat('img-', cast(doc_id % 97 as string)) AS image_sha256",
            "case when doc_id % 7 = 0 then null else concat('c-', cast(case when doc_id % 97 < 60 then doc_id % 2 else 1 end as string)) end AS predicted_slug",
            "104 + (doc_id * 37) % 613 AS latency_ms",
            "cast((doc_id * 13) % 100 as double) / 100 AS confidence",
            "case when toxic = 1 then null else concat('c-', cast(quality as string)) end AS true_slug",
            "case when doc_id % 2 = 0 then 'dev' else 'test' end AS split",
        ],
        "true",
    ),
    "images": (
        "lineitem",
        [
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "case l_partkey % 5 when 0 then 'GIF' when 1 then 'PNG' when 2 then 'WEBP' when 3 then null else 'JPEG' end AS format",
            "cast(l_partkey % 6000 as int) AS width",
            "cast(l_suppkey * 60 % 5000 as int) AS height",
            "cast(l_extendedprice * 300 as bigint) AS n_bytes",
        ],
        "true",
    ),
    "answers": (
        "conversations",
        [
            "conv_id * 1000 + turn AS question_id",
            "concat(text, ' [', cast(turn % 9 as string), '] и [', cast(conv_id % 6 as string), '] [2] [x] [99999999999]') AS answer",
            "case when conv_id % 3 = 0 then concat('s-', cast(conv_id as string), '-1') end AS about_slug",
        ],
        "role = 'assistant'",
    ),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    source, expressions, condition = INPUTS[name]
    if not source.startswith("("):
        return table(spark, sf_dir, source).where(condition).selectExpr(*expressions)
    words = {t for t in TABLES if f" {t}" in source}
    inner = source
    for t in words:
        inner = inner.replace(f" {t} ", f" {{{t}}} ").replace(f" {t})", f" {{{t}}})")
    rows = spark.sql(inner[1:-1], **{t: table(spark, sf_dir, t) for t in words})
    return rows.where(condition).selectExpr(*expressions)


def cte(*names: str) -> str:
    """The inputs as SQL common table expressions, without the WITH."""
    return ",\n".join(f"{n} AS (SELECT {', '.join(INPUTS[n][1])} FROM {INPUTS[n][0]} WHERE {INPUTS[n][2]})" for n in names)


def with_profile(catalog: DataFrame) -> DataFrame:
    """The catalog input with its profile columns as the struct ``profile``."""
    parts = ["sweetness", "body", "acidity", "tannins", "serve_temp", "sparkling", "aromas", "pairing"]
    return catalog.withColumn("profile", F.struct(*parts)).drop(*parts)


def boxed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("box", F.struct("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


def image_sizes(detections: DataFrame) -> DataFrame:
    return detections.select("image_id").distinct().select("image_id", F.lit(1000).alias("width"), F.lit(1400).alias("height"))


#: Halves of the embeddings, as branches.
BRANCHES = {"label": (1, 32), "bottle": (33, 64)}


def branch_vectors(spark: SparkSession, sf_dir: str, key: str, query_set: bool = False) -> DataFrame:
    """(key, branch, vec): unit halves of the embeddings; the query set is every id divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.where("vec_id % 20 = 0") if query_set else rows
    halves = F.array(*(F.struct(F.lit(b).alias("branch"), F.slice("embedding", a, z - a + 1).alias("v")) for b, (a, z) in BRANCHES.items()))
    return rows.select(F.col("vec_id").alias(key), F.inline(halves)).select(key, "branch", normalized(F.col("v")).alias("vec"))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, label) of the query set and (slug, label) of all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "slug")


def themselves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, slug) pairs to leave out: each query itself."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("slug"))


_UNIT = "list_transform({0}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({0}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
_DOT = "CAST(list_dot_product({0}, {1}) AS DOUBLE)"
#: The same as SQL: vectors, pair similarities, branch tops, pool.
MINING = f"""
halves AS (SELECT vec_id, label, embedding[1:32] AS l, embedding[33:64] AS b FROM embeddings),
vecs AS (SELECT vec_id, label, {_UNIT.format("l")} AS l, {_UNIT.format("b")} AS b FROM halves),
pairs AS (
  SELECT q.vec_id AS query_id, g.vec_id AS slug, q.label = g.label AS is_positive, round({_DOT.format("q.l", "g.l")}, 6) AS sim_label, round({_DOT.format("q.b", "g.b")}, 6) AS sim_bottle
  FROM vecs q JOIN vecs g ON q.vec_id % 20 = 0 AND q.vec_id <> g.vec_id
),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim_label DESC, slug) AS rl, row_number() OVER (PARTITION BY query_id ORDER BY sim_bottle DESC, slug) AS rb FROM pairs
),
pool AS (
  SELECT *, greatest(sim_label, sim_bottle) AS key, row_number() OVER (PARTITION BY query_id ORDER BY greatest(sim_label, sim_bottle) DESC, slug) AS rank
  FROM ranks WHERE rl <= 12 OR rb <= 12
),
cands AS (
  SELECT query_id, slug, rank, is_positive, sim_label, sim_bottle, round(sim_bottle / 0.07, 6) AS base_logit,
         round(2.5 * tanh(CAST((query_id * 7 + slug * 3) % 21 - 10 AS DOUBLE) / 20), 6) AS residual,
         round(sim_bottle / 0.07 + 2.5 * tanh(CAST((query_id * 7 + slug * 3) % 21 - 10 AS DOUBLE) / 20), 6) AS score
  FROM pool WHERE rank <= 36
)"""
RAW_RESIDUAL = "cast((query_id * 7 + slug * 3) % 21 - 10 as double) / 20"
