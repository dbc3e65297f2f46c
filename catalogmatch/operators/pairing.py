"""Rule-based recommendation for tables of (dish, preference) requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The editorial rules (dish, category, title, explanation, temperature).
RULES = [
    ("meat", "Красное", "К мясу", "Плотные красные вина обычно хорошо сочетаются с запечённым мясом и блюдами на гриле.", "16–18 °C"),
    ("fish", "Белое", "К рыбе", "Свежие белые вина дополняют рыбу, морепродукты и лёгкие соусы.", "8–12 °C"),
    ("cheese", "Белое", "К сыру", "Белое вино — универсальная отправная точка для сырной тарелки. К выдержанным сырам можно попробовать красное.", "10–12 °C"),
    ("vegetables", "Розовое", "К овощам", "Лёгкое розовое вино подойдёт к овощам на гриле, салатам и средиземноморским закускам.", "8–10 °C"),
    ("dessert", "Белое", "К десерту", "Ищите сладкое или полусладкое вино: оно должно быть не менее сладким, чем сам десерт.", "8–10 °C"),
]
#: Preferences (key, category, adjective, explanation where it overrides the rule's category).
PREFERENCES = [
    ("red", "Красное", "красное", "К лёгким блюдам выбирайте менее танинное красное; насыщенные вина оставьте для более плотных соусов."),
    ("white", "Белое", "белое", "Свежие белые вина поддержат лёгкие соусы, а более насыщенные подойдут к сливочным и запечённым блюдам."),
    ("rose", "Розовое", "розовое", "Розовое вино — лёгкий вариант для закусок, овощей и блюд с деликатными соусами."),
    ("sparkling", "Игристое", "игристое", "Игристые вина подходят к лёгким закускам; для сладкого десерта выбирайте сладкий стиль."),
]
#: What precedes another explanation, the note, and words of sparkling and dessert wines in names.
CHANGED = "Учли ваш выбор стиля. "
NOTE = "Общие рекомендации по стилю вина. Учитывайте соус и способ приготовления."
SPARKLING_WORDS = ("брют", "игрист", "spumante", "петнат")
DESSERT_WORD = "сладк"
#: Dishes as questions name them.
DISH_WORDS = [("meat", "мясу и блюдам на гриле"), ("fish", "рыбе и морепродуктам"), ("cheese", "сырной тарелке"), ("vegetables", "овощам на гриле и салатам"), ("dessert", "десерту")]


def rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(rules, preferences) as small tables."""
    return (
        spark.createDataFrame(RULES, "dish string, rule_category string, title string, rule_text string, temperature string"),
        spark.createDataFrame(PREFERENCES, "preference string, wanted string, adjective string, wanted_text string"),
    )


def planned(requests: DataFrame, rules: DataFrame | None = None, preferences: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, dish, preference) with category, title, explanation and temperature."""
    own = rule_tables(requests.sparkSession)
    rules, preferences = rules or own[0], preferences or own[1]
    rows = requests.join(F.broadcast(rules), "dish").join(F.broadcast(preferences), "preference", "left")  # a rule per dish, a row per style
    changed = F.col("wanted").isNotNull() & (F.col("wanted") != F.col("rule_category"))
    return rows.select(
        "request_id", "dish", "preference", F.coalesce("wanted", "rule_category").alias("category"), "title",
        F.when(changed, F.concat(F.lit(CHANGED), "wanted_text")).otherwise(F.col("rule_text")).alias("explanation"), "temperature",
    )


def first_per_group(rows: DataFrame, key: list[str], group: str, order: list, per_group: int, k: int, place: str = "place") -> DataFrame:
    """At most ``per_group`` rows of each group and ``k`` of each key, best first; ``place`` counts from 1.

    A greedy pass skips a row only for better rows of its own group, so two stacked ranks give its result.
    """
    inner = Window.partitionBy(*key, group).orderBy(*order)
    outer = Window.partitionBy(*key).orderBy(*order)
    kept = rows.withColumn("_in_group", F.row_number().over(inner)).where(F.col("_in_group") <= per_group).drop("_in_group")
    return kept.withColumn(place, F.row_number().over(outer)).where(F.col(place) <= k)


def recommend(catalog: DataFrame, requests: DataFrame, k: int = 3) -> DataFrame:
    """(request_id, place, slug, title, explanation, temperature, note, method): up to ``k`` cards of different producers in file order.

    Requests with equal category and dish share one search of the catalog: their number is bounded by the rule tables.
    """
    plan = planned(requests)
    searches = plan.select("category", F.col("dish").eqNullSafe("dessert").alias("sweet")).distinct()
    name = F.lower("name")
    in_style = F.when(F.col("category") == "Игристое", F.exists(F.array(*map(F.lit, SPARKLING_WORDS)), lambda w: F.contains(name, w))).otherwise(
        F.contains(F.lower("card_category"), F.lower("category"))
    )
    cards = catalog.select("slug", "pos", "name", "winery", F.col("category").alias("card_category"))
    found = cards.join(F.broadcast(searches), in_style & (~F.col("sweet") | F.contains(name, F.lit(DESSERT_WORD))))
    top = first_per_group(found, ["category", "sweet"], "winery", ["pos"], 1, k)
    rows = plan.withColumn("sweet", F.col("dish").eqNullSafe("dessert")).join(F.broadcast(top.select("category", "sweet", "place", "slug")), ["category", "sweet"], "left")
    return rows.select("request_id", "place", "slug", "title", "explanation", "temperature", F.lit(NOTE).alias("note"), F.lit("editorial_rules").alias("method"))


def pairing_question(requests: DataFrame) -> DataFrame:
    """(request_id, question): the request as a question in words."""
    spark = requests.sparkSession
    dishes = spark.createDataFrame(DISH_WORDS, "dish string, words string")
    _, styles = rule_tables(spark)
    rows = requests.join(F.broadcast(dishes), "dish").join(F.broadcast(styles), "preference", "left")
    return rows.select("request_id", F.concat(F.lit("Подбери "), F.coalesce(F.concat("adjective", F.lit(" ")), F.lit("")), F.lit("вино к "), "words", F.lit(".")).alias("question"))


def answered_pairings(answers: DataFrame, cited: DataFrame, plan: DataFrame) -> DataFrame:
    """(request_id, place, slug, title, explanation, temperature, method): a model's answer with the rule's title and temperature.

    ``answers`` (request_id, answer), ``cited`` (request_id, place, slug): the cards it cites, in order; ``plan`` is ``planned``.
    """
    rows = answers.join(plan.select("request_id", "title", "temperature"), "request_id").join(cited, "request_id", "left")
    return rows.select("request_id", "place", "slug", "title", F.col("answer").alias("explanation"), "temperature", F.lit("model").alias("method"))


def answers_or_rules(answers: DataFrame, rules: DataFrame, key: str = "request_id") -> DataFrame:
    """Rows of answered requests, and the rules' rows of all others; ``method`` tells which."""
    return answers.unionByName(rules.join(answers.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
