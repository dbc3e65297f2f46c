"""Constrained retrieval for tables of questions, prompts from shortlists, and citations in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.functions.filters import DEFAULT_LEXICON, Lexicon, allowed, read_filters
from catalogmatch.functions.text import shortlist_line
from catalogmatch.operators.mining import GALLERY_ROWS, QUERY_ROWS, branch_top_k
from catalogmatch.sources.sinks import kept_table

SHORTLIST = 6
#: The branch of questions whose filters leave nothing.
EVERY = "every card"
#: The default templates; {n} is the number of cards, {listing} and {question} are filled in.
TEMPLATES = {
    "question": "Выбери от одного до трёх вин из списка и назови их номера в квадратных скобках.\n\nСписок вин:\n{listing}\n\nВопрос гостя: {question}",
    "item": "Ответь про вино [1]; похожие вина — [2]–[{n}].\n\nСписок вин:\n{listing}\n\nВопрос гостя: {question}",
}


def carded(catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cards with their profile, null where there is none."""
    return catalog.join(profiles, "slug", "left")


def filtered_questions(questions: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """``questions`` with the struct ``filters``."""
    return questions.withColumn("filters", read_filters(F.col("question"), lexicon))


def _kinds(asked: DataFrame, cards: DataFrame) -> DataFrame:
    """(kind, filters, free, items, n): every different filter of some questions, how many of these are about no item and about one, and how many
    cards pass it; the lexicon bounds how many filters there are."""
    kinds = asked.groupBy("kind", "filters").agg(F.count_if(F.col("about_slug").isNull()).alias("free"), F.count("about_slug").alias("items"))
    passes = allowed(F.col("filters"), F.col("category"), F.col("profile.sparkling"), F.col("profile.sweetness"))
    counts = cards.select("category", "profile").join(F.broadcast(kinds.select("kind", "filters")), passes).groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shortlists(questions: DataFrame, cards: DataFrame, k: int = SHORTLIST, per_producer: int = 2) -> DataFrame:
    """(question_id, position, slug) of questions (question_id, question, about_slug, vec): the ``k`` most similar cards that pass the
    question's filters, at most ``per_producer`` of a producer. ``cards`` (slug, vec, category, winery, profile).

    A question about an item starts from that item's vector, has the item itself at position 1 and no fallback; any other falls back
    to similarity alone where its filters leave nothing.

    All questions are searched at once: those with equal filters form a branch, whose gallery holds the cards that pass, so
    rejected pairs are never scored. Whether a filter leaves nothing is known from a count of its cards, before any search.
    """
    kind = F.to_json("filters", {"ignoreNullFields": "false"})
    cards = kept_table(cards.select("slug", "vec", F.col("winery").alias("producer"), "category", "profile"), "cards")
    asked = kept_table(filtered_questions(questions).select("question_id", "about_slug", "vec", "filters", kind.alias("kind")), "questions")
    #: Only questions about an item meet the cards: the others have no key, and a join would put them all into one task.
    own = cards.select(F.col("slug").alias("about_slug"), F.col("vec").alias("own"))
    items = asked.join(own, "about_slug").where("own IS NOT NULL").withColumn("vec", F.col("own"))
    asked = asked.where("about_slug IS NULL").unionByName(items.drop("own"))
    kinds = kept_table(_kinds(asked, cards), "kinds")
    falls_back = F.col("about_slug").isNull() & (F.col("n") == 0)
    searched = asked.join(F.broadcast(kinds.select("kind", "n")), "kind").select(F.col("question_id").alias("query_id"), F.when(falls_back, EVERY).otherwise(F.col("kind")).alias("branch"), "vec", "about_slug")
    left_over = kinds.where("n = 0").agg(F.sum("free").alias("asked")).where("asked > 0")
    branches = kinds.where("n > 0").select(F.col("kind").alias("branch"), "filters", "n", (F.col("free") + F.col("items")).alias("asked")).unionByName(
        left_over.select(F.lit(EVERY).alias("branch"), F.lit(None).cast(kinds.schema["filters"].dataType).alias("filters"), F.lit(cards.count()).alias("n"), "asked")
    )
    passes = allowed(F.col("filters"), F.col("category"), F.col("profile.sparkling"), F.col("profile.sweetness"))
    gallery = cards.join(F.broadcast(branches), F.col("filters").isNull() | passes).select("slug", "branch", "vec", "producer")
    selves = searched.where("about_slug IS NOT NULL").select("query_id", F.col("about_slug").alias("slug"))
    needed = lambda n, rows: F.greatest(F.lit(1), F.ceil(F.col(n) / rows)).cast("int")
    parts = branches.select("branch", needed("n", GALLERY_ROWS).alias("gallery_parts"), needed("asked", QUERY_ROWS).alias("query_parts"))
    top = branch_top_k(searched.select("query_id", "branch", "vec"), gallery, k, selves, per_producer=per_producer, parts=parts)
    about = top.join(selves.select("query_id", F.lit(1).alias("shift")), "query_id", "left").withColumn("position", F.col("branch_rank") + F.coalesce("shift", F.lit(0))).where(F.col("position") <= k)
    found = about.select(F.col("query_id").alias("question_id"), "position", "slug")
    return found.unionByName(selves.select(F.col("query_id").alias("question_id"), F.lit(1).alias("position"), "slug"))


def prompts(questions: DataFrame, shortlist: DataFrame, cards: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(question_id, prompt): the template of the question's mode, filled with the numbered shortlist and the question."""
    lines = shortlist.join(cards, "slug").select("question_id", "position", shortlist_line(F.col("position")).alias("line"))
    listed = lines.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("listing"), F.count("*").alias("n")
    )
    rows = questions.join(listed, "question_id")
    template = F.when(F.col("about_slug").isNull(), templates["question"]).otherwise(templates["item"])
    filled = F.replace(template, F.lit("{n}"), F.col("n").cast("string"))
    #: Listing and question go in last, in one pass each, so that braces in them stay as they are.
    head, tail = F.split_part(filled, F.lit("{listing}"), F.lit(1)), F.split_part(filled, F.lit("{listing}"), F.lit(2))
    before, after = F.split_part(tail, F.lit("{question}"), F.lit(1)), F.split_part(tail, F.lit("{question}"), F.lit(2))
    return rows.select("question_id", F.concat(head, "listing", before, "question", after).alias("prompt"))


def citations(answers: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(question_id, cited array<int>): numbers in square brackets that the shortlist has, first mentions in order.

    ``answers`` (question_id, answer, about_slug). The item asked about comes first; without any citation it is [1].
    """
    sizes = shortlist.groupBy("question_id").agg(F.count("*").alias("n"))
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    inside = F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.col("n"))))
    led = F.when(F.col("about_slug").isNotNull(), F.concat(F.array(F.lit(1)), F.array_remove(inside, 1))).otherwise(inside)
    cited = F.when(F.size(led) > 0, led).otherwise(F.array(F.lit(1)))
    return answers.join(sizes, "question_id").select("question_id", "about_slug", cited.alias("cited"))


def cited_items(answers: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(question_id, place, position, slug, footnote): cited cards in order; the footnote counts those other than the item asked about."""
    rows = citations(answers, shortlist).select("question_id", "about_slug", F.posexplode("cited").alias("place", "position"))
    rows = rows.join(shortlist, ["question_id", "position"]).withColumn("place", F.col("place") + 1)
    other = ~F.col("slug").eqNullSafe(F.col("about_slug"))
    count = F.sum(other.cast("int")).over(Window.partitionBy("question_id").orderBy("place"))
    return rows.select("question_id", "place", "position", "slug", F.when(other, count).cast("int").alias("footnote"))
