"""Hard filters read from the words of a question, and the predicate that applies them. The lexicon is data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """Stems in order of precedence. ``still`` and ``fizzy`` are patterns, the first tested first."""

    colours: tuple[tuple[str, str], ...]
    still: str
    fizzy: str
    sweetness: tuple[tuple[str, tuple[str, ...]], ...]
    dessert: str
    savoury: str
    sweet_styles: tuple[str, ...]


#: The default lexicon (Russian stems and the values they ask for).
DEFAULT_LEXICON = Lexicon(
    colours=(("красн", "Красное"), ("бел", "Белое"), ("розов", "Розовое"), ("розе", "Розовое"), ("оранж", "Оранжевое")),
    still=r"\bне\s+игрист|\bбез\s+пузыр|\bтих(ое|ого|им)\b",
    fizzy=r"\b(игрист|шампанск|брют|пузырьк|петнат|пет-нат)",
    sweetness=(
        ("полусладк", ("полусладкое",)),
        ("полусух", ("полусухое",)),
        ("сладк", ("сладкое", "полусладкое")),
        ("сух", ("сухое", "брют", "экстра брют", "брют натюр")),
    ),
    dessert=r"\b(десерт|торт|пирож|шоколад|мороженое)",
    savoury=r"\b(мяс|стейк|утк|утин|гус|кур|цыпл|индейк|шашлык|гриль|барбекю|бургер|рыб|лосос|форел|тунц|морепродукт|кревет|миди|устриц|кальмар|паст|пицц|плов|баранин|ягнят|свинин|говядин|телятин|дичь|оленин|колбас|овощ|салат|гриб|суш)",
    sweet_styles=("сладкое", "полусладкое"),
)


def read_filters(question: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """struct(category, sparkling, sweetness, not_sweet) of a question; what the words leave open is null (false for not_sweet)."""
    text = F.translate(F.lower(question), "ё", "е")
    says = lambda pattern: text.rlike(f"(?U){pattern}")
    first = lambda choices: F.coalesce(*(F.when(says(rf"\b{stem}"), value) for stem, value in choices))
    allowed = first([(stem, F.array(*map(F.lit, values))) for stem, values in lexicon.sweetness])
    sweet = F.coalesce(allowed, F.when(says(lexicon.dessert), F.array(*map(F.lit, lexicon.sweet_styles))))
    return F.struct(
        first([(stem, F.lit(value)) for stem, value in lexicon.colours]).alias("category"),
        F.when(says(lexicon.still), False).when(says(lexicon.fizzy), True).alias("sparkling"),
        sweet.alias("sweetness"),
        (sweet.isNull() & F.coalesce(says(lexicon.savoury), F.lit(False))).alias("not_sweet"),
    )


def allowed(filters: Column, category: Column, sparkling: Column, sweetness: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """True where an item passes the filters. Unknown sparkling counts as still; unknown sweetness fails a wanted sweetness and passes not_sweet."""
    yes = F.lit(True)
    return (
        F.coalesce(category == filters.category, filters.category.isNull())
        & F.coalesce(F.coalesce(sparkling, F.lit(False)) == filters.sparkling, yes)
        & F.when(filters.sweetness.isNull(), yes).otherwise(F.coalesce(F.array_contains(filters.sweetness, sweetness), F.lit(False)))
        & ~(filters.not_sweet & F.coalesce(sweetness.isin(*lexicon.sweet_styles), F.lit(False)))
    )
