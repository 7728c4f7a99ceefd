"""The five signals of re-ranking and other scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first, has, text, words

#: Weights of the signals.
WEIGHTS = {"title": 0.35, "recency": 0.20, "fulltext": 0.20, "type": 0.15, "complete": 0.10}
#: Scores of resource types; all others have 0.5.
TYPES = {"article": 1.0, "journal_article": 1.0, "review": 1.0, "book": 0.7, "book_chapter": 0.7, "conference_proceeding": 0.6, "dissertation": 0.6}


def title_match(title: Column, query: Column) -> Column:
    """The share of the query's distinct words that the title holds."""
    q, t = words(query), words(title)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0))


def recency(date: Column, ref_year: int) -> Column:
    year = F.substring(text(date), 1, 4).try_cast("int")
    return F.when(year.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.05 * (F.lit(ref_year) - year).cast("double")))


def full_text(r, strict: bool = False) -> Column:
    """1 with any link, or where the availability holds 'available'. So does 'unavailable', unless strict."""
    a = F.lower(first(r("availability")))
    free = a.contains("available") & (~a.contains("unavailable") if strict else F.lit(True))
    return F.when(free | has(r("linktorsrc")) | has(r("linktohtml")) | has(r("linktopdf")), 1.0).otherwise(0.0)


def type_match(kind: Column) -> Column:
    out = F.lit(0.5)
    for name, score in TYPES.items():
        out = F.when(F.lower(text(kind)) == name, score).otherwise(out)
    return out


def completeness(r) -> Column:
    parts = [(0.34, first(r("doi")) != ""), (0.33, first(r("creator")) != ""), (0.33, first(r("creationdate")) != "")]
    return F.least(F.lit(1.0), sum((F.when(c, w).otherwise(0.0) for w, c in parts), F.lit(0.0)))


def signals(r, query: Column, ref_year: int, strict: bool = False) -> dict[str, Column]:
    return {
        "title": title_match(first(r("title")), query),
        "recency": recency(first(r("creationdate")), ref_year),
        "fulltext": full_text(r, strict),
        "type": type_match(first(r("type"))),
        "complete": completeness(r),
    }


def composite(parts: dict[str, Column]) -> Column:
    """The weighted sum, in fixed order."""
    out = F.lit(0.0)
    for name, w in WEIGHTS.items():
        out = out + w * parts[name]
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def discount(position: Column) -> Column:
    """The gain of a position counted from 0."""
    return 1.0 / F.log2(position.cast("double") + 2.0)


def backoff(attempt: Column, base: float, most: float, throttled: Column) -> Column:
    """The delay before an attempt: doubled each time up to a limit, and four times that when throttled."""
    delay = F.least(base * F.pow(F.lit(2.0), attempt.cast("double")), F.lit(most))
    return F.when(throttled, F.least(4 * delay, F.lit(most))).otherwise(delay)
