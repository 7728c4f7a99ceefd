"""Cleaning and rendering of strings. A null, a missing list and an empty list all count as ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and what replaces them.
REPLACEMENTS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", " ": " "}
#: White space as Unicode has it, for Java's regular expressions.
U = "(?U)"


def let(value: Column, body) -> Column:
    """A value bound once inside an expression: a column that a lambda uses is computed for each element if Catalyst
    puts its expression in its place."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # a body of two parameters would get the index


def first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def filled(value: Column) -> Column:
    """The value, null where it is empty."""
    return F.nullif(value, F.lit(""))


def first_of(*values: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*map(filled, values), F.lit(""))


def has(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) > 0


def clean(value: Column) -> Column:
    """Typographic quotes, dashes, ellipses and hard spaces to plain ones."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REPLACEMENTS.items(), text(value))


def plain(value: Column) -> Column:
    """What stands before the first subfield mark, trimmed."""
    return F.regexp_replace(F.substring_index(text(value), "$$", 1), rf"{U}^\s+|\s+$", "")


def words(value: Column) -> Column:
    """Distinct runs of a-z and digits of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(value)), F.lit("[a-z0-9]+"), F.lit(0)))


def normal_title(value: Column) -> Column:
    """Lower case without punctuation; white space runs to one space."""
    bare = F.regexp_replace(F.lower(text(value)), rf"{U}[^\w\s]", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"{U}\s+", " "), "^ | $", "")


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal normal titles, 0 if either is empty, else the Jaccard similarity of their words."""
    a, b = normal_title(a), normal_title(b)
    x, y = F.split(a, " "), F.split(b, " ")
    share = F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(share)


def sanitized(query: Column, length: int = 1000, operators: int = 30) -> Column:
    """A search expression without NULs, tags and subfield marks, cut to a length, and before one operator too many."""
    q = F.replace(text(query), F.lit("\0"), F.lit(""))
    q = F.regexp_replace(q, "<[^>]*>", "")
    q = F.regexp_replace(q, r"\$\$[A-Za-z]", "")
    q = F.substring(q, 1, length)
    q = F.regexp_replace(F.regexp_replace(q, rf"{U}\s+", " "), "^ | $", "")
    # parts that start at an operator each, but for what stands before the first one
    parts = F.split(q, r"(?=\b(?:AND|OR|NOT)\b)")
    whole = operators + F.when(q.rlike(r"^(?:AND|OR|NOT)\b"), 0).otherwise(1)
    return F.when(F.size(parts) <= whole, q).otherwise(F.rtrim(F.array_join(F.slice(parts, 1, whole), "")))


def csv_field(value: Column) -> Column:
    """Quotes doubled; the whole quoted if it holds a comma, a quote or a line feed."""
    doubled = F.replace(text(value), F.lit('"'), F.lit('""'))
    return F.when(doubled.rlike('[,"\n]'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(doubled)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def limited(value: Column, chars: int, notice: str) -> Column:
    """A text cut to a number of characters, with a notice where it was."""
    return F.when(F.length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit(notice))).otherwise(value)
