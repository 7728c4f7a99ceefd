"""Names of authors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import U, plain, text


def _parts(name: Column) -> Column:
    return F.filter(F.split(name, rf"{U}\s+"), lambda x: x != "")


def _initials(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.substring(n, 1, 1), F.lit("."))), " ")


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"{U}^\s+|\s+$", "")


def family(name: Column) -> Column:
    """What stands before the comma, else the last word."""
    n = plain(name)
    return F.when(n.contains(","), _strip(F.substring_index(n, ",", 1))).otherwise(text(F.try_element_at(_parts(n), F.lit(-1))))


def given(name: Column) -> Column:
    n = plain(name)
    after = _strip(F.substring(n, F.instr(n, ",") + 1, F.length(n)))
    parts = _parts(n)
    words = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(n.contains(","), after).otherwise(words)


def initialled(name: Column) -> Column:
    """Family name and initials of the others; a single name as it is."""
    n = plain(name)
    initials = _initials(_parts(given(name)))
    both = F.concat(family(name), F.when(initials == "", "").otherwise(F.concat(F.lit(", "), initials)))
    return F.when(n.contains(",") | (F.size(_parts(n)) >= 2), both).otherwise(n)


def person(name: Column) -> Column:
    """A creator of a library item."""
    null = F.lit(None).cast("string")
    return F.struct(F.lit("author").alias("creatorType"), family(name).alias("lastName"), given(name).alias("firstName"), null.alias("name"))


def shown(creator: Column) -> Column:
    """'Family, Given', the family name alone, or the single name."""
    last, first = text(creator["lastName"]), text(creator["firstName"])
    return F.when((last != "") & (first != ""), F.concat(last, F.lit(", "), first)).when(last != "", last).otherwise(F.nullif(text(creator["name"]), F.lit("")))
