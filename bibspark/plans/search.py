"""Search over a catalogue of records: fields, scopes, expansion, sorting, pages, fusion and re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import bare
from ..functions.text import first, sanitized, words
from ..operators.metadata import extract
from ..operators.ranking import fuse, ranked, rerank
from ..operators.stats import electronic
from . import boolean

#: Fields and their columns.
FIELDS = {"title": ["title"], "creator": ["creator", "contributor"], "sub": ["subject"], "isbn": ["isbn"], "issn": ["issn"]}
FIELDS["any"] = ["title", "creator", "contributor", "subject", "description", "publisher", "source", "isbn", "issn"]
SCOPES = ("all", "electronic", "courses")
SORTS = ("rank", "date", "author", "title")


@dataclass(frozen=True)
class Search:
    """A search: its expression and how results are chosen."""

    query: str
    field: str = "any"
    scope: str = "all"
    sort: str = "rank"
    limit: int = 10
    offset: int = 0
    expanded: str = ""
    comprehensive: bool = False
    rerank: bool = True
    #: Re-ranking overrides other sorts as well.
    faithful: bool = False
    ref_year: int = 2026
    cap: int = 50


def clamp(n: int, cap: int) -> int:
    return max(0, min(n, cap))


def expression(query: str, expanded: str = "") -> str:
    return f"({query}) OR ({expanded})" if expanded.strip() else query


def clean_query(query: str) -> str:
    """The sanitised expression, with the rules of the column function."""
    import re

    q = re.sub(r"\$\$[A-Za-z]", "", re.sub(r"<[^>]*>", "", query.replace("\0", "")))[:1000]
    q = re.sub(r"\s+", " ", q).strip()
    found = list(re.finditer(r"\b(?:AND|OR|NOT)\b", q))
    return q[: found[30].start()].strip() if len(found) > 30 else q


def searchable(names: list[str], numbers: bool = False) -> list[Column]:
    joined = [F.lower(F.array_join(F.col(c), boolean.BORDER)) for c in names]
    return [bare(c) for c in joined] if numbers else joined


def matches(query: str, field: str) -> Column:
    """The predicate of an expression on a field; standard numbers are compared without hyphens and spaces."""
    names = FIELDS.get(field, FIELDS["any"])
    if field in ("isbn", "issn"):
        wanted = query.replace("-", "").replace(" ", "")
        return F.exists(F.transform(F.col(names[0]), bare), lambda x: F.upper(x) == wanted.upper())
    return boolean.compile_tree(boolean.parse(query), searchable(names))


def in_scope(scope: str) -> Column:
    return {"electronic": electronic(), "courses": F.coalesce(F.col("is_course"), F.lit(False))}.get(scope, F.lit(True))


def matched_terms(query: str, field: str) -> Column:
    """How many of the expression's words the field holds."""
    wanted = boolean.terms(boolean.parse(query))
    text = F.concat_ws(" ", *[F.array_join(F.col(c), " ") for c in FIELDS.get(field, FIELDS["any"])])
    return F.size(F.array_intersect(words(text), F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)


def order_of(sort: str, query: str, field: str) -> list[Column]:
    """Rank: most words matched; date: newest first; author and title by name; ties by id."""
    last = F.asc("record_id")
    if sort == "date":
        return [F.desc(first(F.col("creationdate"))), last]
    if sort in ("author", "title"):
        return [F.asc(F.lower(first(F.col("creator" if sort == "author" else "title")))), last]
    return [F.desc(matched_terms(query, field)), last]


def one_leg(catalog: DataFrame, s: Search, field: str, scope: str, fetch: int) -> DataFrame:
    """Native results of one leg with positions from 0: a filter, then a top-k."""
    query = clean_query(expression(s.query, s.expanded))
    found = catalog.filter(in_scope(scope)).filter(matches(query, field))
    order = order_of(s.sort, query, field)
    page = found.orderBy(*order).offset(max(s.offset, 0)).limit(fetch)
    return ranked(page, *order, name="position")


def search(catalog: DataFrame, s: Search) -> DataFrame:
    """The results of a search with position. With re-ranking three times the rows are fetched (up to the cap), scored
    by the original query and cut; a comprehensive search fuses three legs before."""
    limit = clamp(s.limit, s.cap)
    again = s.rerank and (s.sort == "rank" or s.faithful)
    fetch = min(3 * limit, s.cap) if again else limit
    if s.comprehensive:
        legs = [one_leg(catalog, s, s.field, s.scope, fetch), one_leg(catalog, s, "sub", "all", fetch), one_leg(catalog, s, s.field, "electronic", fetch)]
        fused = fuse([x.withColumnRenamed("position", "rank") for x in legs], fetch)
        docs = ranked(fused, F.desc("rrf"), "first_list", "first_rank", name="position")
    else:
        docs = one_leg(catalog, s, s.field, s.scope, fetch)
    if again:
        return rerank(docs, s.query, s.ref_year, limit)
    return docs.orderBy("position").limit(limit)


def total(catalog: DataFrame, s: Search) -> DataFrame:
    query = clean_query(expression(s.query, s.expanded))
    return catalog.filter(in_scope(s.scope)).filter(matches(query, s.field)).agg(F.count("*").alias("total"))


@dataclass(frozen=True)
class Intent:
    """A structured search request."""

    terms: tuple[str, ...] = ()
    boolean_query: str = ""
    author: str = ""
    date_from: int | None = None
    date_to: int | None = None
    material_type: str = ""
    sort: str = "relevance"
    expanded_terms: tuple[str, ...] = ()


def by_intent(catalog: DataFrame, intent: Intent, limit: int = 10, cap: int = 50) -> DataFrame:
    """Results of a structured request. Types and years are compared as columns; the words compile as in any search."""
    query = intent.boolean_query or " AND ".join(f'"{t}"' if " " in t else t for t in intent.terms)
    query = expression(query, " OR ".join(intent.expanded_terms))
    found = catalog.filter(matches(clean_query(query), "any"))
    if intent.author:
        found = found.filter(matches(clean_query(intent.author), "creator"))
    if intent.material_type:
        found = found.filter(F.lower(first(F.col("type"))) == intent.material_type.lower())
    year = F.substring(first(F.col("creationdate")), 1, 4).try_cast("int")
    if intent.date_from is not None:
        found = found.filter(year >= intent.date_from)
    if intent.date_to is not None:
        found = found.filter(year <= intent.date_to)
    last = F.asc("record_id")
    order = {"date_desc": [F.desc_nulls_last(year), last], "date_asc": [F.asc_nulls_last(year), last], "title": [F.asc(F.lower(first(F.col("title")))), last]}
    return found.orderBy(*order.get(intent.sort, order_of("rank", query, "any"))).limit(clamp(limit, cap))


def rewrite(query: Column, abbreviations: dict[str, str], synonyms: dict[str, list[str]], preferred: dict[str, list[str] | str], stops: tuple[str, ...] = ()) -> Column:
    """A query rewritten by a dictionary whose keys are words or phrases in any case: abbreviations are spelled out, synonyms
    added as alternatives, deprecated terms replaced by the preferred one (`preferred` gives term: deprecated ones, or
    deprecated: term). The longest key at a place counts. Operators, quotes and parentheses stay; words in `stops` are
    never expanded. What is put in as several words is quoted, and so is not torn apart by AND. The dictionaries are literals
    of a bounded size."""
    import re

    def quoted(x: str) -> str:
        return f'"{x}"' if len(x.split()) > 1 else x

    new: dict[str, str] = {k.lower(): quoted(v) for k, v in abbreviations.items()}
    better: dict[str, str] = {}
    for k, v in preferred.items():
        better |= {v_.lower(): k for v_ in v} if isinstance(v, list) else {k.lower(): v}
    new |= {k: quoted(v) for k, v in better.items()}
    for k, v in synonyms.items():
        new[k.lower()] = "(" + " OR ".join(map(quoted, [better.get(k.lower(), k), *v])) + ")"
    for k, term in better.items():  # a preferred term's own synonyms
        if term.lower() in new:
            new[k] = new[term.lower()]
    keys = sorted((k for k in new if k not in {x.lower() for x in stops}), key=lambda k: (-len(k), k))
    word = r"[\p{L}\p{M}\p{N}]"
    phrases = "|".join(r"\s+".join(map(re.escape, k.split())) for k in keys)
    operators = r"(?<!\S)(?:AND|OR|NOT)(?!\S)"
    # between the parts that are kept as they are stand the keys; each part is looked up by itself
    pattern = rf"{operators}|(?<!{word})(?i:{phrases})(?!{word})|{word}+|[^\p{{L}}\p{{M}}\p{{N}}]+" if keys else r"(?s).+"
    parts = F.regexp_extract_all(query, F.lit(pattern), F.lit(0))
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, new[k])]) if keys else F.create_map().cast("map<string,string>")

    def looked_up(x: Column) -> Column:
        key = F.lower(F.regexp_replace(x, r"\s+", " "))
        return F.when(x.isin("AND", "OR", "NOT"), x).otherwise(F.coalesce(F.try_element_at(table, key), x))

    return F.array_join(F.transform(parts, looked_up), "")


__all__ = ["Intent", "Search", "by_intent", "clamp", "clean_query", "expression", "extract", "rewrite", "sanitized", "search", "total"]
