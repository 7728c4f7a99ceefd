"""The tools by name. Each takes a Library (its tables) and arguments, and returns a DataFrame.

`call` gives a tool's plan and raises its errors. `dispatch` runs it: the result is written to the shared folder, an error
becomes a row, and the call is counted in the library's metrics."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links
from ..functions.text import limited
from ..operators import cite, resolve, stats
from ..operators.metadata import extract, item_rows, items
from ..schema import Settings
from ..session import written
from ..sources import sinks
from . import search as s


@dataclass
class Library:
    """The tables that tools read."""

    spark: SparkSession
    catalog: DataFrame
    items: DataFrame | None = None
    collections: DataFrame | None = None
    attachments: DataFrame | None = None
    registry: DataFrame | None = None
    texts: DataFrame | None = None
    calls: DataFrame | None = None
    log: DataFrame | None = None
    settings: Settings | None = None
    #: Calls of `dispatch`: tool, latency in seconds, failed.
    made: list[tuple[str, float, bool]] = field(default_factory=list)

    def limits(self) -> Settings:
        return self.settings or Settings()

    def all_calls(self) -> DataFrame:
        """The calls table and those of this library."""
        own = self.spark.createDataFrame(self.made, "tool STRING, latency DOUBLE, failed BOOLEAN")
        return own if self.calls is None else own.unionByName(self.calls.select("tool", F.col("latency").cast("double").alias("latency"), "failed"))


TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


def call(lib: Library, name: str, **args) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name}")
    return TOOLS[name](lib, **args)


def dispatch(lib: Library, name: str, **args) -> DataFrame:
    """The result of a tool, computed; or one row, `error`, that says why there is none."""
    began, failed = time.perf_counter(), True
    try:
        out = written(call(lib, name, **args))
        failed = False
        return out
    except Exception as e:  # whatever a tool's arguments or tables break, the caller gets it as text
        text = str(e).strip() or type(e).__name__
        return lib.spark.createDataFrame([(f"Error in {name}: {text}",)], "error STRING")
    finally:
        lib.made.append((name, time.perf_counter() - began, failed))


@tool
def search_library(
    lib: Library, query: str, limit: int = 10, offset: int = 0, field: str = "any", sort: str = "rank", resource_type: str = "all", expanded_terms: str = "", comprehensive: bool = False, ref_year: int = 2026, faithful: bool = False
) -> DataFrame:
    on = lib.limits().flags
    return s.search(lib.catalog, s.Search(query, field, resource_type, sort, limit, offset, expanded_terms, comprehensive and on["fusion"], on["rerank"], faithful, ref_year, lib.limits().search_cap))


def _by_field(lib: Library, query: str, field: str, limit: int, scope: str = "all") -> DataFrame:
    return s.one_leg(lib.catalog, s.Search(query), field, scope, max(limit, 0)).orderBy("position")


@tool
def search_by_author(lib: Library, author: str, limit: int = 10) -> DataFrame:
    return _by_field(lib, author, "creator", limit)


@tool
def search_by_subject(lib: Library, subject: str, limit: int = 10) -> DataFrame:
    return _by_field(lib, subject, "sub", limit)


@tool
def search_by_isbn(lib: Library, isbn: str) -> DataFrame:
    return _by_field(lib, isbn, "isbn", lib.limits().isbn_limit)


@tool
def search_electronic_resources(lib: Library, query: str, limit: int = 10) -> DataFrame:
    return _by_field(lib, query, "any", limit, "electronic")


@tool
def get_item_details(lib: Library, record_id: str) -> DataFrame:
    return sinks.detail(lib.catalog.filter(F.col("record_id") == record_id))


@tool
def get_full_text_links(lib: Library, record_id: str, shown: int = 5) -> DataFrame:
    one = lib.catalog.filter(F.col("record_id") == record_id).select("record_id", links.bundle(F.col).alias("l"))
    return one.select("record_id", *(F.slice(f"l.{c}", 1, shown).alias(c) for c in ("html_links", "pdf_links", "source_links")), "l.doi_url", "l.open_access")


def _metadata(lib: Library, records: DataFrame) -> DataFrame:
    meta = extract(records)
    return resolve.enrich(meta, lib.registry).drop("enriched") if lib.registry is not None and lib.limits().flags["enrich"] else meta


@tool
def generate_citation(lib: Library, record_id: str, format: str = "apa") -> DataFrame:  # noqa: A002
    return cite.citations(_metadata(lib, lib.catalog.filter(F.col("record_id") == record_id)), format)


@tool
def batch_generate_citations(lib: Library, record_ids: list[str], format: str = "apa") -> DataFrame:  # noqa: A002
    """pos, id, found and citation of each place in the list; ids that are unknown say so."""
    ids = resolve.id_list(lib.spark, record_ids, lib.limits().batch_cap)
    wanted = lib.catalog.join(ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")
    made = cite.citations(_metadata(lib, wanted), format)
    out = resolve.by_id(ids, made)
    return out.select("pos", "id", "found", F.coalesce("citation", F.lit(cite.missing(format))).alias("citation"))


@tool
def export_search_results(lib: Library, query: str, format: str = "bibtex", limit: int = 10) -> DataFrame:  # noqa: A002
    limit = s.clamp(limit, lib.limits().export_cap)
    docs = s.one_leg(lib.catalog, s.Search(query), "any", "all", limit)
    n = s.total(lib.catalog, s.Search(query)).first()["total"]
    return sinks.export(docs, format, query, n)


@tool
def batch_isbn_lookup(lib: Library, isbn_list: list[str]) -> DataFrame:
    return resolve.by_isbn(resolve.id_list(lib.spark, isbn_list, lib.limits().batch_cap), lib.catalog)


@tool
def read_article(lib: Library, record_id: str) -> DataFrame:
    """Text of a record, or of a library item by its 8-character key. texts: record_id, text."""
    import re

    rows = lib.texts
    if re.fullmatch(r"[A-Z0-9]{8}", record_id) and lib.items is not None:
        rows = rows.join(lib.items.filter(F.col("key") == record_id).select("record_id"), "record_id", "left_semi")
    else:
        rows = rows.filter(F.col("record_id") == record_id)
    most = lib.limits().text_chars
    return rows.select("record_id", limited(F.col("text"), most, f"\n\n[Text truncated at {most:,} characters]").alias("text"))


@tool
def save_item(lib: Library, record_id: str, collection_name: str | None = None, parent_collection: str | None = None) -> DataFrame:
    return batch_save_items(lib, [record_id], collection_name, parent_collection)


@tool
def batch_save_items(lib: Library, record_ids: list[str], collection_name: str | None = None, parent_collection: str | None = None) -> DataFrame:
    """pos, id, status and the item row to append for those saved, in a collection that is made if it is missing, below a
    parent that is made likewise. New collections join the library's collections table; `sinks.append` stores both."""
    ids = resolve.id_list(lib.spark, record_ids, lib.limits().batch_cap)
    wanted = lib.catalog.join(ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")
    meta = _metadata(lib, wanted)
    statuses = resolve.save_statuses(ids, meta, lib.items)
    new = items(meta, lib.limits().trace_prefix)
    inside = F.array(F.lit(_collection(lib, collection_name, parent_collection))) if collection_name else F.array().cast("array<string>")
    new = new.withColumn("collections", inside)
    return statuses.join(new.withColumnRenamed("record_id", "_r"), (F.col("id") == F.col("_r")) & (F.col("status") == "saved"), "left").drop("_r").orderBy("pos")


def _collection(lib: Library, name: str, parent: str | None) -> str:
    """The key of a collection, made if there is none."""
    if lib.collections is None:
        lib.collections = lib.spark.createDataFrame([], "key STRING, name STRING, parent_key STRING, num_items INT")
    parent_key = None
    if parent:
        lib.collections, parent_key = resolve.find_or_create(lib.collections, parent)
    lib.collections, key = resolve.find_or_create(lib.collections, name, parent_key)
    return key


@tool
def save_counts(lib: Library, record_ids: list[str], collection_name: str | None = None, parent_collection: str | None = None) -> DataFrame:
    """saved, skipped and failed of a batch, one row."""
    return resolve.status_counts(batch_save_items(lib, record_ids, collection_name, parent_collection))


@tool
def list_collections(lib: Library) -> DataFrame:
    return resolve.with_parents(lib.collections).orderBy("key")


@tool
def search_items(lib: Library, query: str, limit: int = 20) -> DataFrame:
    """Library items whose title or tags match, newest first by date."""
    from . import boolean

    text = F.lower(F.concat_ws(boolean.BORDER, "title", F.array_join("tags", boolean.BORDER), "publication_title"))
    found = lib.items.filter(boolean.compile_tree(boolean.parse(s.clean_query(query)), [text]))
    return item_rows(found).orderBy(F.desc("date"), "key").limit(s.clamp(limit, 100))


@tool
def get_collection_items(lib: Library, collection_name: str, limit: int = 50) -> DataFrame:
    one = resolve.find_collection(lib.collections, collection_name)
    inside = resolve.members(lib.items, one)
    return item_rows(lib.items.join(inside.select(F.col("item_key").alias("key")), "key", "left_semi")).orderBy("key").limit(s.clamp(limit, 100))


@tool
def items_without_pdf(lib: Library) -> DataFrame:
    return item_rows(resolve.without_pdf(lib.items, lib.attachments))


@tool
def get_diagnostics(lib: Library, include_recent_errors: bool = True) -> DataFrame:
    """A report by section, in order: credentials that are not set, the last severe lines of the log, and the metrics of calls.
    section, line_no, line. An empty section says so in a line."""
    one = "section STRING, line_no LONG, line STRING"
    missing = lib.limits().credentials()
    parts = [lib.spark.createDataFrame([("credentials", i, x) for i, x in enumerate(missing)] or [("credentials", 0, "all set")], one)]
    if include_recent_errors:
        lines = stats.last_errors(lib.log) if lib.log is not None else lib.spark.createDataFrame([], "line_no LONG, line STRING")
        parts.append(_or_none(lib, "errors", lines.select(F.lit("errors").alias("section"), "line_no", "line"), "(no errors or warnings found)" if lib.log is not None else "(log not found)"))
    metrics = stats.call_metrics(lib.all_calls())
    shown = F.concat("tool", F.lit(": "), F.col("n").cast("string"), F.lit(" calls, "), F.col("n_errors").cast("string"), F.lit(" errors, avg "), F.format_string("%.2f", "avg_latency"), F.lit("s"))
    order = F.row_number().over(Window.orderBy("tool")) - 1  # one row per tool: a handful
    parts.append(_or_none(lib, "metrics", metrics.select(F.lit("metrics").alias("section"), order.cast("long").alias("line_no"), shown.alias("line")), "(no metrics recorded yet)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.when(F.col("section") == "credentials", 0).when(F.col("section") == "errors", 1).otherwise(2)
    return out.orderBy(place, "line_no")


def _or_none(lib: Library, section: str, lines: DataFrame, none: str) -> DataFrame:
    """A section's few lines, or one that says there are none."""
    empty = lib.spark.createDataFrame([(section, 0, none)], "section STRING, line_no LONG, line STRING")
    return lines.unionByName(empty.join(lines.limit(1).select("section"), "section", "left_anti"))


@tool
def clear_cache(lib: Library) -> DataFrame:
    lib.spark.catalog.clearCache()
    return lib.spark.createDataFrame([("cleared",)], "status STRING")


def _session(lib: Library, what: str) -> DataFrame:
    """Sessions with remote services are none of the engine's; the tool says so instead of failing."""
    return lib.spark.createDataFrame([(what, "not needed")], "session STRING, status STRING")


@tool
def get_token_status(lib: Library) -> DataFrame:
    return _session(lib, "catalogue")


@tool
def authenticate(lib: Library, force: bool = False) -> DataFrame:
    return _session(lib, "catalogue")


@tool
def get_items_status(lib: Library) -> DataFrame:
    return _session(lib, "items")


@tool
def items_authenticate(lib: Library, force: bool = False) -> DataFrame:
    return _session(lib, "items")
