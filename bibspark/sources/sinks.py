"""Writers: search exports, reports, library inserts and evaluation results. Rendering stays in Columns; only a report of
capped length is joined to one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_pdf
from ..functions.text import clean, csv_field, filled, first, has, text
from ..operators import cite
from ..operators.metadata import extract
from ..operators.stats import electronic

EXPORT = ("record_id", "title", "authors", "date", "type", "publisher", "isbn", "issn", "doi")
#: The opening of each export's header line.
HEADERS = {"json": "// JSON Export", "csv": "# CSV Export", "bibtex": "% BibTeX Export", "ris": "# RIS Export"}


def export_rows(docs: DataFrame) -> DataFrame:
    """The nine fields of JSON and CSV exports: authors as they stand, no clean-up."""
    plain = {c: first(F.col(s)) for c, s in (("title", "title"), ("date", "creationdate"), ("type", "type"), ("publisher", "publisher"), ("isbn", "isbn"), ("issn", "issn"), ("doi", "doi"))}
    extra = [c for c in ("position",) if c in docs.columns]
    return docs.select(
        text(F.col("record_id")).alias("record_id"),
        plain["title"].alias("title"),
        F.coalesce("creator", F.array().cast("array<string>")).alias("authors"),
        *(plain[c].alias(c) for c in ("date", "type", "publisher", "isbn", "issn", "doi")),
        *extra,
    )


def csv_line(rows: DataFrame) -> Column:
    cells = [csv_field(F.array_join(F.col(c), "; ") if c == "authors" else F.col(c)) for c in EXPORT]
    return F.concat_ws(",", *cells)


def json_line() -> Column:
    return F.to_json(F.struct(*EXPORT))


def entries(docs: DataFrame, fmt: str) -> DataFrame:
    """record_id and the entry of each document in a format. Write it with `.write.text` at any size."""
    if fmt in ("json", "csv"):
        rows = export_rows(docs)
        return rows.select("record_id", (json_line() if fmt == "json" else csv_line(rows)).alias("entry"))
    return cite.citations(extract(docs), fmt).withColumnRenamed("citation", "entry")


def export(docs: DataFrame, fmt: str, query: str, total: int, position: str = "position", cap: int = 100) -> DataFrame:
    """One row, `output`: header and entries of a result list in order. The list is capped, so one row can hold it."""
    fmt = fmt.lower()
    if fmt not in HEADERS:
        return docs.sparkSession.createDataFrame([(f"Unknown export format: {fmt}",)], "output STRING")
    kept = docs.orderBy(position).limit(max(0, min(cap, 100)))
    if fmt in ("json", "csv"):
        rows = export_rows(kept)
        line = csv_line(rows) if fmt == "csv" else F.lit(None).cast("string")
        # keys and indentation as a pretty printer sets them
        item = F.struct(F.col(position).alias("_p"), line.alias("csv"), F.struct(*EXPORT).alias("row"))
    else:
        meta = extract(kept).join(kept.select("record_id", position), "record_id")
        rows = meta
        item = F.struct(F.col(position).alias("_p"), cite.render(fmt).alias("csv"), F.lit(None).cast("string").alias("row"))
    joined = rows.select(item.alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count("*").alias("n"))
    head = F.concat(F.lit(HEADERS[fmt] + ": "), F.col("n").cast("string"), F.lit(f" of {total:,} results for '{query}'\n" + ("" if fmt == "csv" else "\n")))
    if fmt == "json":
        body = F.to_json(F.transform("xs", lambda x: x["row"]), {"pretty": "true"})
    else:
        lines = F.array_join(F.transform("xs", lambda x: x["csv"]), "\n" if fmt == "csv" else "\n\n")
        body = F.concat(F.lit(",".join(EXPORT) + "\n"), lines) if fmt == "csv" else lines
    return joined.select(F.when(F.col("n") == 0, "No results found to export.").otherwise(F.concat(head, body)).alias("output"))


def _line(label: str, value: Column) -> Column:
    """An indented line, nothing for an empty value."""
    return F.concat(F.lit(f"   {label}: "), filled(value), F.lit("\n"))


def result_lines(docs: DataFrame, position: str = "position") -> DataFrame:
    """position and text of each result in a report. The labels and their order."""
    subjects = F.transform(F.slice("subject", 1, 3), lambda s: F.substring_index(s, "$$", 1))
    creators = F.coalesce("creator", "contributor", F.array().cast("array<string>"))
    who = F.when(has(creators), clean(F.get(creators, F.lit(0)))).otherwise("Unknown")
    note = first(F.col("description"))
    links = has(F.col("linktorsrc")) | has(F.col("linktohtml"))
    parts = [
        F.concat((F.col(position) + 1).cast("string"), F.lit(". "), clean(F.coalesce(F.get("title", F.lit(0)), F.lit("No title"))), F.lit("\n")),
        F.concat(F.lit("   Author: "), who, F.lit("\n")),
        F.concat(F.lit("   Date: "), F.coalesce(F.get("creationdate", F.lit(0)), F.lit("N/A")), F.lit("\n")),
        F.concat(F.lit("   Type: "), F.coalesce(F.get("type", F.lit(0)), F.lit("N/A")), F.lit("\n")),
        F.when(has(F.col("subject")), F.concat(F.lit("   Subjects: "), F.array_join(subjects, ", "), F.lit("\n"))),
        *(_line(label, clean(first(F.col(c)))) for label, c in (("Source", "source"), ("Publisher", "publisher"))),
        *(_line(label, first(F.col(c))) for label, c in (("ISBN", "isbn"), ("ISSN", "issn"), ("DOI", "doi"))),
        _line("Record ID", text(F.col("record_id"))),
        _line("Availability", first(F.col("availability"))),
        F.when(note != "", F.concat(F.lit("   Description: "), clean(F.substring(note, 1, 300)), F.lit("...\n"))),
        F.when(links, F.lit("   Full Text: Available\n")),
    ]
    return docs.select(position, F.concat_ws("", *parts, F.lit("\n")).alias("text"))


def report(docs: DataFrame, total: int, query: str = "", field: str = "any", sort: str = "rank", position: str = "position") -> DataFrame:
    """One row, `output`: the report of a capped result list with its footer. The labels and their order."""
    from ..operators.stats import top_subjects

    body = result_lines(docs, position).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "text"))), lambda x: x["text"]), "").alias("body"), F.count("*").alias("n"))
    subjects = top_subjects(docs.select(F.col(position).alias("position"), "subject")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "k", "subject"))), lambda x: x["subject"]), ", ").alias("subjects"))
    count = docs.agg(F.count_if(electronic()).alias("online"))
    head = F.lit(f"Found {total:,} total results\n" + "=" * 60 + "\n")
    foot = F.concat_ws(
        "",
        F.lit(f"--- Search Metadata ---\nQuery: {query} | Field: {field} | Sort: {sort}\n"),
        F.concat(F.lit("Top subjects across results: "), filled(text(F.col("subjects"))), F.lit("\n")),
        F.concat(F.lit("Electronic resources available: "), F.col("online").cast("string"), F.lit("\n")),
    )
    one = body.crossJoin(subjects).crossJoin(count)  # one row each
    return one.select(F.concat(head, "body", F.when(F.col("n") > 0, foot).otherwise("")).alias("output"))


def detail(docs: DataFrame) -> DataFrame:
    """record_id and the full description of each record: 10 subjects and 5 holdings at most. The labels and
    their order."""
    bar = "=" * 60
    cleaned = {c: F.array_join(F.transform(c, clean), ", ") for c in ("creator", "contributor")}

    def section(label: str, cond: Column, value: Column) -> Column:
        return F.when(cond, F.concat(F.lit(label), value, F.lit("\n")))

    def one(label: str, c: str, cleaned_up: bool = False) -> Column:
        v = first(F.col(c))
        return section(label, v != "", clean(v) if cleaned_up else v)

    def several(label: str, c: str) -> Column:
        return section(label, has(F.col(c)), F.array_join(c, ", "))

    def lines(values: Column, before: str, body) -> Column:
        return F.array_join(F.transform(values, lambda v: F.concat(F.lit(before), body(v))), "\n")

    hold = F.slice("holding", 1, 5)
    parts = [
        F.lit(f"{bar}\nITEM DETAILS\n{bar}\n\n"),
        F.concat(F.lit("Title: "), clean(F.coalesce(F.get("title", F.lit(0)), F.lit("No title"))), F.lit("\n\n")),
        section("Author(s): ", has(F.col("creator")), cleaned["creator"]),
        section("Contributor(s): ", has(F.col("contributor")), cleaned["contributor"]),
        one("Publication Date: ", "creationdate"),
        one("Type: ", "type"),
        one("Publisher: ", "publisher", True),
        one("Source/Journal: ", "source", True),
        F.lit("\n--- Identifiers ---\n"),
        several("ISBN: ", "isbn"),
        several("ISSN: ", "issn"),
        several("DOI: ", "doi"),
        section("Record ID: ", text(F.col("record_id")) != "", F.col("record_id")),
        section("\n--- Description ---\n", has(F.col("description")), lines(F.col("description"), "", clean)),
        section("\n--- Subjects ---\n", has(F.col("subject")), lines(F.slice("subject", 1, 10), "- ", lambda s: s)),
        F.lit("\n--- Access Links ---\n"),
        F.when(has(F.col("linktohtml")), F.lit("HTML Link: Available\n")),
        F.when(has(F.col("linktorsrc")), F.lit("Full Text Link: Available\n")),
        F.when(has(F.col("linktopdf")), F.lit("PDF Link: Available\n")),
        section("\nAvailability: ", has(F.col("availability")), F.array_join("availability", ", ")),
        section("\n--- Holdings ---\n", has(F.col("holding")), lines(hold, "  ", lambda h: F.concat(text(h["libraryCode"]), F.lit(" - "), text(h["subLocationCode"]), F.lit(": "), text(h["callNumber"])))),
    ]
    return docs.select("record_id", F.concat_ws("", *parts).alias("detail"))


def append(rows: DataFrame, path: str) -> None:
    """Items, collections or attachments added to a table."""
    rows.write.mode("append").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """One JSON line per evaluation run."""
    rows.write.mode("append").json(path)


def pdf_files(downloads: DataFrame, path: str) -> DataFrame:
    """Stores downloads whose content is a PDF and returns the others with the reason. downloads: url, content."""
    good = is_pdf(F.col("content"))
    downloads.filter(good).write.mode("append").parquet(path)
    return downloads.filter(~good).select("url", F.lit("not a PDF").alias("error"))
