"""Readers: catalogue tables, JSON files, logs, PDFs and REST pages."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The nested record as a service returns it.
NESTED = (
    "pnx STRUCT<display: STRUCT<title: ARRAY<STRING>, creator: ARRAY<STRING>, contributor: ARRAY<STRING>, creationdate: ARRAY<STRING>, publisher: ARRAY<STRING>, "
    "type: ARRAY<STRING>, source: ARRAY<STRING>, description: ARRAY<STRING>, subject: ARRAY<STRING>>, "
    "addata: STRUCT<isbn: ARRAY<STRING>, issn: ARRAY<STRING>, doi: ARRAY<STRING>, volume: ARRAY<STRING>, issue: ARRAY<STRING>, spage: ARRAY<STRING>, epage: ARRAY<STRING>, "
    "pages: ARRAY<STRING>, jtitle: ARRAY<STRING>, au: ARRAY<STRING>, date: ARRAY<STRING>>, control: STRUCT<recordid: ARRAY<STRING>>, "
    "search: STRUCT<creator: ARRAY<STRING>, creationdate: ARRAY<STRING>>, "
    "links: STRUCT<linktohtml: ARRAY<STRING>, linktopdf: ARRAY<STRING>, linktorsrc: ARRAY<STRING>, openaccess: ARRAY<STRING>, openurl: ARRAY<STRING>>, "
    "delivery: STRUCT<availability: ARRAY<STRING>, holding: ARRAY<STRUCT<libraryCode: STRING, subLocationCode: STRING, callNumber: STRING>>>>"
)


def flatten(nested: DataFrame) -> DataFrame:
    """Nested records to the catalogue schema; sections that are missing give nulls."""
    place = {"display": "title creator contributor creationdate publisher type source description subject", "addata": "isbn issn doi volume issue spage epage pages jtitle au", "links": "linktohtml linktopdf linktorsrc openaccess openurl"}
    of = {c: f"pnx.{s}.{c}" for s, cs in place.items() for c in cs.split()}
    of |= {"ad_date": "pnx.addata.date", "s_creator": "pnx.search.creator", "s_creationdate": "pnx.search.creationdate", "availability": "pnx.delivery.availability", "holding": "pnx.delivery.holding"}
    cols = {"record_id": F.get("pnx.control.recordid", F.lit(0)), "is_course": F.lit(False)}
    return nested.select(*(cols.get(f.name, F.col(of[f.name]) if f.name in of else None).alias(f.name) for f in RECORD.fields))


def search_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved search responses: their records, and one row of info each."""
    raw = spark.read.schema(f"docs ARRAY<STRUCT<{NESTED.replace('pnx STRUCT', 'pnx: STRUCT', 1)}>>, info STRUCT<total: INT, first: INT, last: INT>").json(path, multiLine=True)
    return flatten(raw.select(F.explode("docs").alias("d")).select("d.*")), raw.select("info.*")


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query STRING, subject STRING, difficulty STRING, seed_doi STRING").json(path, multiLine=True)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log in file order. The number grows along the file and leaves gaps between its parts."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def pdf_texts(spark: SparkSession, path: str, most: int = 100_000, seconds: int = 60) -> DataFrame:
    """path, text and error of PDF files, extracted by the external pdftotext where it is installed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shutil.which("pdftotext")
        for f in frames:
            rows = []
            for name, content in zip(f["path"], f["content"], strict=True):
                text, error = None, None
                if not bytes(content[:5]) == b"%PDF-":
                    error = "no PDF"
                elif tool is None:
                    error = "pdftotext is not installed"
                else:
                    try:
                        done = subprocess.run([tool, "-layout", "-", "-"], input=bytes(content), capture_output=True, timeout=seconds)
                        text = done.stdout.decode("utf-8", "replace")
                        error = None if done.returncode == 0 else done.stderr.decode("utf-8", "replace")[:200]
                    except subprocess.TimeoutExpired:
                        error = "timeout"
                if text is not None and len(text) > most:
                    text = text[:most] + f"\n\n[Text truncated at {most:,} characters]"
                rows.append((name, text, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def embedding_batches(rows: DataFrame, embed, size: int = 10) -> DataFrame:
    """Vectors of texts from a function over batches of at most `size`; a batch whose service fails (errors of input and
    output, time-outs, bad values, RuntimeError) gives its error on each row. Other errors are mistakes in the function
    and end the job. rows: id, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), size):
                part = f.iloc[lo : lo + size]
                try:
                    got = [list(map(float, v)) for v in embed(part["text"].tolist())]
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": got, "error": None})
                except (OSError, RuntimeError, ValueError) as e:
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": [None] * len(part), "error": str(e)})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>, error string")


def wrap_embedding(rows: DataFrame) -> DataFrame:
    """One vector under `embedding` to a list of vectors under `embeddings`."""
    return rows.withColumn("embeddings", F.array("embedding")).drop("embedding")
