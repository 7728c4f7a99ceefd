"""Quality rules for documents, and the frequency of lines across the documents of a host. DataFrame functions only.

Rules of one document: few words, or many words inside 8-word windows that occur twice or more. Rule across
documents: lines are normalised (white space runs to one space, trimmed, lower case) and hashed; a line that
stands in more distinct documents of a host than the limit is removed from all of them; a document of which too
little is left is rejected. The limit is a share of the host's distinct documents and holds for hosts of any size;
below it no line goes that stands in MIN_DOCS documents or fewer, for a share of a small host is a chance repeat.
`judge` counts the words of removed lines, `keep` returns the texts without these lines. With keep_first, the
document with the smallest id keeps a line: then content that a host holds in many copies stays once.

Texts are read once: a narrow row for each document (measures, hashes and sizes of its lines) is written to the shared
folder, and all counts and joins read that. Both functions run this job when they are called.

Defined results: null and empty texts have no words and fail. Copies of a text count as one document of their
host, and null is a host like any other. Repeated rows (same id, source and text) get the same result each. Texts are
read whole. Other columns pass `judge` by and are kept by `keep`, which brings n_chars up to date where lines are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, fresh, materialize, word_count

MIN_WORDS = 20
#: Percent of words in repeated windows above which a document fails.
MAX_REPEATED = 30
WINDOW = 8
#: A line is removed when more documents of its host have it than MIN_DOCS and than this percentage of the host's.
MIN_DOCS, PERCENT = 5, 1
#: Percent of words that has to be left.
MIN_LEFT = 30


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _let(value: Column, body) -> Column:
    """Binds a value once inside an expression, so that lambdas don't compute it for each element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # a body of two parameters would get the index


def _joined(hashes: Column, by: int) -> Column:
    """Hashes of each element and the one `by` places later."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, by + 1, n), lambda a, b: F.xxhash64(a, b))


def covered_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, from a list of word hashes. Windows are joined up by
    doubling; a text without a repeated 4-word window has none of 8."""

    def eight(four: Column) -> Column:
        some = F.size(F.array_distinct(four)) < F.size(four)
        return F.when(some, _let(_joined(four, 4), repeated_words)).otherwise(0)

    return _let(_joined(hashes, 1), lambda two: _let(_joined(two, 2), eight))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more. Windows are sorted by hash; equal neighbours give the
    positions, and each position adds what the one after it doesn't cover."""

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def positions(s: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            return (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))

        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"]))

    pairs = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, _let(pairs, lambda s: _let(positions(s), covered))).otherwise(0)


def _measured(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of a text that isn't null, as one struct and
    the rest. Each value is bound once, so that lambdas don't compute it for each element."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _let(F.transform(w, lambda x: F.xxhash64(x)), covered_words).cast("long").alias("n_repeat_words"),
        )

    return [
        _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def line_keys(source: Column, text: Column) -> Column:
    """A key of host and normalised line, and the number of words, of each line of a text that has a word."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(source, normal_line(x)).alias("h"), word_count(x).alias("n"))), lambda x: x["n"] > 0)


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures, the hash of the text, _row (a number of its own for each row, once it is written) and
    _lines (keys and numbers of words of its lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", F.xxhash64("source", "text").alias("_hash"), F.xxhash64(text).alias("_text"), *_measured(text), line_keys(F.col("source"), text).alias("_lines"), F.monotonically_increasing_id().alias("_row")
    )
    return rows.select("doc_id", "source", "_hash", "_text", "_row", "_words.*", "n_symbols", "n_dup_lines", "_lines")


def frequent_lines(known: DataFrame, min_docs: int = MIN_DOCS, percent: int = PERCENT) -> DataFrame:
    """The keys (_line, first_id) of lines above the limit.

    Counts are made before anything is joined: a line that half of all documents hold sends one row per document and
    task to be told apart, dealt by line and document, and one per task to be counted."""
    lines = known.select("doc_id", "source", "_text", F.explode("_lines.h").alias("_line"))
    found = lines.groupBy("_line").agg(F.count_distinct("_text").alias("docs"), F.min("doc_id").alias("first_id"), F.min("source").alias("host")).filter(F.col("docs") > min_docs)
    hosts = known.groupBy("source").agg(F.count_distinct("_text").alias("host_docs"))
    above = found.join(hosts, found["host"].eqNullSafe(hosts["source"])).filter(100 * F.col("docs") > percent * F.col("host_docs"))
    return above.select("_line", "first_id")


def _judged(docs: DataFrame, min_docs: int = MIN_DOCS, percent: int = PERCENT, min_left: int = MIN_LEFT, keep_first: bool = False) -> DataFrame:
    """The columns of `judge`, _hash, and _gone: the keys of a row's removed lines, null where it has none.

    A frequent line's rows are on the side of the join that Spark splits when a partition is skewed; texts are not
    shuffled, and of the lines only those that are removed go on."""
    known = materialize(facts(docs))
    lines = known.select("_row", "doc_id", F.explode("_lines").alias("l")).select("_row", "doc_id", F.col("l.h").alias("_line"), F.col("l.n").alias("n"))
    gone = lines.join(frequent_lines(known, min_docs, percent), "_line")
    if keep_first:
        gone = gone.filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    # sorted, so that repeated rows have equal lists; where _gone is not read, Catalyst leaves it out
    per_row = gone.groupBy("_row").agg(F.sum("n").alias("n_removed"), F.sort_array(F.collect_set("_line")).alias("_gone"))
    out = known.join(per_row, "_row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed")
    kept = ~F.col("base_failed") & (left >= MIN_WORDS) & (100 * left >= min_left * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", kept.alias("kept"), "_hash", "_gone")


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the measures, base_failed, n_removed (words in removed lines) and kept, one row per row."""
    return _judged(docs, **limits).drop("_hash", "_gone")


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of documents that `judge` keeps, with all their columns; removed lines are taken out of text, and
    n_chars, where it is, is that of the text that is left."""
    names = {x: fresh(docs, x) for x in ("_id", "_hash", "_gone")}
    # a narrow table, so that its size is known to the join; a row is told by its id and the hash of what it holds
    kept = _judged(docs, **limits).filter("kept").select(F.col("doc_id").alias(names["_id"]), F.col("_hash").alias(names["_hash"]), F.col("_gone").alias(names["_gone"]))
    kept = materialize(kept.distinct()).hint("merge")  # dealt alike at every size
    gone, text = F.col(names["_gone"]), F.col("text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, F.xxhash64("source", normal_line(x)))), "\n")
    same = docs["doc_id"].eqNullSafe(kept[names["_id"]]) & (F.xxhash64(docs["source"], docs["text"]) == kept[names["_hash"]])
    out = docs.join(kept, same).withColumn("text", F.when(gone.isNull(), text).otherwise(left))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(n))
    return out.select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, md5(coalesce(text, '')) AS t, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) >= 8 THEN list_transform(range(1, len(ws) - 6), lambda i: md5(array_to_string(list_slice(ws, i, i + 7), ' '))) ELSE [] END AS win FROM w),
p AS (SELECT doc_id, t, unnest(win) AS h, generate_subscripts(win, 1) AS i FROM g),
r AS (SELECT doc_id, t, i, count(*) OVER (PARTITION BY doc_id, t, h) AS c FROM p),
c AS (SELECT doc_id, t, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id, t ORDER BY i) - i, 8)) AS k FROM r WHERE c > 1),
rep AS (SELECT doc_id, t, sum(k)::BIGINT AS n_repeat_words FROM c GROUP BY ALL),
l0 AS (SELECT doc_id, source, t, unnest(string_split(x, chr(10))) AS line FROM d),
l AS (SELECT doc_id, source, t, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, t, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source),
f AS (SELECT l.source, norm, host_docs FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, norm, host_docs HAVING count(DISTINCT t) > 5 AND 100 * count(DISTINCT t) > host_docs),
gone AS (SELECT l.doc_id, l.t, sum(l.n)::BIGINT AS n_removed FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY ALL),
m AS (
  SELECT g.doc_id, n::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
  FROM g LEFT JOIN rep USING (doc_id, t) LEFT JOIN dup USING (doc_id, t) LEFT JOIN gone USING (doc_id, t))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed >= 20 AND 100 * (n_words - n_removed) >= 30 * n_words AS kept
FROM m
"""
