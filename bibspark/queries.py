"""Queries over the test tables, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identifiers, links
from .functions.text import cache_key, first, let, sanitized, text
from .operators import cite, evaluation, ranking, resolve, state, stats
from .operators.metadata import extract, item_rows, item_summary, registry_works
from .plans import api
from .plans import search as s
from .schema import Settings
from .session import shared_path
from .sources import catalog as cat
from .sources import sinks
from .sources.tables import table
from .streaming import stateful

YEAR = 2026


def _catalog(spark, sf_dir):
    return cat.catalog(spark, sf_dir)


def _meta(spark, sf_dir):
    return extract(_catalog(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls: tiers by event type, success unless an error."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("tier", F.when(F.col("event_type").isin("purchase", "error"), "direct").otherwise("browser")).withColumn("success", F.col("event_type") != "error")


# --- search


def search_rerank(spark, sf_dir):
    out = s.search(_catalog(spark, sf_dir), s.Search("the of", limit=10, ref_year=YEAR))
    return out.select("record_id", F.round("score", 6).alias("score"), first(F.col("title")).alias("title"))


def _ids(out):
    return out.select("record_id", first(F.col("title")).alias("title"), first(F.col("creationdate")).alias("date"))


def search_boolean(spark, sf_dir):
    """All matches of a nested expression; no page."""
    q = "(the AND of) OR (la NOT de) OR article"
    return _catalog(spark, sf_dir).filter(s.matches(q, "title")).select("record_id", first(F.col("title")).alias("title"))


def search_phrase_wildcard(spark, sf_dir):
    return _catalog(spark, sf_dir).filter(s.matches('"of the" OR th?n* OR *ation', "title")).select("record_id", first(F.col("title")).alias("title"))


def search_scope_sort_page(spark, sf_dir):
    out = s.search(_catalog(spark, sf_dir), s.Search("the", scope="electronic", sort="date", limit=20, offset=5, rerank=False))
    return out.select("position", *_ids(out).columns[:1], first(F.col("title")).alias("title"), first(F.col("creationdate")).alias("date"))


def search_sort_title(spark, sf_dir):
    out = s.search(_catalog(spark, sf_dir), s.Search("de", field="title", sort="title", limit=25, rerank=False))
    return out.select("position", "record_id", first(F.col("title")).alias("title"))


def search_by_author(spark, sf_dir):
    return _catalog(spark, sf_dir).filter(s.matches("last7 first3", "creator")).select("record_id", F.array_join("creator", "|").alias("creator"))


def search_by_isbn(spark, sf_dir):
    return _catalog(spark, sf_dir).filter(s.matches("978-0-00-000001-9", "isbn")).select("record_id", first(F.col("isbn")).alias("isbn"))


def search_expanded(spark, sf_dir):
    q = s.clean_query(s.expression("the AND that", "und OR para"))
    return _catalog(spark, sf_dir).filter(s.matches(q, "title")).agg(F.count("*").alias("total"))


def search_courses(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return c.filter(s.in_scope("courses")).filter(s.matches("en", "sub")).groupBy(first(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def query_sanitize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = F.concat(F.lit("<b>"), "text", F.lit(" $$Qx</b> AND "), F.repeat(F.concat("lang", F.lit(" OR ")), 40), F.lit("end"))
    return d.select("doc_id", F.md5(sanitized(q).cast("binary")).alias("query_md5"), F.md5(sanitized(F.concat("source", F.repeat(F.concat(F.lit(" AND "), "lang"), 36))).cast("binary")).alias("short_md5"))


def by_intent(spark, sf_dir):
    i = s.Intent(terms=("the",), date_from=2000, date_to=2015, material_type="article", sort="date_desc")
    return _ids(s.by_intent(_catalog(spark, sf_dir), i, limit=30))


def dictionary_expand(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("q"))
    out = s.rewrite(F.col("q"), {"en": "english", "FR": "french"}, {"german": ["deutsch"], "src1 NOT": ["none"]}, {"de": "german"})
    words = F.concat(F.lit("es AND "), "q", F.lit(" OR Course  Reserves (NOT ILL)"))
    phrases = s.rewrite(words, {"ILL": "interlibrary loan", "es": "spanish"}, {"course reserves": ["short-term loans", "readings"]}, {"Castilian": ["en", "src2"]}, ("ES",))
    return d.select("doc_id", out.alias("rewritten"), phrases.alias("phrases"))


# --- fusion and ranking


def _legs(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    q = s.Search("the", limit=50)
    return [s.one_leg(c, q, f, scope, 50).withColumnRenamed("position", "rank") for f, scope in (("any", "all"), ("sub", "all"), ("any", "electronic"))]


def rrf_fusion(spark, sf_dir):
    out = ranking.fuse(_legs(spark, sf_dir), 50)
    return out.select("fusion_key", F.round("rrf", 9).alias("rrf"), "first_list", "first_rank")


def rrf_rerank_pipeline(spark, sf_dir):
    out = s.search(_catalog(spark, sf_dir), s.Search("the", limit=10, comprehensive=True, ref_year=YEAR))
    return out.select("record_id", F.round("score", 6).alias("score"))


def signal_scores(spark, sf_dir):
    """The five signals and the score of every record."""
    out = ranking.scored(_catalog(spark, sf_dir), "the of machine", YEAR)
    return out.select("record_id", *(F.round(c, 6).alias(c) for c in ("s_title", "s_recency", "s_fulltext", "s_type", "s_complete", "score")))


def cosine_rerank(spark, sf_dir):
    out = ranking.cosine_rank(table(spark, sf_dir, "embeddings"), [1.0 if i % 2 == 0 else -0.5 for i in range(64)], 20)
    return out.select("vec_id", F.round("cosine", 5).alias("cosine"))


def top_subjects(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    leg = s.one_leg(c, s.Search("the", limit=50), "title", "all", 50)
    return stats.top_subjects(leg).select("subject", "position", "k")


def electronic_count(spark, sf_dir):
    return stats.electronic_count(_catalog(spark, sf_dir))


# --- metadata, identifiers, links


def metadata_extract(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return m.select("record_id", "title", "date", "publisher", "type", "source", "isbn", "doi", "volume", "issue", "spage", "epage", "is_cdi", "resource_type")


def authors_cascade(spark, sf_dir):
    return _meta(spark, sf_dir).select("record_id", F.array_join("authors", "|").alias("authors"), F.size("authors").alias("n"))


def links_bundle(spark, sf_dir):
    c = _catalog(spark, sf_dir).select("record_id", links.bundle(F.col).alias("l"))
    return c.select("record_id", F.array_join("l.source_links", "|").alias("source_links"), text(F.col("l.doi_url")).alias("doi_url"), F.col("l.open_access").alias("open_access"), F.array_join(links.in_priority(F.col("l")), "|").alias("urls"), text(links.best(F.col("l"))).alias("best"))


def isbn_check(spark, sf_dir):
    """13-digit numbers as generated and with a wrong digit, and 10-digit ones from ids."""
    c = _catalog(spark, sf_dir).select("doc_id", first(F.col("isbn")).alias("isbn"))
    wrong = F.concat(F.substring("isbn", 1, 12), ((F.substring("isbn", 13, 1).try_cast("int") + 1) % 10).cast("string"))
    ten = F.lpad((F.col("doc_id") * 7919).cast("string"), 10, "0")
    return c.select("doc_id", identifiers.isbn_ok(F.col("isbn")).alias("ok"), F.coalesce(identifiers.isbn_ok(wrong), F.lit(False)).alias("wrong_ok"), identifiers.isbn_ok(ten).alias("ten_ok"))


def issn_check(spark, sf_dir):
    n = F.lpad((F.col("doc_id") * 1237).cast("string"), 8, "0")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 4)).alias("issn"))
    return d.select("doc_id", identifiers.issn_ok(F.col("issn")).alias("ok"))


def doi_normalize(spark, sf_dir):
    d = _catalog(spark, sf_dir).select("doc_id", first(F.col("doi")).alias("doi"))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" HTTPS://doi.org/"), F.upper("doi"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("doi:"), "doi")).otherwise(F.col("doi"))
    return d.select("doc_id", identifiers.doi_key(wrapped).alias("doi_key"), identifiers.doi_url(F.col("doi")).alias("doi_url"))


def url_domain(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", identifiers.host(F.col("url")).alias("host"), identifiers.domain(F.col("url")).alias("domain"), identifiers.domain(identifiers.proxied(F.col("url"), "proxy.example.org"), "proxy.example.org").alias("router_domain"), identifiers.proxied(F.col("url"), "proxy.example.org").alias("proxied"), identifiers.unproxied(identifiers.host(identifiers.proxied(F.col("url"), "proxy.example.org")), "proxy.example.org").alias("unproxied"))


def page_pdf_links(spark, sf_dir):
    """Links of pages, with three of each kind added: by text, by text in a container, and by address."""
    n = F.col("page_id").cast("string")
    more = [F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="/x/'), n, F.lit('">Download <b>PDF</b></a>'))), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div class="box access"><p><a class="q" href="/y/'), n, F.lit('">The pdf</a></p></div>')))]
    more += [F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<div class="accessory"><a href="/z/'), n, F.lit('">pdf</a></div><a href="/w.PDF">w</a>')))]
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("", *more, "html").alias("html"))
    return p.select("page_id", F.size(links.hrefs(F.col("html"))).alias("n_links"), F.array_join(links.pdf_links(F.col("html")), "|").alias("pdf"))


def login_page_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.login_page(F.col("html")).alias("is_login"))


def content_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", identifiers.content_key(F.col("text")).alias("content_key"))


# --- citations and exports


def _cite(style):
    def run(spark, sf_dir):
        return cite.citations(_meta(spark, sf_dir), style)

    return run


def export_csv_rows(spark, sf_dir):
    return sinks.entries(_catalog(spark, sf_dir), "csv")


def export_json_rows(spark, sf_dir):
    rows = sinks.export_rows(_catalog(spark, sf_dir))
    return rows.select(*[F.array_join(c, "; ").alias(c) if c == "authors" else c for c in sinks.EXPORT])


def file_names(spark, sf_dir):
    return _meta(spark, sf_dir).select("record_id", cite.file_name().alias("file_name"))


def item_mapping(spark, sf_dir):
    rows = item_rows(cat.library(spark, sf_dir))
    return rows.select("key", "title", F.array_join("authors", "|").alias("authors"), "date", "item_type", "doi", "isbn", "publication")


def item_summaries(spark, sf_dir):
    return item_summary(item_rows(cat.library(spark, sf_dir)))


def detail_reports(spark, sf_dir):
    return sinks.detail(_catalog(spark, sf_dir)).select("record_id", F.md5(F.col("detail").cast("binary")).alias("detail_md5"), F.length("detail").alias("n_chars"))


# --- lookups, enrichment, duplicates


def batch_lookup(spark, sf_dir):
    """Records of all labelled documents and of ids that are unknown, in the order of the list."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("pos"), F.when(F.col("quality") == 1, F.concat(F.when(F.col("doc_id") % 3 == 0, "TN_cdi_").otherwise("alma99"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))).otherwise(F.concat(F.lit("missing"), "doc_id")).alias("id"))
    return resolve.by_id(ids, _catalog(spark, sf_dir)).select("pos", "id", "found", first(F.col("title")).alias("title"))


def isbn_lookup(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    ids = c.select(F.col("doc_id").cast("int").alias("pos"), F.when(F.size("isbn") > 0, F.concat(F.substring(first(F.col("isbn")), 1, 3), F.lit("-"), F.substring(first(F.col("isbn")), 4, 10))).otherwise("0").alias("id"))
    return resolve.by_isbn(ids, c).select("pos", "id", "found", text(F.col("record_id")).alias("record_id"))


def found_counts(spark, sf_dir):
    return resolve.tally(isbn_lookup(spark, sf_dir))


def enrich_missing(spark, sf_dir):
    """Metadata without dates for central records, filled from a registry of all DOIs."""
    m = _meta(spark, sf_dir)
    lacking = m.withColumn("date", F.when(F.col("is_cdi"), "").otherwise(F.col("date"))).withColumn("authors", F.when(F.col("is_cdi"), F.array().cast("array<string>")).otherwise(F.col("authors")))
    registry = m.filter("doi <> ''").select("doi", "authors", F.col("date"), "source", "volume", "issue")
    return resolve.enrich(lacking, registry).select("record_id", "date", F.array_join("authors", "|").alias("authors"), "enriched")


def dup_doi(spark, sf_dir):
    return resolve.same_doi(_meta(spark, sf_dir), cat.library(spark, sf_dir))


def dup_isbn(spark, sf_dir):
    return resolve.same_isbn(_meta(spark, sf_dir), cat.library(spark, sf_dir))


def dup_title_author(spark, sf_dir):
    return resolve.same_title(_meta(spark, sf_dir), cat.library(spark, sf_dir))


def dup_cascade_status(spark, sf_dir):
    return resolve.duplicates(_meta(spark, sf_dir), cat.library(spark, sf_dir)).select("record_id", "match_type", text(F.col("item_key")).alias("item_key"))


def dup_counts(spark, sf_dir):
    return dup_cascade_status(spark, sf_dir).groupBy("match_type").agg(F.count("*").alias("n"))


def items_without_pdf(spark, sf_dir):
    lib = cat.library(spark, sf_dir)
    return resolve.without_pdf(lib, cat.attachments(lib)).select("key", "title")


def first_pdf_child(spark, sf_dir):
    return resolve.first_pdf(cat.attachments(cat.library(spark, sf_dir)))


def collection_members(spark, sf_dir):
    m = resolve.members(cat.library(spark, sf_dir), cat.collections(spark, sf_dir))
    return m.groupBy("collection_key", "name").agg(F.count("*").alias("n_items"), F.min("item_key").alias("first_item"))


# --- evaluation and statistics


def _run_and_qrels(spark, sf_dir):
    """Benchmark passages as queries; documents that hold a passage are relevant; a run ranks documents by the words of
    the passage's first 40 characters that their title holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    probe = bench.select("item_id", "passage", F.substring("passage", 1, 40).alias("head"))
    # passages meet texts by their first five words, then are compared whole
    words_of = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    five = let(words_of, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))))
    grams = docs.select("doc_id", F.explode(five).alias("g"))
    heads = probe.select("item_id", "passage", F.xxhash64(F.slice(F.split("passage", r"[\x20\x09-\x0D]+"), 1, 5)).alias("g"))
    # the few pairs that meet fetch their texts
    pairs = grams.join(heads, "g").select("doc_id", "item_id", "passage").distinct()
    rel = pairs.join(docs, "doc_id").filter(F.col("text").contains(F.col("passage"))).select(F.col("item_id").alias("query_id"), F.col("doc_id").cast("string").alias("doc_key")).distinct()
    words = probe.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("head"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    titles = _catalog(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(first(F.col("title"))), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    hits = titles.join(words, "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    run = ranking.top_within(hits, ["query_id"], [F.desc("n"), F.asc("doc_id")], "doc_id", 30)
    return run.select("query_id", "rank", F.col("doc_id").cast("string").alias("doc_key")), rel


def eval_metrics(spark, sf_dir):
    run, rel = _run_and_qrels(spark, sf_dir)
    m = evaluation.metrics(run, rel, 10, keys_are_dois=False)
    return m.select("query_id", "n_rel", *(F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")))


def eval_by_group(spark, sf_dir):
    """Quality labels as scores by language of the document."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.col("lang").alias("subject"), F.col("quality").cast("double").alias("ndcg"), F.col("toxic").cast("double").alias("mrr"), ((F.col("quality") + F.col("toxic")) / 2.0).alias("recall"), F.when(F.col("doc_id") % 13 == 0, "failed").alias("error"))
    return evaluation.by_group(rows)


def eval_summary(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select((F.col("event_id") % 2).cast("double").alias("ndcg"), (F.col("event_id") % 3 / 2.0).alias("mrr"), (F.col("event_id") % 5 / 4.0).alias("recall"), F.col("value").alias("latency_ms"), F.when(~F.col("success"), "error").alias("error"))
    return evaluation.summary(rows)


def latency_percentiles(spark, sf_dir):
    e = _events(spark, sf_dir)
    return evaluation.exact_percentile(e, "value", "event_type", 0.5, 0.95)


def tool_metrics(spark, sf_dir):
    calls = _events(spark, sf_dir).select(F.col("event_type").alias("tool"), F.col("value").alias("latency"), (~F.col("success")).alias("failed"))
    return stats.call_metrics(calls).select("tool", "n", "n_errors", F.round("total_latency", 4).alias("total_latency"), F.round("avg_latency", 6).alias("avg_latency"))


def facet_counts(spark, sf_dir):
    year = F.substring(first(F.col("creationdate")), 1, 4).try_cast("int")
    return stats.facets(_catalog(spark, sf_dir), {"type": first(F.col("type")), "year": year, "language": F.get("subject", F.lit(0))}).filter("value is not null")


def query_history(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type = 'view'")
    return stats.recent_queries(e, F.lit("2024-01-15").cast("timestamp"), 3600).select("event_id", "user_id", "refinement")


def severe_lines(spark, sf_dir):
    """Conversation turns as log lines with a level."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.concat(F.lit("2024 "), F.element_at(F.array(F.lit("[ERROR]"), F.lit("INFO"), F.lit("WARNING")), (F.col("conv_id") % 3).cast("int") + 1), F.lit(" "), "role").alias("value"))
    return stats.last_errors(c, 10)


# --- state over time


def budget_windows(spark, sf_dir):
    out = state.window_counts(_events(spark, sf_dir), "event_type")
    return out.select("event_id", F.col("in_window").alias("n_in_hour"), (F.col("in_window") > 5).alias("over"))


def budget_global(spark, sf_dir):
    return state.window_counts(_events(spark, sf_dir)).select("event_id", F.col("in_window").alias("n_in_hour"), (F.col("in_window") > 20).alias("over"))


def budget_status(spark, sf_dir):
    now = 1705320000000000  # 2024-01-15 12:00 UTC
    return state.budget_status(_events(spark, sf_dir), "event_type", now, 50, 4 * 3600)


def budget_admission(spark, sf_dir):
    return state.admit(_events(spark, sf_dir), "user_id", "event_type", (15, 3, 2), 24 * 3600)


def router_state(spark, sf_dir):
    return state.classify(_events(spark, sf_dir), "user_id")


def router_running(spark, sf_dir):
    return state.classify_running(_events(spark, sf_dir), "user_id").select("event_id", "source_class")


def router_tiers(spark, sf_dir):
    t = state.tiers_seen(_events(spark, sf_dir), "user_id")
    return t.select("user_id", F.array_join("succeeded", ",").alias("succeeded"), F.array_join("failed", ",").alias("failed"))


def tier_order(spark, sf_dir):
    tiers = F.array(*map(F.lit, ("direct", "direct_proxy", "browser", "cookies", "browser_proxy")))
    return state.classify(_events(spark, sf_dir), "user_id").select("user_id", F.array_join(state.tier_order(tiers, F.col("source_class")), ",").alias("tiers"))


def breaker_runs(spark, sf_dir):
    return state.failure_runs(_events(spark, sf_dir), "user_id", 3)


def breaker_states(spark, sf_dir):
    return state.breaker(_events(spark, sf_dir), "user_id", 2, 6 * 3600.0)


def capture_history(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("recorded", F.col("event_type") != "signup")
    return state.history(e, 50).select("event_id", "event_type")


def recent_records(spark, sf_dir):
    seen = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("seq"))
    return state.recent_records(seen, 50)


def first_seen(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", state.micros().alias("micros"))
    return state.first_wins(e, ["user_id"], "micros", "event_id")


def backoff_schedule(spark, sf_dir):
    from .functions.scoring import backoff

    e = _events(spark, sf_dir)
    return e.select("event_id", backoff(F.col("event_id") % 8, 1.0, 30.0, ~F.col("success")).alias("delay"))


# --- streams


def _stream(spark, sf_dir):
    static = table(spark, sf_dir, "events")
    e = stateful.read_events(spark, f"{sf_dir}/events.parque[t]", static.schema)  # a pattern takes a file as well as a folder
    return e.withColumn("tier", F.when(F.col("event_type").isin("purchase", "error"), "direct").otherwise("browser")).withColumn("success", F.col("event_type") != "error")


def stream_budget(spark, sf_dir):
    out, ck = shared_path(spark), shared_path(spark)
    stateful.run_once(stateful.admissions(_stream(spark, sf_dir), "user_id", "event_type", (15, 3, 2), 24 * 3600, "1 hour"), out, ck)
    return spark.read.parquet(out)


def stream_router(spark, sf_dir):
    out, ck = shared_path(spark), shared_path(spark)
    stateful.run_to_table(stateful.classes(_stream(spark, sf_dir), "user_id"), out, ck)
    rows = spark.read.parquet(out)
    return rows.groupBy("user_id").agg(F.max_by("source_class", "batch").alias("source_class"))


def stream_breaker(spark, sf_dir):
    out, ck = shared_path(spark), shared_path(spark)
    stateful.run_once(stateful.breakers(_stream(spark, sf_dir), "user_id", 2, 6 * 3600.0, "1 hour"), out, ck)
    return spark.read.parquet(out).withColumnRenamed("key", "user_id")


def stream_dedup(spark, sf_dir):
    """The keys seen, each once: what is dropped hangs on arrival within the watermark, so a month of it is held."""
    out, ck = shared_path(spark), shared_path(spark)
    stateful.run_once(stateful.first_sights(_stream(spark, sf_dir), "user_id", "60 days").select("user_id"), out, ck)
    return spark.read.parquet(out)


# --- relational coverage over the star tables (extras)


def star_pricing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= date '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.count("*").alias("n"))


def star_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def star_anti(spark, sf_dir):
    late = table(spark, sf_dir, "orders").filter("o_orderdate >= date '1998-05-01'")
    return table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def star_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def star_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).alias("nth"), F.lag("o_orderkey").over(w).alias("before"))


def star_top_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", "r")


def star_set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("op", F.lit("more"))).unionByName(a.union(b).distinct().withColumn("op", F.lit("any")))


def star_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


# --- tools over a library, and fields that the plain catalogue leaves empty


def _full(spark, sf_dir):
    return cat.full_catalog(spark, sf_dir)


def _library(spark, sf_dir, **more):
    c = _catalog(spark, sf_dir)
    lib = cat.library(spark, sf_dir)
    return api.Library(spark, c, lib, cat.collections(spark, sf_dir), cat.attachments(lib), **more)


def _quarter(spark, sf_dir):
    """Items of every fourth document."""
    return cat.library(spark, sf_dir).filter("doc_id % 4 = 0")


def search_sort_author(spark, sf_dir):
    out = s.search(_catalog(spark, sf_dir), s.Search("de", field="title", sort="author", limit=25, rerank=False))
    return out.select("position", "record_id", first(F.col("creator")).alias("creator"))


def search_faithful(spark, sf_dir):
    """Sorted by date, then re-ranked all the same."""
    out = s.search(_catalog(spark, sf_dir), s.Search("the", sort="date", limit=10, faithful=True, ref_year=YEAR))
    return out.select("record_id", F.round("score", 6).alias("score"))


def search_by_subject(spark, sf_dir):
    return api.call(_library(spark, sf_dir), "search_by_subject", subject="fr", limit=15).select("position", "record_id")


def search_items(spark, sf_dir):
    return api.call(_library(spark, sf_dir), "search_items", query="the NOT of", limit=100).select("key", "date")


def read_article(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = _catalog(spark, sf_dir).select("doc_id", "record_id").join(docs, "doc_id").select("record_id", "text")
    lib = _library(spark, sf_dir, texts=texts, settings=Settings(text_chars=150))
    by_id = [api.call(lib, "read_article", record_id=f"alma99{i:010d}") for i in (1, 2, 4, 5)]
    return by_id[0].unionByName(by_id[1]).unionByName(by_id[2]).unionByName(by_id[3])


def save_batch(spark, sf_dir):
    """A batch saved to a collection that is made below one that is made: status, and the collection of those saved."""
    lib = _library(spark, sf_dir)
    lib.items = _quarter(spark, sf_dir)
    ids = [f"TN_cdi_{i:010d}" if i % 3 == 0 else f"alma99{i:010d}" for i in range(12)] + ["none", "alma990000000001"]
    out = api.call(lib, "batch_save_items", record_ids=ids, collection_name="New Papers", parent_collection="Texts EN")
    return out.select("pos", "id", "status", text(F.array_join("collections", "|")).alias("collections"))


def save_tallies(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("pos"), F.when(F.col("quality") == 1, F.concat(F.when(F.col("doc_id") % 3 == 0, "TN_cdi_").otherwise("alma99"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))).otherwise(F.concat(F.lit("missing"), "doc_id")).alias("id"))
    ids = ids.unionByName(ids.filter("pos % 10 = 0").withColumn("pos", F.col("pos") + 100_000_000))
    return resolve.status_counts(resolve.save_statuses(ids, _meta(spark, sf_dir), _quarter(spark, sf_dir)))


def list_collections(spark, sf_dir):
    lib = _library(spark, sf_dir)
    root = spark.createDataFrame([("ROOT", "All", None, 0)], "key STRING, name STRING, parent_key STRING, num_items INT")
    lib.collections = lib.collections.unionByName(root)
    return api.call(lib, "list_collections").select("key", "name", text(F.col("parent_name")).alias("parent_name"), "num_items")


def collection_upsert(spark, sf_dir):
    new = spark.createDataFrame([("N1", "TEXTS en", "ROOT", 0), ("N2", "Texts en", None, 0), ("N4", "Other", "ROOT", 0), ("N3", "other", "ROOT", 0)], "key STRING, name STRING, parent_key STRING, num_items INT")
    return resolve.upsert_collection(cat.collections(spark, sf_dir), new).select("key", "name", text(F.col("parent_key")).alias("parent_key"))


def collection_by_name(spark, sf_dir):
    return resolve.find_collection(cat.collections(spark, sf_dir), "tExTs De", "ROOT").select("key", "name")


def diagnostics(spark, sf_dir):
    calls = _events(spark, sf_dir).select(F.col("event_type").alias("tool"), F.col("value").cast("double").alias("latency"), (~F.col("success")).alias("failed"))
    log = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.concat(F.lit("2024 "), F.element_at(F.array(F.lit("ERROR"), F.lit("INFO"), F.lit("WARNING")), (F.col("conv_id") % 3).cast("int") + 1), F.lit(" "), "role").alias("value"))
    lib = api.Library(spark, _catalog(spark, sf_dir), calls=calls, log=log, settings=Settings(user_name="u", password="p", second_factor="s"))
    return api.call(lib, "get_diagnostics")


def resolve_tiers(spark, sf_dir):
    """Ids looked up in three sources in turn."""
    m = _meta(spark, sf_dir)
    n = F.substring("record_id", -10, 10).cast("int")
    ids = m.select(n.alias("pos"), F.col("record_id").alias("id"))
    sources = [m.filter(n % k == 0).withColumn("title", F.concat(F.lit(f"{k} "), "title")) for k in (2, 3, 5)]
    return resolve.coalesce_sources(ids, sources, "record_id", ["title", "date"]).select("pos", F.coalesce("source_no", F.lit(-1)).alias("source_no"), text(F.col("title")).alias("title"), text(F.col("date")).alias("date"))


def fusion_without_ids(spark, sf_dir):
    """Two lists with records that have no id."""
    f = _full(spark, sf_dir).select("record_id", "title", F.col("doc_id").cast("int").alias("d"))
    legs = [f.filter("d % 2 = 0").withColumn("rank", F.col("d")).drop("d"), None, f.filter("d % 3 = 0").withColumn("rank", F.floor(F.col("d") / 3).cast("int")).drop("d")]
    return ranking.fuse(legs).select("fusion_key", F.round("rrf", 9).alias("rrf"), "first_list", "first_rank")


def seed_hits(spark, sf_dir):
    c = _catalog(spark, sf_dir).select("doc_id", first(F.col("doi")).alias("doi"))
    run = c.select((F.col("doc_id") % 20).alias("query_id"), F.floor(F.col("doc_id") / 20).cast("int").alias("rank"), F.upper("doi").alias("doc_key"))
    seeds = c.filter("doc_id < 400 AND doc_id % 21 = floor(doc_id / 20)").select((F.col("doc_id") % 20).alias("query_id"), F.concat(F.lit("https://doi.org/"), "doi").alias("seed_doi"))
    return evaluation.seed_found(run, seeds, 10)


def citing_works(spark, sf_dir):
    """Judgements: a seed's DOI, and the fifty works that cite it which are cited most."""
    c = _catalog(spark, sf_dir).select("doc_id", first(F.col("doi")).alias("doi")).filter("doi <> ''").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    cites = c.select(F.concat(F.lit("DOI:10.9/seed"), (F.col("doc_id") % 3).cast("string")).alias("cited_doi"), F.upper("doi").alias("citing_doi"), F.col("n_chars").alias("cited_by_count"))
    seeds = spark.createDataFrame([(1, "10.9/seed1"), (2, "https://doi.org/10.9/SEED2"), (3, ""), (4, "10.9/none")], "query_id long, seed_doi string")
    return evaluation.judged(seeds, cites.unionByName(cites), 50)


def record_dois(spark, sf_dir):
    f = _full(spark, sf_dir)
    n = F.col("doc_id").cast("string")
    found = F.when(F.col("doc_id") % 8 == 0, F.array(F.concat(F.lit("https://x.org/"), n), F.concat(F.lit("https://DX.doi.org/10.5/ABC"), n, F.lit("?via=x")))).otherwise(F.col("linktohtml"))
    return f.select("doc_id", identifiers.doi_of_record(F.col("doi"), found).alias("doi"))


def registry_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    author = F.array(F.struct(F.concat(F.lit("Fam"), n).alias("family"), F.when(F.col("doc_id") % 2 == 0, F.lit("Giv")).alias("given")), F.struct(F.lit("").alias("family"), F.lit(None).cast("string").alias("given")))
    works = d.select(
        F.concat(F.lit("10.1/"), n).alias("doi"), F.array("lang", "source").alias("title"), author.alias("author"), F.when(F.col("doc_id") % 3 == 0, F.lit(2001)).alias("print_year"), F.lit(1999).alias("online_year"),
        F.when(F.col("doc_id") % 5 > 0, F.array("source")).alias("container"), F.lit(None).cast("string").alias("publisher"), n.alias("volume"), F.lit("2").alias("issue"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("12")).when(F.col("doc_id") % 4 == 1, F.lit("12-34-5")).alias("page"), F.array(F.lit("1234-5679")).alias("issn"), F.array().cast("array<string>").alias("isbn"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("Journal-Article")).otherwise("book").alias("type"),
    )
    return registry_works(works).select("doi", "title", F.array_join("authors", "|").alias("authors"), "date", "source", "publisher", "volume", "spage", "epage", "pages", "issn", "isbn", "resource_type")


def item_traces(spark, sf_dir):
    lib = cat.library(spark, sf_dir)
    return resolve.traced(lib, "alma99000000001", "Record-ID").select("key", "extra")


def item_keys(spark, sf_dir):
    lib = cat.library(spark, sf_dir).select("key", "doc_id")
    shown = F.when(F.col("doc_id") % 3 == 0, F.lower("key")).when(F.col("doc_id") % 3 == 1, F.col("key")).otherwise(F.concat("key", F.lit("1")))
    return lib.select("key", resolve.is_item_key(shown).alias("is_key"), F.coalesce(cache_key(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("key"))), F.lit("")).alias("cached_as"))


def pdf_responses(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "Application/PDF; x=1").when(F.col("page_id") % 3 == 1, "text/html")
    url = F.when(F.col("page_id") % 4 == 1, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    status = F.element_at(F.array(F.lit(200), F.lit(302), F.lit(404), F.lit(199), F.lit(400)), (F.col("page_id") % 5).cast("int") + 1)
    return p.select("page_id", links.pdf_response(kind, url, status).alias("is_pdf"))


def token_states(spark, sf_dir):
    """Tokens of events: payload, validity at a fixed time, and the time left."""
    now = 1705320000
    e = _events(spark, sf_dir).select("event_id", (F.lit(now - 100) + F.col("event_id") % 300 * 7).alias("exp"))
    body = F.translate(F.base64(F.to_json(F.struct(F.col("exp").alias("exp"), F.col("event_id").cast("string").alias("user"))).cast("binary")), "+/=", "-_")
    claims = identifiers.token_payload(F.concat(F.lit("h."), body, F.lit(".s")), "exp LONG, user STRING")
    out = e.select("event_id", claims.alias("c")).withColumn("v", identifiers.token_valid(F.col("c.exp"), F.lit(now)))
    return out.select("event_id", F.col("c.user").alias("user"), F.col("v.valid").alias("valid"), F.col("v.refresh").alias("refresh"), identifiers.time_left(F.col("c.exp") - now).alias("left"))


def cookie_groups(spark, sf_dir):
    e = _events(spark, sf_dir)
    name = F.concat(F.element_at(F.array(F.lit("__Secure-"), F.lit("WEBPROXY"), F.lit("sid"), F.lit("__Host-")), (F.col("event_id") % 4).cast("int") + 1), F.col("user_id").cast("string"))
    rows = e.filter("event_id < 2000").select(F.col("event_type").alias("domain"), name.alias("name"))
    names = stats.names_by_domain(rows).select("domain", F.array_join("names", ",").alias("names"))
    kinds = rows.groupBy("domain").agg(*[F.count_if(links.cookie_class(F.col("name")) == k).alias(f"n_{k}") for k in ("proxy", "secure", "other")])
    return names.join(kinds, "domain")


def health_tally(spark, sf_dir):
    """Tallies of checks, and of keys that responses lack."""
    e = _events(spark, sf_dir)
    lacking = stats.lacking_keys(F.json_object_keys("props"), ["k", "total"])
    checks = e.select(F.when(F.col("success"), F.concat_ws(",", lacking)).otherwise("down").alias("status"))
    return stats.health(checks)


def missing_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wanted = d.select(F.col("source").alias("term")).distinct().unionByName(spark.createDataFrame([("src_none",), ("en",)], "term STRING"))
    return stats.missing_required(wanted, d.filter("doc_id % 20 < 12").select(F.col("source").alias("term")).unionByName(d.select(F.col("lang").alias("term"))))


def subjects_by_ndcg(spark, sf_dir):
    return evaluation.groups_by_ndcg(eval_by_group(spark, sf_dir)).limit(2).select("subject", "ndcg")


def full_metadata(spark, sf_dir):
    """All columns of the metadata of records whose fields are filled."""
    m = extract(_full(spark, sf_dir))
    lists = [F.array_join(c, "|").alias(c) for c in ("authors", "creators", "contributors")]
    rest = [c for c in m.columns if c not in ("authors", "creators", "contributors", "record_id")]
    ids = _full(spark, sf_dir).select("doc_id", "record_id")
    return m.join(ids.filter("record_id <> ''"), "record_id").select("doc_id", *lists, *rest)


def full_links(spark, sf_dir):
    f = _full(spark, sf_dir).select("doc_id", stats.electronic().alias("electronic"), links.bundle(F.col).alias("l"))
    return f.select("doc_id", "electronic", *(F.array_join(f"l.{c}", "|").alias(c) for c in ("html_links", "pdf_links", "source_links")), F.col("l.open_access").alias("open_access"), F.array_join(links.in_priority(F.col("l")), "|").alias("urls"), text(links.best(F.col("l"))).alias("best"))


def full_reports(spark, sf_dir):
    """Lines of a search report over filled records."""
    f = _full(spark, sf_dir).withColumn("position", F.col("doc_id").cast("int"))
    return sinks.result_lines(f).select("position", F.md5(F.col("text").cast("binary")).alias("text_md5"))


CITE = {f"cite_{style}": _cite(style) for style in cite.STYLES}
_OWN = [
    search_rerank, search_boolean, search_phrase_wildcard, search_scope_sort_page, search_sort_title, search_by_author, search_by_isbn, search_expanded, search_courses, query_sanitize, by_intent, dictionary_expand,
    rrf_fusion, rrf_rerank_pipeline, signal_scores, cosine_rerank, top_subjects, electronic_count,
    metadata_extract, authors_cascade, links_bundle, isbn_check, issn_check, doi_normalize, url_domain, page_pdf_links, login_page_scan, content_keys,
    export_csv_rows, export_json_rows, file_names, item_mapping, item_summaries, detail_reports,
    batch_lookup, isbn_lookup, found_counts, enrich_missing, dup_doi, dup_isbn, dup_title_author, dup_cascade_status, dup_counts, items_without_pdf, first_pdf_child, collection_members,
    eval_metrics, eval_by_group, eval_summary, latency_percentiles, tool_metrics, facet_counts, query_history, severe_lines,
    budget_windows, budget_global, budget_status, budget_admission, router_state, router_running, router_tiers, tier_order, breaker_runs, breaker_states, capture_history, recent_records, first_seen, backoff_schedule,
    stream_budget, stream_router, stream_breaker, stream_dedup,
    search_sort_author, search_faithful, search_by_subject, search_items, read_article, save_batch, save_tallies, list_collections, collection_upsert, collection_by_name, diagnostics,
    resolve_tiers, fusion_without_ids, seed_hits, citing_works, record_dois, registry_records, item_traces, item_keys, pdf_responses, token_states, cookie_groups, health_tally, missing_terms, subjects_by_ndcg,
    full_metadata, full_links, full_reports,
    star_pricing, star_join, star_anti, star_rollup, star_window, star_top_per_group, star_set_ops, star_json,
]
QUERIES = {f.__name__: f for f in _OWN} | CITE
