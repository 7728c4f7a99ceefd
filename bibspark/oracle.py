"""SQL for DuckDB that gives the same rows as the queries, written apart from the engine: predicates are tests on word
lists here, and patterns there."""

from __future__ import annotations

CAT = r"""
b AS (
  SELECT doc_id, lang, source AS src, text,
    CASE WHEN doc_id % 3 = 0 THEN 'TN_cdi_' ELSE 'alma99' END || lpad(doc_id::VARCHAR, 10, '0') AS record_id,
    CASE WHEN doc_id % 97 = 0 THEN '' ELSE trim(substr(replace(text, chr(10), ' '), 1, 80)) END AS t,
    (1995 + doc_id % 30)::VARCHAR AS y,
    (['article', 'book', 'book_chapter', 'conference_proceeding', 'dissertation', 'review', 'journal_article'])[1 + doc_id % 7] AS k,
    '978' || lpad(doc_id::VARCHAR, 9, '0') AS stem,
    'Last' || doc_id % 50 || ', First' || doc_id % 7 || ' M.' AS n1,
    'Last' || (doc_id + 1) % 50 || ', First' || (doc_id + 1) % 7 || ' M.' AS n2,
    'Last' || doc_id % 50 AS l1, 'Last' || (doc_id + 1) % 50 AS l2
  FROM documents),
c0 AS (
  SELECT *, n1 || '$$Q' || l1 AS a1, n2 || '$$Q' || l2 AS a2, k IN ('book', 'book_chapter') AS is_book, doc_id % 3 = 0 AS is_cdi,
    (10 - list_sum(list_transform(range(1, 13), lambda i: substr(stem, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS chk
  FROM b),
cat AS (
  SELECT *,
    CASE WHEN doc_id % 2 = 0 THEN [a1, a2] ELSE [a1] END AS authors,
    CASE WHEN doc_id % 2 = 0 THEN [n1, n2] ELSE [n1] END AS names,
    CASE WHEN is_cdi THEN [array_to_string(CASE WHEN doc_id % 2 = 0 THEN [a1, a2] ELSE [a1] END, ' ; ')] WHEN doc_id % 2 = 0 THEN [a1, a2] ELSE [a1] END AS creator,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'c' || y ELSE y END AS cdate,
    CASE WHEN doc_id % 11 = 0 THEN y WHEN doc_id % 13 = 0 THEN 'c' || y ELSE y END AS mdate,
    'Press ' || doc_id % 9 AS press,
    [lang, src, lang || '--' || src || '$$Qx'] AS subject,
    CASE WHEN is_book THEN stem || chk::INT ELSE '' END AS isbn,
    CASE WHEN doc_id % 4 <> 0 THEN '10.' || (1000 + doc_id % 9) || '/d.' || doc_id ELSE '' END AS doi,
    CASE WHEN is_book THEN '' ELSE (doc_id % 40)::VARCHAR END AS volume, CASE WHEN is_book THEN '' ELSE (doc_id % 12)::VARCHAR END AS issue,
    CASE WHEN is_book THEN '' ELSE (doc_id % 500)::VARCHAR END AS spage, CASE WHEN is_book THEN '' ELSE (doc_id % 500 + 14)::VARCHAR END AS epage,
    CASE WHEN is_cdi THEN 'Journal of ' || src ELSE src END AS journal,
    CASE WHEN k IN ('article', 'journal_article') THEN 'article' WHEN is_book THEN 'book' ELSE 'other' END AS rtype,
    CASE WHEN doc_id % 3 = 1 THEN 'https://host' || doc_id % 12 || '.example.com/' || doc_id ELSE '' END AS link,
    CASE doc_id % 5 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'available_online' ELSE '' END AS avail,
    doc_id % 3 = 1 OR doc_id % 5 IN (0, 1, 2) AS online,
    doc_id % 8 = 0 AS is_course
  FROM c0),
w AS (
  SELECT *, regexp_extract_all(lower(t), '[a-z0-9]+') AS tw,
    regexp_extract_all(lower(array_to_string(list_concat([t], creator, subject, [press, src, isbn]), ' | ')), '[a-z0-9]+') AS aw
  FROM cat),
lib AS (
  SELECT cat.*, upper(lpad(printf('%X', doc_id), 8, 'K')) AS key FROM cat SEMI JOIN labels USING (doc_id))
"""
SCORE = """
  list_unique(list_intersect(tw, Q))::DOUBLE / len(Q) AS s_title,
  CASE WHEN try_cast(substr(cdate, 1, 4) AS INT) IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.05::DOUBLE * (2026 - try_cast(substr(cdate, 1, 4) AS INT))::DOUBLE) END AS s_recency,
  CASE WHEN contains(avail, 'available') OR link <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_fulltext,
  CASE k WHEN 'article' THEN 1.0 WHEN 'journal_article' THEN 1.0 WHEN 'review' THEN 1.0 WHEN 'book' THEN 0.7 WHEN 'book_chapter' THEN 0.7 WHEN 'conference_proceeding' THEN 0.6 WHEN 'dissertation' THEN 0.6 ELSE 0.5 END::DOUBLE AS s_type,
  (CASE WHEN doi <> '' THEN 0.34 ELSE 0 END + 0.33 + CASE WHEN cdate <> '' THEN 0.33 ELSE 0 END)::DOUBLE AS s_complete
"""
TOTAL = "0.35::DOUBLE * s_title + 0.2::DOUBLE * s_recency + 0.2::DOUBLE * s_fulltext + 0.15::DOUBLE * s_type + 0.1::DOUBLE * s_complete"


def q(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([CAT, *more]) + "\n" + body


def scores(words: list[str]) -> str:
    return SCORE.replace("Q", "[" + ", ".join(f"'{x}'" for x in words) + "]")


def has(word: str, where: str = "tw") -> str:
    return f"list_contains({where}, '{word}')"


#: An EV row: a call with tier and success.
EV = """
ev AS (SELECT *, epoch_us(ts) AS us, CASE WHEN event_type IN ('purchase', 'error') THEN 'direct' ELSE 'browser' END AS tier, event_type <> 'error' AS ok FROM events)
"""


def e(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([EV, *more]) + "\n" + body


NORM = r"trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
PAGES = "CASE WHEN is_book THEN '' ELSE spage || '-' || epage END"
DOIURL = "CASE WHEN doi = '' THEN '' ELSE ' https://doi.org/' || doi END"


def initials(n: str, last: str) -> str:
    """'Last7, F. M.' from 'Last7, First3 M.'."""
    return f"{last} || ', F. M.'"


YEAR = "substr(mdate, 1, 4)"
APA = f"""
SELECT record_id, CASE WHEN doc_id % 2 = 0 THEN {initials('n1', 'l1')} || ' & ' || {initials('n2', 'l2')} ELSE {initials('n1', 'l1')} END
  || ' (' || {YEAR} || '). ' || t || '.'
  || CASE WHEN rtype = 'article' THEN ' ' || journal || CASE WHEN volume <> '' THEN ', ' || volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END ELSE '' END || ', ' || {PAGES} || '.' ELSE ' ' || press || '.' END
  || {DOIURL} AS citation FROM cat
"""
WHO = "CASE WHEN doc_id % 2 = 0 THEN n1 || ', and ' || n2 ELSE n1 END || '. ' || CASE WHEN rtype = 'article' THEN '\"' || t || '.\"' ELSE t || '.' END || ' '"
MLA = f"""
SELECT record_id, {WHO}
  || CASE WHEN rtype = 'article' THEN journal || ', vol. ' || volume || ', no. ' || issue || ', ' || {YEAR} || ', pp. ' || {PAGES} || '.' ELSE press || ', ' || {YEAR} || '.' END
  || {DOIURL} AS citation FROM cat
"""
CHICAGO = f"""
SELECT record_id, {WHO}
  || CASE WHEN rtype = 'article' THEN journal || ' ' || volume || ', no. ' || issue || ' (' || {YEAR} || '): ' || {PAGES} || '.' ELSE press || ', ' || {YEAR} || '.' END
  || {DOIURL} AS citation FROM cat
"""


def field(f: str, v: str, cond: str = "TRUE") -> str:
    return f"CASE WHEN {cond} AND {v} <> '' THEN '  {f} = {{' || {v} || '}},' || chr(10) ELSE '' END"


WORD1 = r"coalesce(nullif((string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' '))[1], ''), 'untitled')"
BIBTEX = f"""
SELECT record_id, '@' || CASE WHEN rtype = 'article' THEN 'article' ELSE 'book' END || '{{' || lower(l1) || {YEAR} || lower(regexp_replace({WORD1}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) || ',' || chr(10)
  || '  author = {{' || array_to_string(names, ' and ') || '}},' || chr(10)
  || {field('title', 't')} || {field('year', YEAR)}
  || {field('journal', 'journal', "rtype = 'article'")} || {field('volume', 'volume', "rtype = 'article'")} || {field('number', 'issue', "rtype = 'article'")} || {field('pages', PAGES, "rtype = 'article'")}
  || {field('publisher', 'press', "rtype <> 'article'")} || {field('isbn', 'isbn')} || {field('doi', 'doi')} || '}}' AS citation FROM cat
""".replace("{{", "{").replace("}}", "}")


def tag(code: str, v: str, cond: str = "TRUE") -> str:
    return f"CASE WHEN {cond} AND {v} <> '' THEN '{code}  - ' || {v} || chr(10) ELSE '' END"


ART = "rtype = 'article'"
RIS = f"""
SELECT record_id, CASE WHEN {ART} THEN 'TY  - JOUR' ELSE 'TY  - BOOK' END || chr(10) || 'AU  - ' || array_to_string(names, chr(10) || 'AU  - ') || chr(10)
  || {tag('TI', 't')} || {tag('PY', YEAR)} || {tag('JO', 'journal', ART)} || {tag('VL', 'volume', ART)} || {tag('IS', 'issue', ART)} || {tag('SP', 'spage', ART)} || {tag('EP', 'epage', ART)}
  || {tag('PB', 'press', "rtype <> 'article'")} || {tag('SN', 'isbn')} || {tag('DO', 'doi')} || 'ER  -' AS citation FROM cat
"""


def esc(v: str) -> str:
    return f"CASE WHEN regexp_matches(replace({v}, '\"', '\"\"'), '[,\"\\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE replace({v}, '\"', '\"\"') END"


DUP = f"""
m AS (SELECT *, {NORM} AS nt, list_distinct(string_split({NORM}, ' ')) AS ws FROM cat),
li AS (SELECT m.*, upper(lpad(printf('%X', doc_id), 8, 'K')) AS key FROM m SEMI JOIN labels USING (doc_id)),
by_doi AS (SELECT m.record_id, min(key) AS item_key FROM m JOIN li ON lower(trim(m.doi)) = lower(trim(li.doi)) AND m.doi <> '' GROUP BY 1),
by_isbn AS (SELECT m.record_id, min(key) AS item_key FROM m JOIN li ON m.isbn = li.isbn AND m.isbn <> '' GROUP BY 1),
by_title AS (SELECT m.record_id, min(key) AS item_key FROM m JOIN li ON m.l1 = li.l1 AND m.nt <> '' AND li.nt <> ''
  AND (m.nt = li.nt OR len(list_intersect(m.ws, li.ws))::DOUBLE / len(list_distinct(list_concat(m.ws, li.ws))) > 0.85) GROUP BY 1),
cascade AS (SELECT m.record_id, CASE WHEN d.item_key IS NOT NULL THEN 'doi' WHEN i.item_key IS NOT NULL THEN 'isbn' WHEN x.item_key IS NOT NULL THEN 'title_author' ELSE 'none' END AS match_type,
  coalesce(d.item_key, i.item_key, x.item_key, '') AS item_key FROM m LEFT JOIN by_doi d USING (record_id) LEFT JOIN by_isbn i USING (record_id) LEFT JOIN by_title x USING (record_id))
"""
LEGS = f"""
legs AS (
  SELECT 0 AS list_no, record_id, row_number() OVER (ORDER BY record_id) - 1 AS rank FROM w WHERE {has('the', 'aw')}
  UNION ALL SELECT 1, record_id, row_number() OVER (ORDER BY record_id) - 1 FROM w WHERE list_contains(regexp_extract_all(lower(array_to_string(subject, ' | ')), '[a-z0-9]+'), 'the')
  UNION ALL SELECT 2, record_id, row_number() OVER (ORDER BY record_id) - 1 FROM w WHERE online AND {has('the', 'aw')}),
fused AS (SELECT record_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list_no * 1000 + rank) AS pos FROM legs WHERE rank < @N GROUP BY 1)
"""
ATT = """
att AS (SELECT key AS parent_key, doc_id, n, key || '-' || n AS key, CASE WHEN n = 1 THEN 'attachment' ELSE 'note' END AS item_type,
  CASE WHEN n > 1 THEN '' WHEN doc_id % 2 = 0 THEN 'application/pdf' WHEN doc_id % 5 = 0 THEN 'application/x-PDF' ELSE 'text/html' END AS content_type
  FROM (SELECT key, doc_id, unnest(range(1, doc_id % 3 + 1)) AS n FROM lib))
"""
LIBNAMES = "array_to_string(names, '|')"
EVAL = r"""
rel AS (SELECT item_id AS query_id, doc_id::VARCHAR AS doc_key FROM benchmark p JOIN documents d ON contains(d.text, p.text)),
qw AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(substr(text, 1, 40)), '[a-z0-9]+'))) AS x FROM benchmark),
tt AS (SELECT doc_id, unnest(list_distinct(tw)) AS x FROM w),
hits AS (SELECT query_id, doc_id, count(*) AS n FROM qw JOIN tt USING (x) GROUP BY ALL),
run AS (SELECT query_id, doc_id::VARCHAR AS doc_key, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) - 1 AS rank FROM hits QUALIFY rank < 10),
nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
fd AS (SELECT query_id, sum(1.0 / log2(rank + 2)) AS dcg, min(rank) AS best, count(*) AS c FROM run JOIN rel USING (query_id, doc_key) GROUP BY 1)
"""




#: The catalogue with the fields that `cat` leaves empty.
FULL = """
f AS (
  SELECT *, CASE WHEN doc_id % 17 = 0 THEN '' ELSE record_id END AS rid, is_cdi AND doc_id % 17 <> 0 AS f_cdi,
    CASE WHEN doc_id % 5 = 0 THEN [] ELSE creator END AS f_creator,
    CASE WHEN doc_id % 10 = 0 THEN ['Au' || doc_id % 7 || ', A.'] WHEN doc_id % 30 = 15 THEN ['Found' || doc_id % 7 || ', B.'] WHEN doc_id % 5 = 0 THEN ['Ed' || doc_id % 8 || ', Chris'] ELSE authors END AS f_authors,
    CASE WHEN doc_id % 4 = 0 THEN 'Full journal ' || doc_id % 6 ELSE '' END AS f_jt, CASE WHEN doc_id % 8 = 3 THEN '' ELSE src END AS f_src,
    CASE WHEN doc_id % 7 IN (0, 6) THEN lpad((doc_id % 9999)::VARCHAR, 4, '0') || '-0000' ELSE '' END AS f_issn, CASE WHEN doc_id % 6 = 1 THEN 'e' || doc_id % 100 ELSE '' END AS f_pages,
    CASE WHEN doc_id % 4 = 2 THEN 'https://h.example.com/' || doc_id ELSE '' END AS f_html, CASE WHEN doc_id % 5 = 3 THEN 'https://p.example.com/' || doc_id || '.pdf' ELSE '' END AS f_pdf,
    CASE WHEN doc_id % 2 = 0 THEN '' ELSE avail END AS f_avail
  FROM cat)
"""
QUARTER = DUP.replace("FROM m SEMI JOIN labels USING (doc_id)", "FROM m SEMI JOIN labels USING (doc_id) WHERE doc_id % 4 = 0")
#: Events in the order of each user, and what a stream has decided: all before the watermark, an hour behind the last.
ORDERED = "o AS (SELECT user_id, event_id, event_type AS k, us, ok, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev)"
ADMITTED = """
r AS (
  SELECT user_id, event_id, us, i, 'ok' AS decision, 1 AS n, [us] AS ts, [k] AS ks FROM o WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, us, i, d, n + (d = 'ok')::INT, CASE WHEN d = 'ok' THEN list_append(ts, us) ELSE ts END, CASE WHEN d = 'ok' THEN list_append(ks, k) ELSE ks END FROM (
    SELECT o.*, r.n, r.ts, r.ks, CASE WHEN r.n >= 15 THEN 'session' WHEN len(list_filter(r.ts, lambda x: x > o.us - 86400000000)) >= 3 THEN 'hour'
      WHEN len(list_filter(range(1, len(r.ts) + 1), lambda j: r.ts[j] > o.us - 86400000000 AND r.ks[j] = o.k)) >= 2 THEN 'key' ELSE 'ok' END AS d
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
"""
BROKEN = """
r AS (
  SELECT user_id, event_id, us, i, 'CLOSED' AS before, 'CLOSED' AS after, (NOT ok)::INT AS failures, 0::BIGINT AS opened FROM o WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, us, i, b, CASE WHEN b = 'OPEN' THEN 'OPEN' WHEN ok THEN 'CLOSED' WHEN failures + 1 >= 2 THEN 'OPEN' ELSE b END,
    CASE WHEN b = 'OPEN' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN b <> 'OPEN' AND NOT ok AND failures + 1 >= 2 THEN us ELSE opened END FROM (
    SELECT o.*, r.failures, r.opened, CASE WHEN r.after = 'OPEN' AND o.us - r.opened >= 21600000000 THEN 'HALF_OPEN' ELSE r.after END AS b FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
"""
FINAL = " WHERE us < (SELECT max(us) // 1000 * 1000 - 3600000000 FROM ev)"


def fold(select: str, steps: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([EV, ORDERED, steps]) + "\n" + select


def cut_query(x: str) -> str:
    """The steps of the sanitiser; parts start at an operator each."""
    plain = f"regexp_replace(regexp_replace(replace({x}, chr(0), ''), '<[^>]*>', '', 'g'), '\\$\\$[A-Za-z]', '', 'g')"
    flat = f"trim(regexp_replace(substr({plain}, 1, 1000), '\\s+', ' ', 'g'))"
    parts = f"string_split(regexp_replace({flat}, '\\b(AND|OR|NOT)\\b', chr(1) || '\\1', 'g'), chr(1))"
    return f"rtrim(array_to_string(list_slice({parts}, 1, 31), ''))"


SQL: dict[str, str] = {
    "search_rerank": q(
        f"SELECT record_id, round({TOTAL}, 6) AS score, t AS title FROM (SELECT *, {scores(['the', 'of'])} FROM n) ORDER BY {TOTAL} DESC, position LIMIT 10",
        f"n AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS position FROM w WHERE {has('the', 'aw')} AND {has('of', 'aw')} QUALIFY position < 30)",
    ),
    "search_boolean": q(f"SELECT record_id, t AS title FROM w WHERE ({has('the')} AND {has('of')}) OR ({has('la')} AND NOT {has('de')}) OR {has('article')}"),
    "search_phrase_wildcard": q(
        "SELECT record_id, t AS title FROM w WHERE len(list_filter(range(1, len(tw)), lambda i: tw[i] = 'of' AND tw[i + 1] = 'the')) > 0 "
        "OR len(list_filter(tw, lambda x: (x LIKE 'th_n%') OR (x LIKE '%ation'))) > 0"
    ),
    "search_scope_sort_page": q(
        "SELECT position, record_id, t AS title, cdate AS date FROM n WHERE position < 20",
        f"n AS (SELECT *, row_number() OVER (ORDER BY cdate DESC, record_id) - 6 AS position FROM w WHERE online AND {has('the', 'aw')} QUALIFY position >= 0)",
    ),
    "search_sort_title": q(f"SELECT row_number() OVER (ORDER BY lower(t), record_id) - 1 AS position, record_id, t AS title FROM w WHERE {has('de')} QUALIFY position < 25"),
    "search_by_author": q(
        "SELECT record_id, array_to_string(creator, '|') AS creator FROM cat WHERE list_contains(regexp_extract_all(lower(array_to_string(creator, ' ')), '[a-z0-9]+'), 'last7') "
        "AND list_contains(regexp_extract_all(lower(array_to_string(creator, ' ')), '[a-z0-9]+'), 'first3')"
    ),
    "search_by_isbn": q("SELECT record_id, isbn FROM cat WHERE isbn = '9780000000019'"),
    "search_expanded": q(f"SELECT count(*) AS total FROM w WHERE ({has('the')} AND {has('that')}) OR {has('und')} OR {has('para')}"),
    "search_courses": q("SELECT k AS type, count(*) AS n FROM cat WHERE is_course AND lang = 'en' GROUP BY 1"),
    "query_sanitize": f"""SELECT doc_id, md5({cut_query("'<b>' || text || ' $$Qx</b> AND ' || repeat(lang || ' OR ', 40) || 'end'")}) AS query_md5, md5({cut_query("source || repeat(' AND ' || lang, 36)")}) AS short_md5 FROM documents""",
    "detail_reports": q(
        """SELECT record_id, md5(d) AS detail_md5, length(d)::INT AS n_chars FROM (SELECT record_id, repeat('=', 60) || chr(10) || 'ITEM DETAILS' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'Title: ' || t || chr(10) || chr(10)
  || 'Author(s): ' || array_to_string(creator, ', ') || chr(10) || CASE WHEN cdate <> '' THEN 'Publication Date: ' || cdate || chr(10) ELSE '' END || 'Type: ' || k || chr(10) || 'Publisher: ' || press || chr(10) || 'Source/Journal: ' || src || chr(10)
  || chr(10) || '--- Identifiers ---' || chr(10) || CASE WHEN isbn <> '' THEN 'ISBN: ' || isbn || chr(10) ELSE '' END || CASE WHEN doi <> '' THEN 'DOI: ' || doi || chr(10) ELSE '' END || 'Record ID: ' || record_id || chr(10)
  || chr(10) || '--- Subjects ---' || chr(10) || '- ' || array_to_string(subject, chr(10) || '- ') || chr(10) || chr(10) || '--- Access Links ---' || chr(10) || CASE WHEN link <> '' THEN 'Full Text Link: Available' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 < 4 THEN chr(10) || 'Availability: ' || avail || chr(10) ELSE '' END || chr(10) || '--- Holdings ---' || chr(10) || '  L' || doc_id % 3 || ' - S' || doc_id % 5 || ': QA' || doc_id % 99 || chr(10) AS d FROM cat)"""
    ),
    "by_intent": q(
        "SELECT record_id, t AS title, cdate AS date FROM w WHERE list_contains(aw, 'the') AND k = 'article' AND try_cast(substr(cdate, 1, 4) AS INT) BETWEEN 2000 AND 2015 "
        "ORDER BY try_cast(substr(cdate, 1, 4) AS INT) DESC, record_id LIMIT 30"
    ),
    "dictionary_expand": """SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN '(german OR deutsch)' ELSE lang END || ' ' || source AS rewritten,
  'es AND ' || CASE lang WHEN 'en' THEN 'Castilian' ELSE lang END || ' ' || CASE source WHEN 'src2' THEN 'Castilian' ELSE source END || ' OR ("course reserves" OR "short-term loans" OR readings) (NOT "interlibrary loan")' AS phrases FROM documents""",
    "rrf_fusion": q(
        "SELECT record_id AS fusion_key, round(rrf, 9) AS rrf, (pos // 1000)::INT AS first_list, (pos % 1000)::INT AS first_rank FROM fused ORDER BY fused.rrf DESC, pos LIMIT 50", LEGS.replace("@N", "50")
    ),
    "rrf_rerank_pipeline": q(
        f"SELECT record_id, round({TOTAL}, 6) AS score FROM (SELECT w.*, {scores(['the'])}, row_number() OVER (ORDER BY rrf DESC, pos) AS position FROM fused JOIN w USING (record_id) QUALIFY position <= 30) ORDER BY {TOTAL} DESC, position LIMIT 10",
        LEGS.replace("@N", "30"),
    ),
    "signal_scores": q(
        f"SELECT record_id, round(s_title, 6) AS s_title, round(s_recency, 6) AS s_recency, round(s_fulltext, 6) AS s_fulltext, round(s_type, 6) AS s_type, round(s_complete, 6) AS s_complete, round({TOTAL}, 6) AS score FROM (SELECT record_id, {scores(['the', 'of', 'machine'])} FROM w)"
    ),
    "cosine_rerank": "SELECT vec_id, round(c, 5) AS cosine FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)::DOUBLE[]) AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 20",
    "top_subjects": q(
        "SELECT subject, position::INT AS position, k::INT AS k FROM (SELECT subject, position, k, row_number() OVER (PARTITION BY lower(subject) ORDER BY position, k) AS r FROM s WHERE subject <> '') WHERE r = 1 ORDER BY position, k LIMIT 5",
        f"n AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS position FROM w WHERE {has('the')} QUALIFY position < 50)",
        "s AS (SELECT position, unnest([0, 1, 2]) AS k, split_part(unnest(subject), '$$', 1) AS subject FROM n)",
    ),
    "electronic_count": q("SELECT count(*) AS n_docs, count(*) FILTER (online) AS n_electronic FROM cat"),
    "metadata_extract": q("SELECT record_id, t AS title, mdate AS date, press AS publisher, k AS type, journal AS source, isbn, doi, volume, issue, spage, epage, is_cdi, rtype AS resource_type FROM cat"),
    "authors_cascade": q("SELECT record_id, array_to_string(authors, '|') AS authors, len(authors)::INT AS n FROM cat"),
    "links_bundle": q(
        "SELECT record_id, link AS source_links, CASE WHEN doi = '' THEN '' ELSE 'https://doi.org/' || doi END AS doi_url, doc_id % 10 = 1 AS open_access, "
        "concat_ws('|', CASE WHEN doi <> '' THEN 'https://doi.org/' || doi END, nullif(link, '')) AS urls, coalesce(CASE WHEN doi <> '' THEN 'https://doi.org/' || doi END, link) AS best FROM cat"
    ),
    "isbn_check": q(
        "SELECT doc_id, isbn <> '' AS ok, FALSE AS wrong_ok, list_sum(list_transform(range(1, 11), lambda i: substr(ten, i, 1)::INT * (11 - i))) % 11 = 0 AS ten_ok FROM (SELECT *, lpad((doc_id * 7919)::VARCHAR, 10, '0') AS ten FROM cat)"
    ),
    "issn_check": "SELECT doc_id, (11 - list_sum(list_transform(range(1, 8), lambda i: substr(n, i, 1)::INT * (9 - i))) % 11) % 11 = substr(n, 8, 1)::INT AS ok FROM (SELECT doc_id, lpad((doc_id * 1237)::VARCHAR, 8, '0') AS n FROM documents)",
    "doi_normalize": q("SELECT doc_id, doi AS doi_key, CASE WHEN doi = '' THEN '' ELSE 'https://doi.org/' || doi END AS doi_url FROM cat"),
    "url_domain": r"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain,
  regexp_extract(url, '^([a-z]+://)', 1) || replace(host, '.', '-') || '.proxy.example.org' || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS proxied,
  replace(replace(host, '.', '-'), '-', '.') AS unproxied, regexp_extract(replace(replace(host, '.', '-'), '-', '.'), '([^.]+\.[^.]+)$', 1) AS router_domain FROM h""",
    "page_pdf_links": r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, (len(h) + (page_id % 2 = 0)::INT + (page_id % 3 = 0)::INT + 2 * (page_id % 5 = 0)::INT)::INT AS n_links,
  concat_ws('|', CASE WHEN page_id % 2 = 0 THEN '/x/' || page_id END, CASE WHEN page_id % 3 = 0 THEN '/y/' || page_id END, CASE WHEN page_id % 5 = 0 THEN '/w.PDF' END,
    nullif(array_to_string(list_filter(h, lambda x: suffix(lower(x), '.pdf') OR contains(lower(x), '/pdf/') OR contains(lower(x), 'format=pdf') OR contains(lower(x), 'type=pdf')), '|'), '')) AS pdf FROM h""",
    "login_page_scan": "SELECT page_id, contains(lower(html[:2048]), '<title>login</title>') OR contains(lower(html[:2048]), 'id=\"username\"') OR contains(lower(html[:2048]), '<title>authentication required</title>') AS is_login FROM pages",
    "content_keys": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_key FROM documents",
    "cite_apa": q(APA),
    "cite_mla": q(MLA),
    "cite_chicago": q(CHICAGO),
    "cite_bibtex": q(BIBTEX),
    "cite_ris": q(RIS),
    "export_csv_rows": q(
        f"SELECT record_id, array_to_string([record_id, {esc('t')}, {esc(chr(40) + 'array_to_string(creator, chr(59) || chr(32))' + chr(41))}, cdate, k, press, isbn, '', doi], ',') AS entry FROM cat"
    ),
    "export_json_rows": q("SELECT record_id, t AS title, array_to_string(creator, '; ') AS authors, cdate AS date, k AS type, press AS publisher, isbn, '' AS issn, doi FROM cat"),
    "file_names": q(
        r"""SELECT record_id, CASE WHEN length(f) > 200 THEN substr(f, 1, 196) || '.pdf' ELSE f END AS file_name FROM (
  SELECT record_id, concat_ws(' - ', l1, substr(mdate, 1, 4), nullif(trim(regexp_replace(substr(t, 1, 80), '[<>:"/\\|?*]', '', 'g')), '')) || '.pdf' AS f FROM cat)"""
    ),
    "item_mapping": q(
        f"SELECT key, t AS title, {LIBNAMES} AS authors, mdate AS date, CASE rtype WHEN 'article' THEN 'journalArticle' WHEN 'book' THEN 'book' ELSE 'document' END AS item_type, doi, isbn, CASE WHEN rtype = 'book' THEN press ELSE journal END AS publication FROM lib"
    ),
    "item_summaries": q(
        "SELECT key, 'Title: ' || t || chr(10) || 'Authors: ' || array_to_string(names, '; ') || chr(10) || 'Date: ' || mdate || chr(10) || 'Type: ' || CASE rtype WHEN 'article' THEN 'journalArticle' WHEN 'book' THEN 'book' ELSE 'document' END || chr(10) "
        "|| 'Publication: ' || CASE WHEN rtype = 'book' THEN press ELSE journal END || CASE WHEN doi <> '' THEN chr(10) || 'DOI: ' || doi ELSE '' END || CASE WHEN isbn <> '' THEN chr(10) || 'ISBN: ' || isbn ELSE '' END "
        "|| chr(10) || 'Tags: ' || lang || chr(10) || 'Collections: COL' || lang || chr(10) || 'Key: ' || key AS summary FROM lib"
    ),
    "batch_lookup": q(
        "SELECT l.doc_id::INT AS pos, CASE WHEN quality = 1 THEN record_id ELSE 'missing' || l.doc_id END AS id, quality = 1 AS found, CASE WHEN quality = 1 THEN t ELSE '' END AS title FROM labels l JOIN cat USING (doc_id)"
    ),
    "isbn_lookup": q("SELECT doc_id::INT AS pos, CASE WHEN isbn <> '' THEN substr(isbn, 1, 3) || '-' || substr(isbn, 4, 10) ELSE '0' END AS id, isbn <> '' AS found, CASE WHEN isbn <> '' THEN record_id ELSE '' END AS record_id FROM cat"),
    "found_counts": q("SELECT count(*) FILTER (isbn <> '') AS n_found, count(*) FILTER (isbn = '') AS n_missing FROM cat"),
    "enrich_missing": q(
        "SELECT record_id, CASE WHEN is_cdi AND doi = '' THEN '' ELSE mdate END AS date, CASE WHEN is_cdi AND doi = '' THEN '' ELSE array_to_string(authors, '|') END AS authors, is_cdi AND doi <> '' AS enriched FROM cat"
    ),
    "dup_doi": q("SELECT * FROM by_doi", DUP),
    "dup_isbn": q("SELECT * FROM by_isbn", DUP),
    "dup_title_author": q("SELECT * FROM by_title", DUP),
    "dup_cascade_status": q("SELECT * FROM cascade", DUP),
    "dup_counts": q("SELECT match_type, count(*) AS n FROM cascade GROUP BY 1", DUP),
    "items_without_pdf": q("SELECT key, t AS title FROM lib WHERE key NOT IN (SELECT parent_key FROM att WHERE item_type = 'attachment' AND contains(lower(content_type), 'pdf'))", ATT),
    "first_pdf_child": q("SELECT parent_key, min(key) AS pdf_key FROM att WHERE item_type = 'attachment' AND lower(content_type) = 'application/pdf' GROUP BY 1", ATT),
    "collection_members": q("SELECT 'COL' || lang AS collection_key, 'Texts ' || lang AS name, count(*) AS n_items, min(key) AS first_item FROM lib GROUP BY ALL"),
    "eval_metrics": q(
        "SELECT query_id, n_rel, round(coalesce(dcg, 0) / (SELECT sum(1.0 / log2(i + 2)) FROM range(10) t(i) WHERE i < n_rel), 6) AS ndcg, round(coalesce(1.0 / (best + 1), 0), 6) AS mrr, round(coalesce(c, 0)::DOUBLE / n_rel, 6) AS recall FROM nr LEFT JOIN fd USING (query_id)",
        EVAL,
    ),
    "eval_by_group": "SELECT lang AS subject, count(*) AS n, round(avg(quality::DOUBLE), 4) AS ndcg, round(avg(toxic::DOUBLE), 4) AS mrr, round(avg((quality + toxic) / 2.0::DOUBLE), 4) AS recall FROM documents JOIN labels USING (doc_id) WHERE doc_id % 13 <> 0 GROUP BY 1",
    "eval_summary": e(
        "SELECT (SELECT count(*) FROM ev) AS n_queries, count(*) AS n_valid, (SELECT count(*) FROM ev WHERE NOT ok) AS n_errors, round(avg((event_id % 2)::DOUBLE), 4) AS ndcg, round(avg(event_id % 3 / 2.0::DOUBLE), 4) AS mrr, round(avg(event_id % 5 / 4.0::DOUBLE), 4) AS recall, "
        "round(avg(value), 1) AS latency_mean, round(list_sort(list(value))[least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::BIGINT + 1], 1) AS latency_p50, round(list_sort(list(value))[least(floor(count(*) * 0.95::DOUBLE), count(*) - 1)::BIGINT + 1], 1) AS latency_p95 FROM ev WHERE ok"
    ),
    "latency_percentiles": "SELECT event_type, list_sort(list(value))[least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::BIGINT + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.95::DOUBLE), count(*) - 1)::BIGINT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "tool_metrics": "SELECT event_type AS tool, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, round(sum(value), 4) AS total_latency, round(avg(value), 6) AS avg_latency FROM events GROUP BY 1",
    "facet_counts": q(
        "SELECT 'type' AS facet, k AS value, count(*) AS n FROM cat GROUP BY ALL UNION ALL SELECT 'language', lang, count(*) FROM cat GROUP BY ALL "
        "UNION ALL SELECT 'year', try_cast(substr(cdate, 1, 4) AS INT)::VARCHAR, count(*) FROM cat WHERE try_cast(substr(cdate, 1, 4) AS INT) IS NOT NULL GROUP BY ALL"
    ),
    "query_history": e(
        "SELECT event_id, user_id, refinement FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 3600000000, FALSE) AS refinement FROM ev WHERE event_type = 'view') WHERE ts >= TIMESTAMP '2024-01-15'"
    ),
    "severe_lines": "SELECT conv_id * 1000 + turn AS line_no, substr('2024 ' || (['[ERROR]', 'INFO', 'WARNING'])[1 + conv_id % 3] || ' ' || role, 1, 200) AS line FROM conversations WHERE conv_id % 3 <> 1 ORDER BY line_no DESC LIMIT 10",
    "budget_windows": e(
        'SELECT event_id, n AS n_in_hour, n > 5 AS "over" FROM (SELECT event_id, count(*) OVER x - (row_number() OVER (PARTITION BY event_type, us ORDER BY event_id DESC) - 1) AS n FROM ev WINDOW x AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))'
    ),
    "budget_global": e(
        'SELECT event_id, n AS n_in_hour, n > 20 AS "over" FROM (SELECT event_id, count(*) OVER x - (row_number() OVER (PARTITION BY us ORDER BY event_id DESC) - 1) AS n FROM ev WINDOW x AS (ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))'
    ),
    "budget_status": e("SELECT event_type, count(*) AS used, greatest(50 - count(*), 0) AS remaining FROM ev WHERE us > 1705320000000000 - 4 * 3600000000 AND us <= 1705320000000000 GROUP BY 1"),
    "router_state": e("SELECT user_id, CASE WHEN bool_or(tier = 'direct' AND ok) THEN 'DIRECT_OK' WHEN bool_or(tier = 'direct' AND NOT ok) THEN 'BROWSER_ONLY' ELSE 'UNKNOWN' END AS source_class FROM ev GROUP BY 1"),
    "router_running": e(
        "SELECT event_id, CASE WHEN bool_or(tier = 'direct' AND ok) OVER x THEN 'DIRECT_OK' WHEN bool_or(tier = 'direct' AND NOT ok) OVER x THEN 'BROWSER_ONLY' ELSE 'UNKNOWN' END AS source_class FROM ev WINDOW x AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"
    ),
    "router_tiers": e("SELECT user_id, coalesce(string_agg(DISTINCT CASE WHEN ok THEN tier END, ',' ORDER BY CASE WHEN ok THEN tier END), '') AS succeeded, coalesce(string_agg(DISTINCT CASE WHEN NOT ok THEN tier END, ','), '') AS failed FROM ev GROUP BY 1"),
    "tier_order": e("SELECT user_id, CASE WHEN NOT bool_or(tier = 'direct' AND ok) AND bool_or(tier = 'direct' AND NOT ok) THEN 'browser,browser_proxy,direct,direct_proxy,cookies' ELSE 'direct,direct_proxy,cookies,browser,browser_proxy' END AS tiers FROM ev GROUP BY 1"),
    "breaker_runs": e(
        "SELECT user_id, arg_min(event_id, (us, event_id)) AS first_event, arg_max(event_id, (us, event_id)) AS last_event, count(*) AS length FROM g WHERE NOT ok GROUP BY user_id, run HAVING count(*) >= 3",
        "g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ev)",
    ),
    "capture_history": e("SELECT event_id, event_type FROM ev WHERE event_type <> 'signup' ORDER BY us DESC, event_id DESC LIMIT 50"),
    "recent_records": "SELECT user_id::VARCHAR AS record_id, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY first_seen DESC, record_id LIMIT 50",
    "first_seen": e("SELECT user_id, event_id, event_type, us AS micros FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1"),
    "backoff_schedule": e("SELECT event_id, CASE WHEN ok THEN least(power(2.0, event_id % 8), 30) ELSE least(4 * least(power(2.0, event_id % 8), 30), 30) END::DOUBLE AS delay FROM ev"),
    "stream_router": e("SELECT user_id, CASE WHEN bool_or(tier = 'direct' AND ok) THEN 'DIRECT_OK' WHEN bool_or(tier = 'direct' AND NOT ok) THEN 'BROWSER_ONLY' ELSE 'UNKNOWN' END AS source_class FROM ev GROUP BY 1"),
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "star_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL",
    "star_join": "SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "star_anti": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-05-01') GROUP BY ALL",
    "star_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "star_window": "SELECT o_orderkey, (row_number() OVER x)::INT AS nth, lag(o_orderkey) OVER x AS before FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "star_top_per_group": "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS r FROM orders) WHERE r <= 3",
    "star_set_ops": "SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT k, 'more' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'any' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "star_json": "SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1",
    "budget_admission": fold("SELECT event_id, user_id AS session, decision FROM r", ADMITTED),
    "stream_budget": fold("SELECT event_id, user_id AS session, decision FROM r" + FINAL, ADMITTED),
    "breaker_states": fold("SELECT user_id, event_id, before, after FROM r", BROKEN),
    "stream_breaker": fold("SELECT user_id, event_id, before, after FROM r" + FINAL, BROKEN),
    "search_sort_author": q(f"SELECT row_number() OVER (ORDER BY lower(creator[1]), record_id) - 1 AS position, record_id, creator[1] AS creator FROM w WHERE {has('de')} QUALIFY position < 25"),
    "search_faithful": q(
        f"SELECT record_id, round({TOTAL}, 6) AS score FROM (SELECT *, {scores(['the'])} FROM n) ORDER BY {TOTAL} DESC, position LIMIT 10",
        f"n AS (SELECT *, row_number() OVER (ORDER BY cdate DESC, record_id) - 1 AS position FROM w WHERE {has('the', 'aw')} QUALIFY position < 30)",
    ),
    "search_by_subject": q("SELECT row_number() OVER (ORDER BY record_id) - 1 AS position, record_id FROM cat WHERE lang = 'fr' QUALIFY position < 15"),
    "search_items": q(
        "SELECT key, mdate AS date FROM (SELECT *, regexp_extract_all(lower(concat_ws(' | ', t, lang, CASE WHEN rtype = 'book' THEN '' ELSE journal END)), '[a-z0-9]+') AS ws FROM lib) WHERE list_contains(ws, 'the') AND NOT list_contains(ws, 'of') ORDER BY mdate DESC, key LIMIT 100"
    ),
    "read_article": q("SELECT record_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || chr(10) || chr(10) || '[Text truncated at 150 characters]' ELSE text END AS text FROM cat WHERE doc_id IN (1, 2, 4, 5)"),
    "save_batch": q(
        "SELECT pos, id, status, CASE WHEN status = 'saved' THEN upper(substr(sha256('COLen/new papers'), 1, 8)) ELSE '' END AS collections FROM (SELECT pos, id, CASE WHEN match_type IS NULL THEN 'failed' WHEN match_type <> 'none' OR again THEN 'skipped' ELSE 'saved' END AS status "
        "FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) > 1 AS again FROM ids) LEFT JOIN cascade ON id = record_id)",
        QUARTER,
        "ids AS (SELECT doc_id::INT AS pos, record_id AS id FROM cat WHERE doc_id < 12 UNION ALL SELECT 12, 'none' UNION ALL SELECT 13, 'alma990000000001')",
    ),
    "save_tallies": q(
        "SELECT CASE WHEN match_type IS NULL THEN 'failed' WHEN match_type <> 'none' OR again THEN 'skipped' ELSE 'saved' END AS status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) > 1 AS again FROM ids) LEFT JOIN cascade ON id = record_id GROUP BY 1",
        QUARTER,
        "i1 AS (SELECT doc_id AS pos, CASE WHEN quality = 1 THEN record_id ELSE 'missing' || doc_id END AS id FROM labels JOIN cat USING (doc_id))",
        "ids AS (SELECT * FROM i1 UNION ALL SELECT pos + 100000000, id FROM i1 WHERE pos % 10 = 0)",
    ),
    "list_collections": "SELECT 'COL' || lang AS key, 'Texts ' || lang AS name, 'All' AS parent_name, count(*)::INT AS num_items FROM documents GROUP BY lang UNION ALL SELECT 'ROOT', 'All', '', 0",
    "collection_upsert": "SELECT DISTINCT 'COL' || lang AS key, 'Texts ' || lang AS name, 'ROOT' AS parent_key FROM documents UNION ALL VALUES ('N2', 'Texts en', ''), ('N3', 'other', 'ROOT')",
    "collection_by_name": "SELECT DISTINCT 'COL' || lang AS key, 'Texts ' || lang AS name FROM documents WHERE lang = 'de'",
    "diagnostics": """
WITH l AS (SELECT conv_id * 1000 + turn AS line_no, '2024 ' || (['ERROR', 'INFO', 'WARNING'])[1 + conv_id % 3] || ' ' || role AS line FROM conversations WHERE conv_id % 3 <> 1 ORDER BY line_no DESC LIMIT 10)
SELECT 'credentials' AS section, 0 AS line_no, 'items_key is empty' AS line UNION ALL SELECT 'credentials', 1, 'items_user is empty' UNION ALL SELECT 'errors', line_no, line FROM l
UNION ALL SELECT 'metrics', row_number() OVER (ORDER BY event_type) - 1, event_type || ': ' || count(*) || ' calls, ' || count(*) FILTER (event_type = 'error') || ' errors, avg ' || printf('%.2f', avg(value)) || 's' FROM events GROUP BY event_type""",
    "resolve_tiers": q(
        "SELECT doc_id::INT AS pos, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 ELSE -1 END AS source_no, "
        "CASE WHEN doc_id % 2 = 0 THEN '2 ' || t WHEN doc_id % 3 = 0 THEN '3 ' || t WHEN doc_id % 5 = 0 THEN '5 ' || t ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 THEN mdate ELSE '' END AS date FROM cat"
    ),
    "fusion_without_ids": q(
        "SELECT key AS fusion_key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min({'l': l, 'r': rank}).l AS first_list, min({'l': l, 'r': rank}).r AS first_rank FROM x GROUP BY key",
        FULL,
        "k AS (SELECT doc_id, CASE WHEN rid = '' THEN '_fallback_' || substr(t, 1, 50) ELSE rid END AS key FROM f)",
        "x AS (SELECT key, 0 AS l, doc_id::INT AS rank FROM k WHERE doc_id % 2 = 0 UNION ALL SELECT key, 1, (doc_id // 3)::INT FROM k WHERE doc_id % 3 = 0)",
    ),
    "seed_hits": q("SELECT doc_id % 20 AS query_id, CASE WHEN doi <> '' THEN doc_id < 200 END AS seed_found FROM cat WHERE doc_id < 400 AND doc_id % 21 = doc_id // 20"),
    "citing_works": q(
        "SELECT 1 AS query_id, '10.9/seed1' AS doc_key UNION ALL SELECT 2, '10.9/seed2' UNION ALL SELECT 4, '10.9/none' UNION ALL SELECT k, doi FROM (SELECT cat.doc_id % 3 AS k, doi, row_number() OVER (PARTITION BY cat.doc_id % 3 ORDER BY n_chars DESC, doi) AS r FROM cat JOIN documents USING (doc_id) WHERE doi <> '') WHERE k > 0 AND r <= 50"
    ),
    "record_dois": q("SELECT doc_id, CASE WHEN doi <> '' THEN doi WHEN doc_id % 8 = 0 THEN '10.5/abc' || doc_id ELSE '' END AS doi FROM cat"),
    "registry_records": """SELECT '10.1/' || doc_id AS doi, lang AS title, 'Fam' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ', Giv' ELSE '' END AS authors, CASE WHEN doc_id % 3 = 0 THEN '2001' ELSE '1999' END AS date, CASE WHEN doc_id % 5 > 0 THEN source ELSE '' END AS source,
  '' AS publisher, doc_id::VARCHAR AS volume, CASE WHEN doc_id % 4 < 2 THEN '12' ELSE '' END AS spage, CASE WHEN doc_id % 4 = 1 THEN '34-5' ELSE '' END AS epage, CASE doc_id % 4 WHEN 0 THEN '12' WHEN 1 THEN '12-34-5' ELSE '' END AS pages,
  '1234-5679' AS issn, '' AS isbn, CASE WHEN doc_id % 2 = 0 THEN 'article' ELSE 'other' END AS resource_type FROM documents""",
    "item_traces": q("SELECT key, 'Record-ID: ' || record_id AS extra FROM lib WHERE starts_with(record_id, 'alma99000000001')"),
    "item_keys": q("SELECT key, doc_id % 3 = 1 AS is_key, doc_id || ':' || CASE WHEN doc_id % 2 = 0 THEN key ELSE 'None' END AS cached_as FROM lib"),
    "pdf_responses": "SELECT page_id, (page_id % 3 = 0 OR page_id % 4 = 1 OR suffix(lower(url), '.pdf')) AND page_id % 5 < 2 AS is_pdf FROM pages",
    "token_states": "SELECT event_id, event_id::VARCHAR AS user, d > 60 AS valid, d < 120 AS refresh, (greatest(d, 0) // 3600) || 'h ' || (greatest(d, 0) % 3600 // 60) || 'm' AS left FROM (SELECT event_id, event_id % 300 * 7 - 100 AS d FROM events)".replace("AS user", 'AS "user"').replace("AS left", 'AS "left"'),
    "cookie_groups": """
WITH c AS (SELECT event_type AS domain, event_id % 4 AS k, (['__Secure-', 'WEBPROXY', 'sid', '__Host-'])[1 + event_id % 4] || user_id AS name FROM events WHERE event_id < 2000)
SELECT domain, string_agg(name, ',' ORDER BY name) AS names, count(*) FILTER (k = 1) AS n_proxy, count(*) FILTER (k IN (0, 3)) AS n_secure, count(*) FILTER (k = 2) AS n_other FROM c GROUP BY domain""",
    "health_tally": e("SELECT CASE WHEN ok THEN array_to_string(list_filter(['k', 'total'], lambda x: NOT list_contains(json_keys(props), x)), ',') ELSE 'down' END AS status, count(*) AS n FROM ev GROUP BY 1"),
    "missing_terms": "(SELECT term FROM (SELECT DISTINCT source AS term FROM documents UNION ALL VALUES ('src_none'), ('en'))) EXCEPT ALL (SELECT source FROM documents WHERE doc_id % 20 < 12 UNION ALL SELECT lang FROM documents)",
    "subjects_by_ndcg": "SELECT lang AS subject, round(avg(quality::DOUBLE), 4) AS ndcg FROM documents JOIN labels USING (doc_id) WHERE doc_id % 13 <> 0 GROUP BY 1 ORDER BY ndcg DESC, subject LIMIT 2",
    "full_metadata": q(
        "SELECT doc_id, array_to_string(f_authors, '|') AS authors, array_to_string(f_creator, '|') AS creators, 'Ed' || doc_id % 8 || ', Chris' AS contributors, t AS title, mdate AS date, press AS publisher, k AS type, "
        "CASE WHEN f_cdi THEN coalesce(nullif(f_jt, ''), f_src) ELSE coalesce(nullif(f_src, ''), f_jt) END AS source, isbn, f_issn AS issn, doi, volume, issue, spage, epage, f_pages AS pages, f_cdi AS is_cdi, rtype AS resource_type FROM f WHERE rid <> ''",
        FULL,
    ),
    "full_links": q(
        "SELECT doc_id, link <> '' OR f_html <> '' OR contains(f_avail, 'available') AS electronic, f_html AS html_links, f_pdf AS pdf_links, link AS source_links, doc_id % 10 = 1 OR doc_id % 9 = 4 AS open_access, "
        "concat_ws('|', nullif(f_pdf, ''), u, nullif(link, ''), nullif(f_html, '')) AS urls, coalesce(nullif(f_pdf, ''), u, nullif(link, ''), f_html) AS best FROM (SELECT *, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi END AS u FROM f)",
        FULL,
    ),
    "full_reports": q(
        """SELECT doc_id::INT AS position, md5((doc_id + 1) || '. ' || t || chr(10) || '   Author: ' || coalesce(f_creator[1], 'Unknown') || chr(10) || '   Date: ' || cdate || chr(10) || '   Type: ' || k || chr(10)
  || '   Subjects: ' || lang || ', ' || src || ', ' || lang || '--' || src || chr(10) || CASE WHEN f_src <> '' THEN '   Source: ' || f_src || chr(10) ELSE '' END || '   Publisher: ' || press || chr(10)
  || CASE WHEN isbn <> '' THEN '   ISBN: ' || isbn || chr(10) ELSE '' END || CASE WHEN f_issn <> '' THEN '   ISSN: ' || f_issn || chr(10) ELSE '' END || CASE WHEN doi <> '' THEN '   DOI: ' || doi || chr(10) ELSE '' END
  || CASE WHEN rid <> '' THEN '   Record ID: ' || rid || chr(10) ELSE '' END || CASE WHEN f_avail <> '' THEN '   Availability: ' || f_avail || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 1 THEN '   Description: About ' || lang || ' and more...' || chr(10) ELSE '' END || CASE WHEN link <> '' OR f_html <> '' THEN '   Full Text: Available' || chr(10) ELSE '' END || chr(10)) AS text_md5 FROM f""",
        FULL,
    ),
}
