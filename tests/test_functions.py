"""Golden vectors of scalar functions."""

import pytest
from pyspark.sql import functions as F

from bibspark.functions import identifiers, people, scoring, text


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>", bytes: "binary", type(None): "string"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("number", "ok"),
    [("978-0-201-89683-1", True), ("978 0 262 01802 9", True), ("978-0-201-89683-9", False), ("0-201-89683-4", True), ("080442957X", True), ("12345", False), ("97802018968312", False), ("abcdefghij", False), ("", False), (None, False)],
)
def test_isbn(spark, number, ok):
    assert one(spark, identifiers.isbn_ok(F.col("n")), n=number) is ok


@pytest.mark.parametrize(("number", "ok"), [("0378-5955", True), ("0317-8471", True), ("0378-5959", False), ("1234", False), (None, False)])
def test_issn(spark, number, ok):
    assert one(spark, identifiers.issn_ok(F.col("n")), n=number) is ok


def test_sanitized(spark):
    def s(q):
        return one(spark, text.sanitized(F.col("q")), q=q)

    for same in ('"CRISPR" AND "sickle cell"', "cultur*", "wom?n"):
        assert s(same) == same
    assert "$$Q" not in s("Murphy$$QMurphy")
    assert s("a\0  b <i>c</i> ") == "a b c"
    assert s(None) == ""
    many = " AND ".join(f"term{i}" for i in range(36))
    assert s(many).endswith("term30") and s(many).count("AND") == 30
    assert len(s("x" * 3000)) == 1000
    assert s("AND " * 40 + "x").count("AND") == 30


@pytest.mark.parametrize(("name", "short"), [("Murphy, Kevin P.$$QMurphy, Kevin P.", "Murphy, K. P."), ("Kevin Murphy", "Murphy, K."), ("Madonna", "Madonna"), ("", "")])
def test_initials(spark, name, short):
    assert one(spark, people.initialled(F.col("n")), n=name) == short


@pytest.mark.parametrize(("name", "last", "first"), [("Smith, J$$QSmith, J", "Smith", "J"), ("John Smith", "Smith", "John"), ("Aristotle", "Aristotle", ""), (None, "", "")])
def test_person(spark, name, last, first):
    p = one(spark, people.person(F.col("n")), n=name)
    assert (p["lastName"], p["firstName"]) == (last, first)


@pytest.mark.parametrize(("url", "d"), [("https://onlinelibrary.wiley.com/x", "wiley.com"), ("not-a-url", "unknown"), ("http://localhost:80/", "localhost"), ("https://bbc.co.uk/", "co.uk"), (None, "unknown")])
def test_domain(spark, url, d):
    assert one(spark, identifiers.domain(F.col("u")), u=url) == d


def test_proxy(spark):
    url = "https://journals.example.com/a?b=1"
    there = one(spark, identifiers.proxied(F.col("u"), "proxy.test.org"), u=url)
    assert there == "https://journals-example-com.proxy.test.org/a?b=1"
    assert one(spark, identifiers.proxied(F.col("u"), "proxy.test.org"), u=there) == there
    assert one(spark, identifiers.unproxied(F.lit("journals-example-com.proxy.test.org"), "proxy.test.org")) == "journals.example.com"


def test_doi(spark):
    assert one(spark, identifiers.doi_key(F.lit(" https://doi.org/10.1/AbC "))) == "10.1/abc"
    assert one(spark, identifiers.doi_url(F.lit("10.1/x"))) == "https://doi.org/10.1/x"
    assert one(spark, identifiers.doi_of_record(F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("https://doi.org/10.2/Y?z=1")))) == "10.2/y"


def test_titles(spark):
    assert one(spark, text.title_similarity(F.lit("Co-op"), F.lit("Coop"))) == 1.0
    assert one(spark, text.title_similarity(F.lit("a b c"), F.lit("b c d"))) == 0.5
    assert one(spark, text.title_similarity(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, text.words(F.lit("Recherche en français EN"))) == ["recherche", "en", "fran", "ais"]


def test_clean(spark):
    assert one(spark, text.clean(F.lit("‘a’ “b” – — … c"))) == "'a' \"b\" - -- ... c"


def test_content(spark):
    import hashlib

    assert one(spark, identifiers.is_pdf(F.col("b")), b=b"%PDF-1.7") is True
    assert one(spark, identifiers.is_pdf(F.col("b")), b=b"%PDX-1.7") is False
    assert one(spark, identifiers.content_key(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()[:16]


def test_token(spark):
    import base64

    body = base64.urlsafe_b64encode(b'{"exp": 100, "sub": "a"}').decode().rstrip("=")
    got = one(spark, identifiers.token_payload(F.col("t"), "exp long, sub string"), t=f"h.{body}.s")
    assert (got["exp"], got["sub"]) == (100, "a")
    assert one(spark, identifiers.token_payload(F.col("t"), "exp long"), t="no") is None
    assert one(spark, identifiers.time_left(F.lit(3900))) == "1h 5m"


def test_recency(spark):
    for date, r in (("2028", 1.1), ("c2012", 0.0), ("", 0.0), ("1990", 0.0)):
        assert one(spark, scoring.recency(F.lit(date), 2026)) == pytest.approx(r)


def test_backoff(spark):
    got = [one(spark, scoring.backoff(F.lit(i), 1.0, 30.0, F.lit(t))) for i, t in ((0, False), (1, False), (2, False), (2, True), (4, True))]
    assert got == [1, 2, 4, 16, 30]


def test_csv(spark):
    for raw, out in (('a"b', '"a""b"'), ("a,b", '"a,b"'), ("a\nb", '"a\nb"'), ("ab", "ab"), (None, "")):
        assert one(spark, text.csv_field(F.col("v")), v=raw) == out
