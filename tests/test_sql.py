"""SQL of the page queries states the parser's rule."""

import html

from sievework.plans import registry


def test_references_without_a_semicolon_are_decoded_in_sql():
    duckdb = __import__("pytest").importorskip("duckdb")
    for text in ("a &amp; b", "cut &amp", "cut &am", "&lt;b&gt &copy", "&quot;x&quot &middot y", "&amp;lt;", "&&&"):
        assert duckdb.execute(f"SELECT {registry._READ.format('?')}", [text]).fetchone()[0] == html.unescape(text)


def test_ingestion_sql_tells_offers_apart_as_the_query_does():
    """Pages of one address and title are one offer: in the SQL, too."""
    duckdb = __import__("pytest").importorskip("duckdb")
    page = lambda n, more: f"('{n}'::BIGINT, 'http://h.example/a', '<article><h1>the de</h1><p>the text{more}</p></article>')"
    pages = f"(VALUES {page(1, ' long')}, {page(2, '')}, {page(5, ' and more')}) t(page_id, url, html)"
    made = duckdb.connect()
    made.execute(f"CREATE TABLE pages AS SELECT * FROM {pages}")
    assert made.execute(f"SELECT count(*) FROM ({registry.ORACLES['e1_ingestion']})").fetchone()[0] == 1
