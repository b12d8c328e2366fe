import duckdb
import pytest
from pyspark.sql import functions as F

from stridegrid.llm import url_filter
from stridegrid.llm.components import components
from stridegrid.llm.queries import OP5_SQL, URL_RULES, op5_url_filter
from stridegrid.llm.url_filter import filter_urls


def page(to=None, how="canonical"):
    if to is None:
        return "<html></html>"
    if how == "canonical":
        return f'<html><head><LINK href="{to}" rel="canonical"></head></html>'
    return f"<meta http-equiv='refresh' content='0; url={to}'>"


ROWS = [
    (1, "http://a.example.org/es/1", page()),  # blocked by rule, longest wins over org/
    (2, "https://B.Example.ORG/en/12?q#f", page()),
    (3, "http://x.org/", page()),
    (4, "http://x.com/de/5", page()),
    (5, "http://x.net/1", page("http://y.net/2")),  # alias of an alias of a blocked page
    (6, "http://y.net/2", page("//example.org/es/9", "refresh")),
    (7, "http://z.net/1", page("http://x.com/de/5")),
    (8, "http://z.net/1?other", page("http://z.net/1")),
    (9, "http://w.net/1", page("http://example.org/es/77")),  # blocked and allowed alias: allow goes first
    (10, "http://w.net/2", page("http://w.net/1")),
    (11, "http://ok.org/p", page("/../w.net")),
    (12, "http://w.net/1", page("http://fine.org/1")),
    (13, "http://x.com/de/6", page("http://fine.org/2")),  # its own rule before the allowed alias
    (14, None, None),
    (15, "not a url", page("http://x.com/de/5")),
    (16, "http://notexample.org", page()),
    (16, "http://notexample.org", page()),
    (None, "http://q.net/a/b", page("c&amp;d")),
    (17, "http://q.net/a/c&d", page("http://x.com/de/5")),
]
WANT = {
    1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/de/", "block"),
    5: (None, "block"), 6: (None, "block"), 7: (None, "block"), 8: (None, "block"), 9: (None, "allow"),
    10: (None, "allow"), 11: ("org/", "allow"), 12: (None, "allow"), 13: ("com/de/", "block"), 14: (None, "allow"),
    15: (None, "allow"), 16: (None, "allow"), None: (None, "block"), 17: (None, "block"),
}


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id bigint, url string, html string, node string")
    got = filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(ROWS)
    assert {r.page_id: (r.rule, r.verdict) for r in got} == WANT
    at = {r.page_id: (r.host, r.path) for r in got}
    assert at[2] == ("b.example.org", "/en/12") and at[14] == at[15] == ("", "") and at[16] == ("notexample.org", "")
    assert filter_urls(pages.where("false"), URL_RULES).count() == 0


@pytest.mark.parametrize("most", [1_000, 0])
def test_query_and_sql_agree_on_pages_with_aliases(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_RULES", most)
    late = "<meta http-equiv=refresh content='300; url=http://x.com/de/5'>"
    rows = [
        *ROWS,
        (20, "http://late.net/1", late),
        (21, "http://noted.net/1", f"<!-- {page('http://x.com/de/5')} --><script>var a='{page('http://x.com/de/5')}'</script>"),
        (22, "http://two.net/1", page("http://fresh.net/1") + page("http://x.com/de/5")),
        (23, "http://now.net/1", '<META content="0.0;URL=http://x.com/de/5" http-equiv="refresh">'),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = op5_url_filter(spark, str(tmp_path)).collect()
    at = {r.page_id: r.verdict for r in got}
    assert [at[i] for i in (20, 21, 22, 23)] == ["allow", "allow", "block", "block"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP5_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_many_rules_ties_and_none(spark):
    rules = [("block", f"h{i % 40}.net/{'d' * (i % 7)}{i}") for i in range(1_500)]
    rules += [("block", "tie.net/a"), ("allow", "tie.net/a"), ("block", "b.tie.net/"), ("allow", "tie.net/abc"), ("block", "net/x")]
    urls = [f"http://www.h{i % 40}.net/{'d' * (i % 7)}{i}/z" for i in range(0, 1_500, 7)]
    urls += ["http://tie.net/a", "http://b.tie.net/abc", "http://q.net/x?1", "http://net/x", "http://xnet/x", "http://.net/x", "http://a..net/x", None]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")

    def fits(rule, host, path):
        domain, _, start = rule.partition("/")
        return ("." + host).endswith("." + domain) and path.startswith("/" + start)

    def wanted(host, path):
        found = [(len(r), v == "allow", r, v) for v, r in rules if fits(r, host, path)]
        return max(found)[2:] if found else (None, "allow")

    table = spark.createDataFrame([*rules, (None, "q.net/"), ("block", None), *rules[:3]], "verdict string, rule string")
    for given in (rules, table):
        got = filter_urls(pages, given).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r.rule, r.verdict) == wanted(r.host, r.path)
    tied = filter_urls(pages, [("block", "tie.net/a"), ("allow", "tie.net/a")]).where(F.col("url") == "http://tie.net/a").first()
    assert tied.verdict == "allow"
    assert {r.verdict for r in filter_urls(pages, []).collect()} == {"allow"}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200), (201, 202)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in range(200, 203)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
