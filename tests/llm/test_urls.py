"""URL filters: rules and parts of urls against a plain version, the tree on planted templates."""

import re

import pytest
from pyspark.sql import functions as F

from capstrata.llm import urls

SF = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path):
    best = None
    for text, verdict in urls.RULES:
        of, slash, start = text.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + start) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best or (None, None)


def test_query_parts_and_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in urls.op1_urls(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, r in got.items():
        assert (r.host, r.path) == parts(pages[i])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_hard_urls(spark):
    hard = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/A?x=/b#c", "http://example.com?q", "x://a://b/c", "http://com/", "http://telecom/en/", "http://b.net/es/1", "http://b.net/es", "http://É.com/ü", "a\n://h\n/p\nq"]
    pages = spark.createDataFrame(list(enumerate(hard)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("shape", F.lit(1))
    pages = pages.union(pages)
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()
    assert len(got) == 2 * len(hard)
    for r in got:
        assert (r.host, r.path) == parts(hard[r.page_id]), hard[r.page_id]
        assert r.rule == plain_rule(r.host, r.path)[0]
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_tree_generalises_merges_and_rejects(spark):
    rows, labels = [], []

    def add(url, bad=None):
        rows.append((len(rows), url))
        if bad is not None:
            labels.append((len(rows) - 1, bad))

    for k in range(60):
        add(f"http://h.org/spam/{k}.html", True)
        add(f"http://h.org/news/{k}", False)
        add(f"http://h.org/blog/{k}", False)
        add(f"http://h.org/post/title-of-{chr(97 + k % 26)}{'x' * k}", k % 20 == 0)
    add("http://h.org/spam/none.html")
    add("http://h.org/spam/999.html")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert got[0].template == got[len(rows) - 2].template == "/spam/**" and got[0].verdict == "block" and got[len(rows) - 1].verdict == "block"
    assert got[1].template.endswith(("/*", "/**")) and got[1].verdict == got[2].verdict == got[3].verdict == "allow"
    assert len({r.template for r in got.values() if "/post/" in r.path}) <= 2


@pytest.mark.parametrize("path,want", [("/a/12/x.html", ["a", "*", "x.html"]), ("//a//", ["a"]), ("", []), ("/deadbeef01/9.php", ["*", "*.php"]), ("/" + "/".join("abcdefghij"), [*"abcdefghij"]), ("/a/a/b/b/b/a/7/8", ["a", "b", "a", "*"])])
def test_segments(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(urls.segments(F.col("p")).alias("s")).first().s == want


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/en/7.html"), (2, "http://a/en/8?x=9"), (3, None), (4, "http://a/none")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.page_labels(pages, labels).collect())) == [(1, True), (2, True)]


def verdicts(spark, made):
    """made: (url, bad or None) of each page."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(made) if b is not None], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert len(got) == len(made)
    return [got[i] for i in range(len(made))]


def test_hot_bad_branch_among_many_thin_ones(spark):
    made = [(f"http://h.org/s{chr(97 + k % 26)}{k}x/{k}", False) for k in range(50)] + [(f"http://h.org/casino/{k}", True if k < 9 else None) for k in range(40)]
    got = verdicts(spark, made)
    assert {r.verdict for r in got[:50]} == {"allow"} and len({r.template for r in got[:50]}) == 1
    assert {(r.verdict, r.template) for r in got[50:]} == {("block", "/casino/*")}


def test_merged_branches_stay_apart_from_a_bad_wildcard(spark):
    made = [(f"http://h.org/{k}", True) for k in range(40)]  # variable by form, all bad
    made += [(f"http://h.org/{name}", k % 4 == 0) for name in ("mixed", "other", "third") for k in range(8)]
    made += [(f"http://h.org/good/{k}", False) for k in range(40)]
    got = verdicts(spark, made)
    assert {(r.verdict, r.template) for r in got[:40]} == {("block", "/*")}
    assert {r.verdict for r in got[40:]} == {"allow"}


def test_branches_that_part_deep_down(spark):
    deep = "/".join(f"d{chr(97 + i)}" for i in range(12))
    made = [(f"http://h.org/{deep}/{'bad' if k % 2 else 'good'}/{k}", k % 2 == 1) for k in range(40)] + [(f"http://h.org/{deep}", None)]
    got = verdicts(spark, made)
    assert [r.verdict for r in got[:40]] == ["allow", "block"] * 20 and got[40].verdict == "allow"


def test_sides_merge_with_their_own_kind(spark):
    made = [(f"http://h.org/{side}{chr(97 + b)}/x", side == "bad") for side in ("bad", "good") for b in range(8) for _ in range(12)]
    got = verdicts(spark, made)
    assert {(r.template, r.verdict) for r in got} == {("/**+/x", "block"), ("/**-/x", "allow")}
