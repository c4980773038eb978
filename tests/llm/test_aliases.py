import random

import pytest
from pyspark.sql import functions as F

from askframe.llm import aliases
from askframe.llm.queries import URL_RULES


def page(target=None, kind="canonical"):
    if target is None:
        return "<html><p>x</p></html>"
    if kind == "canonical":
        return f"<head><LINK href='{target}' rel=\"canonical\"></head>"
    return f'<meta http-equiv="Refresh" content="0; URL={target}">'


def judged(spark, rows, **more):
    df = spark.createDataFrame(
        [(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = aliases.judge(df.repartition(3).withColumn("node", F.lit(1)), URL_RULES, **more).collect()
    return [tuple(r)[2:] for r in sorted(got, key=lambda r: r.page_id)]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://www.example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/es", "example.org", "/es", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
    ("https://a.com/de/x://y", "a.com", "/de/x://y", "com/de/", "block"),
    ("ftp://a.com?/de/", "a.com", "", None, "allow"),
    ("x://É.com/fr/\n", "É.com", "/fr/\n", "com/fr/", "allow"),
    ("a.com/de/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    assert judged(spark, [(url, None)]) == [(host, path, rule, verdict, False)]


def test_blocks_reach_aliases_and_allow_goes_first(spark):
    rows = [
        ("http://a.net/1", page("http://x.com/de/2")),           # blocked by its target
        ("http://a.net/3", page("/1#top")),                      # by way of the first
        ("http://b.net/1", page("http://y.com/de/1")),           # blocked, but for the next link
        ("http://b.net/1", page("http://z.org/ok", "refresh")),  # an allowed alias
        ("http://q.com/fr/1", page("//x.com/de/2")),             # allowed itself, and so is its group
        ("http://c.net/1", page("other")),
        ("http://c.net/other", page(None)),
        ("http://d.net/1", page("http://w.com/de/9?a=1&amp;b=2")),
        ("https://d.net/1?", None), ("http://D.net/1", page(None)), (None, page("http://x.com/de/2")),
    ]
    got = [(v, i) for _, _, _, v, i in judged(spark, rows)]
    assert got[:2] == [("allow", False)] * 2  # the allowed alias q.com/fr/1 is of their group
    assert got[2:4] == [("allow", False)] * 2
    assert got[4:7] == [("allow", False)] * 3
    assert got[7] == ("block", True) and got[8] == ("allow", False) and got[9] == ("block", True)
    without = judged(spark, [r for r in rows if r[0] != "http://q.com/fr/1"])
    assert [(v, i) for _, _, _, v, i in without[:2]] == [("block", True)] * 2


def test_redirect_table_and_empty_pages(spark):
    moved = spark.createDataFrame([("a.net/1", "m.com/de/1"), (None, "x"), ("y", "y")], "a string, b string")
    assert [r[3] for r in judged(spark, [("http://a.net/1", None)], edges=moved)] == ["block"]
    assert judged(spark, []) == []


def test_longest_rule_wins_and_ties_allow(spark):
    rules = [aliases.Rule("block", "a.net/x"), aliases.Rule("allow", "net/xyz"), aliases.Rule("block", "net/")]
    df = spark.createDataFrame([(1, "http://a.net/xyz", ""), (2, "http://a.net/x", ""), (3, "http://b.net/", "")],
                               "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in aliases.judge(df, rules).collect()}
    assert got == {1: ("net/xyz", "allow"), 2: ("a.net/x", "block"), 3: ("net/", "block")}


def test_a_table_of_rules_judges_as_a_list(spark):
    draw = random.Random(3)
    hosts = ["", "a", "b.a", "c.b.a", "xa", "a.", ".a", "b..a", "com"]
    paths = ["", "/", "/p", "/pq", "/pq/r", "//", "/q?"]
    rules = [aliases.Rule(draw.choice(["allow", "block"]), h + p)
             for h in hosts for p in paths if draw.random() < 0.35]
    rules += [aliases.Rule("block", rules[0].where), aliases.Rule("allow", rules[0].where)]
    table = spark.createDataFrame(
        [(r.where, r.verdict, 1) for r in rules] + [(None, "block", 1), ("a/", "maybe", 1)],
        "where string, verdict string, host int")
    rows = [(f"http://{h}{p}{end}", page("http://c.b.a/pq") if draw.random() < 0.2 else None)
            for h in [*hosts, "z.com", "A.b.A"] for p in paths for end in ("", "x", "#y")]
    pages = spark.createDataFrame(
        [(i, u, h) for i, (u, h) in enumerate([*rows, (None, None), ("none", None)])],
        "page_id long, url string, html string").repartition(3)
    key = lambda r: r.page_id
    got = sorted(aliases.judge(pages, table).collect(), key=key)
    assert got == sorted(aliases.judge(pages, rules).collect(), key=key)
    assert len({r.rule for r in got}) > 8
    assert all(r.rule is None for r in aliases.judge(pages, table.limit(0)).collect())
    assert aliases.judge(pages.limit(0), table).collect() == []


def test_a_table_of_rules_is_joined_by_keys(spark):
    rules = spark.range(100_000).selectExpr("concat('h', id, '.com/p') AS where", "'block' AS verdict")
    rows = spark.range(1000).selectExpr("concat('www.h', id * 150, '.com') AS host", "'/path' AS path")
    found = aliases.fit_rules(rows, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert found.count() == 667
