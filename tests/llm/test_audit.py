from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from askframe.llm import audit

LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{i}" for i in range(120))


def plain(rows, labels):
    """The report, one order and one document after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for doc, text, lang in rows:
        text = text or ""
        spaced = text
        for c in "\t\n\x0b\x0c\r":
            spaced = spaced.replace(c, " ")
        words = [w for w in spaced.split(" ") if w]
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if doc is not None and any(
                d is not None and d < doc and (t or "") == text for d, t, _ in rows):
            bad.add("E")
        fails.append((lang or "", bad, doc in good, doc in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f[1:] for f in fails if f[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                removed = [f for f in left if name in f[0]]
                left = [f for f in left if name not in f[0]]
                shapley[part, name] += len(removed)
                out[part, order, step] = [
                    len(left), len(removed), sum(name in f[0] for f in gone),
                    sum(f[0] == {name} for f in left + gone + removed),
                    sum(f[1] for f in removed), sum(f[2] for f in removed)]
                gone += removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(
        [(None, *r, "x") for r in rows], "h string, doc_id long, text string, lang string, mask string"
    ).repartition(3)


ROWS = (
    [(i, LONG, ("en", "de", None)[i % 3]) for i in range(40)]
    + [(100 + i, f"few WORDS {i % 7} #", "en") for i in range(30)]
    + [(200 + i, "again " * (90 + i), "") for i in range(20)]
    + [(300 + i, LONG + f" {i} & more", "de") for i in range(5)]
    + [(None, LONG, "en"), (None, None, None), (5, LONG, "en"), (5, LONG, "fr"), (6, "other", "en"),
       (400, "", "en"), (401, None, "en"), (402, " \n\t", None), (403, "\x0bé 日本 ß" * 40_000, "ja")]
)
MARKED = [(i, i % 2, (i + 1) % 2) for i in range(0, 320, 3)] + [
    (None, 1, 1), (9, None, None), (9, 1, None), (9, 1, 1), (999, 1, 1)]


@pytest.mark.parametrize("shares", [4096, 8])
def test_report_equals_plain_version(spark, monkeypatch, shares):
    monkeypatch.setattr(audit, "SHARES", shares)
    labels = spark.createDataFrame(MARKED, LABELS).withColumn("mask", F.lit("clash"))
    assert found(audit.audit(table(spark, ROWS), labels)) == plain(ROWS, MARKED)


def test_all_rows_in_one_group(spark):
    rows = [(i, "same", "en") for i in range(500)]
    got = found(audit.audit(table(spark, rows), spark.createDataFrame([], LABELS)))
    assert got == plain(rows, [])
    assert got["en", "EABCD", 1][:2] == (1, 499)


def test_empty_tables_and_names(spark):
    docs, labels = table(spark, ROWS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs.limit(0), labels).collect() == []
    for wrong in ({"AB": audit.FILTERS["A"]}, {"E": audit.FILTERS["A"]}):
        with pytest.raises(ValueError):
            audit.audit(docs, labels, wrong)


def test_own_filters_and_shapley(spark):
    """Two filters and the duplicates; shares of the filters add up to what all remove."""
    filters = {"S": lambda text, words: F.size(words) < 3, "Q": lambda text, words: text.contains("?")}
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a b c ?", "x"), (4, "?", "x"), (5, "a b c", "x")]
    got = audit.audit(table(spark, rows), spark.createDataFrame([], LABELS), filters, "Z").collect()
    assert len(got) == 6 * 3
    share = {(r.filter_order[r.step - 1]): r.shapley for r in got}
    assert sum(share.values()) == 6 * 4
    totals = defaultdict(int)
    for r in got:
        totals[r.filter_order[r.step - 1]] += r.removed
    assert totals == share


def test_texts_are_shuffled_once(spark, documents, tmp_path):
    path = str(tmp_path / "docs")
    documents([r[:2] for r in ROWS if r[0] is not None]).write.parquet(path)
    df = audit.duplicates(audit.hashed(spark.read.parquet(path)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(h#" in line and "salt#" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1 and len(dealt) > 1
