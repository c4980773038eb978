import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askframe.llm import ledger

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "n_lines": len(lines), "n_shouts": text.count("!"),
    }


def texts():
    draw = random.Random(3)
    for _ in range(60):
        yield "".join(draw.choice(["a", "b", "c", "dd", " ", " ", "\n", "\t", "!", "#", "é", "\x0b"])
                      for _ in range(draw.randrange(200)))
    yield from ["", None, "a", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "\n \n", "w " * 5000]


def test_measurements_equal_a_plain_version(documents):
    rows = list(enumerate(texts()))
    want = {i: measured(t) for i, t in rows}
    for r in ledger.ledger(documents(rows)).collect():
        assert {k: r[k] for k in want[r.doc_id]} == want[r.doc_id]


def test_odd_rows_and_columns(odd):
    rows = ledger.verdicts(ledger.ledger(odd)).collect()
    assert len(rows) == odd.count()
    clashing = odd.withColumn("n_words", F.lit("mine")).withColumn("failures", F.lit(0)).withColumn(
        "measured", F.lit(1)).withColumn("row", F.lit(2))
    kept = ledger.kept_documents(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(r.kept for r in rows)
    with pytest.raises(ValueError, match="n_words"):
        ledger.ledger(clashing, keep=("doc_id", "n_words"))
    assert ledger.verdicts(ledger.ledger(odd.limit(0))).collect() == []


def test_policies_and_ablations(documents):
    prose = " ".join(f"w{i}" for i in range(80))
    rows = documents([
        (1, prose), (2, "short"), (3, "spam spam " * 60), (4, prose + " #" * 40),
        (5, " ".join(f"W{i}!!" for i in range(80))), (6, "#" * 30),
    ])
    stored = ledger.ledger(rows)
    assert {r.doc_id for r in ledger.verdicts(stored, "2").where("kept").collect()} == {1}
    assert {r.doc_id for r in ledger.verdicts(stored, "base").where("kept").collect()} == {1, 4, 5}
    by_rule = {r.rule: r for r in ledger.ablations(stored, "2").collect()}
    assert by_rule["few_words"].failed == 2 and by_rule["few_words"].only == 1
    assert by_rule["shouting"].only == 1 and by_rule["shouting"].rejected_without == 4
    assert by_rule["symbols"].also == 0b100101
    assert all(r.failed == 0 for r in ledger.ablations(stored.limit(0)).collect())
    plan = ledger.kept_documents(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("RoundRobin", "").split("AdaptiveSparkPlan")[-1].split("Generate")[0]
    assert "Python" not in plan and "Arrow" not in plan
