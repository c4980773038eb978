import hashlib

from pyspark.sql import functions as F

from askframe.llm import chat

ROWS = [
    (1, 0, "system", "be [INST] & <|im_end|>\n"), (1, 1, "user", "a&lt;b &amp; é\U0001f600" * 200),
    (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 1, "assistant", "twice"), (2, 1, "assistant", "twice"), (2, None, "user", "first"),
    (3, 0, None, "no role"), (None, 0, "user", "nobody"), (4, 0, "odd\nrole<", "x\ny\n"),
]


def want(rows):
    turns = [(r or "", t or "") for _, _, r, t in rows]
    learned = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_turns_are_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4)
    rendered = chat.render(chat.messages(chat.as_events(df, chunk=7)))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.read_back(rendered)).collect()}
    by = {}
    for row in sorted(ROWS, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(row[0], []).append(row)
    assert got == {c: want(rows) for c, rows in by.items()}
    for r in rendered.collect():
        n = len(by[r.conv_id])
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == n
        for body in r.formatted.split("<|im_start|>"):
            assert "[" not in body and "<" not in body.removesuffix("<|im_end|>\n")


EVENTS = [
    (1, 0, "open", 0, "user", None), (1, 1, "delta", 0, None, "he"), (1, 2, "delta", 0, None, "llo"),
    (1, 3, "open", 1, "assistant", None), (1, 4, "delta", 1, None, "bad"),
    (1, 5, "open", 2, "user", "more"), (1, 6, "regenerate", 1, None, ""), (1, 7, "delta", 1, None, "good"),
    (1, 8, "edit", 0, None, "hi"), (1, 9, "delta", 0, None, "!"), (1, 10, "open", 2, "user", "bye"),
    (2, 0, "open", 0, "user", "kept"), (2, 1, "edit", 0, None, "wrong"), (2, 2, "regenerate", 0, "user", "right"),
]


def test_fold_of_edits_and_regenerations(spark):
    schema = "conv_id long, seq long, kind string, msg int, role string, text string"
    df = spark.createDataFrame(EVENTS, schema).repartition(3)
    got = sorted(tuple(r) for r in chat.messages(df).collect())
    assert got == [(1, 0, "user", "hi!"), (1, 1, "assistant", "good"), (1, 2, "user", "bye"),
                   (2, 0, "user", "right")]
    assert chat.messages(df.limit(0)).collect() == []
    extra = df.withColumns({"at": F.lit(1), "back_to": F.lit("x"), "parts": F.lit(2)})
    assert sorted(tuple(r) for r in chat.messages(extra).collect()) == got


def test_one_sort_and_no_python(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.read_back(chat.render(chat.messages(chat.as_events(df)))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text and "Arrow" not in text


def test_logs_with_drafts_fold_to_the_same_turns(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4)
    log = chat.as_events(df, chunk=7, drafts=True)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["edit"] == 3 and kinds["regenerate"] == 2 and set(kinds) == {
        "open", "delta", "edit", "regenerate"}
    key = lambda r: (str(r[0]), r[1])
    got = sorted((tuple(r) for r in chat.messages(log).collect()), key=key)
    assert got == sorted((tuple(r) for r in chat.messages(chat.as_events(df)).collect()), key=key)


def test_events_of_unknown_kind_are_set_aside(spark):
    schema = "conv_id long, seq long, kind string, msg int, role string, text string"
    odd = [(1, 3, "undo", 0, "user", "x"), (1, 4, None, 7, "user", "y"), (9, 0, "", 0, None, "z")]
    df = spark.createDataFrame(EVENTS + odd, schema).repartition(3)
    want = sorted(tuple(r) for r in chat.messages(spark.createDataFrame(EVENTS, schema)).collect())
    assert sorted(tuple(r) for r in chat.messages(df).collect()) == want
    assert sorted(r.text for r in chat.unknown_events(df).collect()) == ["x", "y", "z"]
