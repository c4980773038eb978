import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from askframe.llm import bpe, mixing
from test_ledger import measured
from test_simhash import fingerprint, linked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, documents, tmp_path_factory):
    draw = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ar", "ent", "ing", "ol", "u")]
    rows, labels = [], []
    for i in range(150):
        good = i % 4 != 1
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(70, 200)))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, "too short"), (2001, ""), (2002, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows)


def test_every_stage_against_a_plain_version(spark, corpus):
    folder, text = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [len(s) for s in pipe.STAGES] == [2] * 5

    good = pipe.quality_classifier(spark, docs, folder)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == COLUMNS
    assert all((i in kept) == (i % 4 != 1) for i in range(150)) and {1000 + i for i in range(40)} <= kept

    fine = pipe.quality_rules(spark, good, folder)
    assert fine.columns == COLUMNS
    want = {i for i in kept if (m := measured(text[i]))["n_words"] >= 50 and 2 * m["n_repeat_words"] <= m["n_words"]}
    assert {r.doc_id for r in fine.collect()} == want

    once = pipe.near_duplicates(spark, fine, folder)
    assert once.columns == COLUMNS
    of = linked([fingerprint(text[i]) for i in want])
    least = {}
    for i in sorted(want):
        least.setdefault(of[fingerprint(text[i])], i)
    assert sorted(r.doc_id for r in once.collect()) == sorted(least.values())

    mix = pipe.mix_sources(spark, once, folder)
    assert mix.columns == COLUMNS
    rows = mix.collect()
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    sizes, taken = Counter(), Counter()
    for found, counted in ((once.collect(), sizes), (rows, taken)):
        for r in found:
            counted[r.source] += len(r.text.split())
    for source, target in mixing.targets(dict(sizes), pipe.MIX).items():
        assert abs(taken[source] - target) <= 0.02 * target + 200
    assert sorted(map(tuple, pipe.mix_sources(spark, once.repartition(5), folder).collect())) == sorted(
        map(tuple, rows))

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = pipe.encode_tokens(spark, mix, folder).collect()
    assert [r.n_tokens for r in tokens] == [len(plain.encode_ordinary(text[r.doc_id])) for r in tokens]

    whole = pipe.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tokens))


def test_odd_documents(spark, odd, corpus):
    folder, _ = corpus
    extra = odd.withColumns({"score": F.lit(1), "row": F.lit(2), "times": F.lit(3), "component_id": F.lit(4)})
    for name, stage in pipe.STAGES[:-1]:
        assert stage(spark, extra, folder).columns == extra.columns, name
        assert stage(spark, extra, folder).count() <= 2 * extra.count(), name
        assert stage(spark, extra.limit(0), folder).collect() == [], name
    assert pipe.encode_tokens(spark, extra, folder).count() == extra.count()
