"""From logits to calibrated answers, in the float32 arithmetic the answers are defined by.

All functions are Column expressions over ARRAY<FLOAT>. FLOAT +, - and * stay FLOAT in
Spark; a quotient is computed as DOUBLE and cast back, which rounds to the same float.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.text import col, round4, round4_float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _float(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def scaled_softmax(logits: Column | str, temperature: Column) -> Column:
    """Probabilities ARRAY<FLOAT> of logits divided by a temperature of at least 0.001."""
    t = _float(F.greatest(F.lit(1e-3), temperature))

    def exponents(s: Column) -> Column:
        return F.transform(
            s["z"], lambda v: _float(F.exp((v - s["top"]).cast("double")))
        )

    def shares(s: Column) -> Column:
        return F.transform(s["e"], lambda v: _float(v / s["total"]))

    scaled = let(t, lambda tt: F.transform(col(logits), lambda v: _float(v / tt)))
    with_top = let(scaled, lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top")))
    with_sum = let(
        let(with_top, exponents),
        lambda e: F.struct(
            e.alias("e"), F.aggregate(e, _float(0.0), lambda a, v: a + v).alias("total")
        ),
    )
    return let(with_sum, shares)


def softmax(logits: Column | str) -> Column:
    return scaled_softmax(logits, F.lit(1.0))


def act_probability(act_logits: Column | str) -> Column:
    return round4_float(F.element_at(softmax(act_logits), 1))


def first_max(keys: Column, p: Column) -> Column:
    """Key of the first largest probability."""
    return F.element_at(keys, F.array_position(p, F.array_max(p)).cast("int"))


def expected_level(p: Column) -> Column:
    """Sum of level x probability in double, not rounded."""
    weighted = F.transform(p, lambda v, i: i.cast("double") * v.cast("double"))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def entropy_confidence(p: Column) -> Column:
    """1 - H(p) / ln k in float32, within [0, 1]; 1 for a single option. Not rounded."""
    k = F.size(p)
    entropy = F.aggregate(
        p,
        _float(0.0),
        lambda a, v: a
        - v * _float(F.ln(F.least(F.greatest(v, _float(1e-12)), _float(1.0)).cast("double"))),
    )
    raw = _float(1.0) - _float(entropy / _float(F.ln(k.cast("double"))))
    return F.when(k < 2, _float(1.0)).otherwise(F.least(F.greatest(raw, _float(0.0)), _float(1.0)))


def noul_confidence(p: Column) -> Column:
    yes = F.element_at(p, 2).cast("double")
    return round4_complement(F.greatest(yes, F.lit(1.0) - yes))


def round4_complement(x: Column) -> Column:
    """Round 1 - p for a float p: where 4 decimals can tell, the product is exact."""
    return F.rint(x * F.lit(10000.0)) / F.lit(10000.0)


def temperature_bucket(qtype: Column | str, k: Column | str) -> Column:
    n = col(k)
    size = (
        F.when(n <= 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")
    )
    return F.concat(col(qtype), F.lit(":"), size)


def temperature_for(
    qtype: Column | str, k: Column | str, by_type: Column | str, by_options: Column | str
) -> Column:
    """Temperature of a question: by type and number of options, else by type."""
    kind = F.array_position(F.array(*[F.lit(t) for t in fixed.QTYPES]), col(qtype)).cast("int")
    return F.coalesce(
        F.try_element_at(col(by_options), temperature_bucket(qtype, k)),
        F.try_element_at(col(by_type), kind),
    )


def uncertainty(logits: Column | str) -> Column:
    """struct(top1, margin, entropy, k_share): how sure an unscaled distribution is."""
    def features(s: Column) -> Column:
        top1 = F.element_at(s["sorted"], 1)
        top2 = F.coalesce(F.try_element_at(s["sorted"], F.lit(2)), _float(0.0))
        k = F.greatest(F.size(s["p"]), F.lit(2)).cast("double")
        total = F.aggregate(
            s["p"],
            _float(0.0),
            lambda a, v: a - v * _float(F.ln(F.greatest(v, _float(1e-9)).cast("double"))),
        )
        return F.struct(
            top1.alias("top1"),
            (top1 - top2).alias("margin"),
            _float(total / _float(F.ln(k))).alias("entropy"),
            _float(k / F.lit(255.0)).alias("k_share"),
        )

    def with_sorted(p: Column) -> Column:
        return F.struct(p.alias("p"), F.sort_array(p, asc=False).alias("sorted"))

    return let(let(softmax(logits), with_sorted), features)


ANSWER_TYPE = (
    "struct<qid:string,qtype:string,choice:string,score:double,noul:double,"
    "legend:array<string>,prob_keys:array<string>,probabilities:array<double>,"
    "confidence:double,act_probability:double>"
)


def answer(q: Column, p: Column, act: Column) -> Column:
    """Answer struct of a question struct, its probabilities and its act probability."""
    choice, score, noul = (q["qtype"] == t for t in fixed.QTYPES)
    level_keys = F.transform(p, lambda _, i: i.cast("string"))
    return F.struct(
        q["qid"].alias("qid"),
        q["qtype"].alias("qtype"),
        F.when(choice, first_max(q["keys"], p)).alias("choice"),
        F.when(score, let(expected_level(p), round4)).alias("score"),
        F.when(noul, round4_float(F.try_element_at(p, F.lit(2)))).alias("noul"),
        F.when(score, q["legend"]).alias("legend"),
        F.when(choice, q["keys"]).when(score, level_keys).alias("prob_keys"),
        F.when(~noul, F.transform(p, round4_float)).alias("probabilities"),
        F.when(noul, noul_confidence(p))
        .otherwise(round4_float(entropy_confidence(p)))
        .alias("confidence"),
        act.alias("act_probability"),
    )


def answers(
    questions: Column | str, logits: Column | str, act_logits: Column | str, temperatures: Column
) -> Column:
    """ARRAY of answers of one request, in question order, from arrays of the same length."""
    zipped = F.arrays_zip(
        col(questions).alias("q"),
        col(logits).alias("z"),
        col(act_logits).alias("a"),
        temperatures.alias("t"),
    )

    def one(row: Column) -> Column:
        scored = F.struct(
            scaled_softmax(row["z"], row["t"]).alias("p"), act_probability(row["a"]).alias("act")
        )
        return let(scored, lambda s: answer(row["q"], s["p"], s["act"]))

    return F.transform(zipped, one)
