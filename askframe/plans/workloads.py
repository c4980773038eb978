"""Registered queries: every operator over whole tables.

Each function takes (spark, sf_dir) and returns a DataFrame. ``plans.oracles`` holds the
matching SQL under the same name.
"""

from __future__ import annotations

import json
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import calibrate, detect, fixed, pyjson
from askframe.functions.email import (
    clean_email,
    email_context,
    email_text,
    is_quote_header,
    is_quoted,
    normalise_newlines,
)
from askframe.functions.text import percent_text, quote_repr, round4, round4_float, trim_space
from askframe.operators import reports, sequence, specs
from askframe.operators.isolate import map_isolated
from askframe.operators.route import (
    RouterOptions,
    default_repo,
    resolve_name,
    route,
    route_mix,
    route_mix_rollup,
)
from askframe.operators.score import score, token_ids
from askframe.plans import doubles, inputs
from askframe.plans.predict import admit, decisions, intern_specs, predict, route_requests
from askframe.sources import catalog, golden, raw_json, requests, sinks
from askframe.sources.session import ship_package, shared_dir
from askframe.sources.tables import lookup_join, read_table, small_table, stream_table
from askframe.streaming.admit import admit_stream, read_batches, read_specs
from askframe.streaming.requests import read_stream_results, spread, write_stream

QUERIES = {}


def query(fn):
    """Register a query; its Python workers find this package wherever the driver runs."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return fn


def joined(array: Column, sep: str = " ") -> Column:
    """Text of an array, so that results compare as plain values."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- detection and routing --------------------------------------------------------------------


def _flat_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.documents(spark, sf, "text", "lang", "source", "n_chars")
    context = F.struct("source", F.col("text").alias("body"), F.struct("n_chars").alias("meta"))
    df = df.withColumn("context", context)
    text = pyjson.context_text("context", df.schema["context"].dataType)
    return df.withColumn("flat", text)


def _routed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return route(_flat_documents(spark, sf), "flat")


@query
def route_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _routed_documents(spark, sf).select(
        "doc_id",
        "route.model",
        "route.reason",
        "route.detection.script",
        "route.detection.language",
        "route.detection.is_english",
        "route.detection.non_latin_fraction",
    )


def _mix_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "source", "lang", "route.model", "route.detection.script", "route.detection.language"
    )


@query
def route_mix_documents(spark: SparkSession, sf: str) -> DataFrame:
    mix = route_mix(
        _mix_columns(_routed_documents(spark, sf)), "lang", "model", "script", "language"
    )
    return mix.select("lang", "model", "script", "language", "n", round4(F.col("share")).alias("share"))


@query
def route_mix_subtotals(spark: SparkSession, sf: str) -> DataFrame:
    mix = route_mix_rollup(_mix_columns(_routed_documents(spark, sf)), "source", "lang", "model")
    return mix.select("source", "lang", "model", "n", long("level").alias("level"))


@query
def route_mixed_scripts(spark: SparkSession, sf: str) -> DataFrame:
    df = route(inputs.mixed_scripts(spark, sf), "t", options=RouterOptions(default="ml"))
    return df.select(
        "doc_id",
        "route.model",
        "route.reason",
        "route.detection.script",
        "route.detection.language",
        "route.detection.is_english",
        "route.detection.non_latin_fraction",
    )


@query
def route_with_hints(spark: SparkSession, sf: str) -> DataFrame:
    df = route(
        inputs.hinted(spark, sf), "text", "model_hint", "task_hint", "lang_hint",
        options=RouterOptions(repo_base="owner/family"),
    )
    return df.select(
        "doc_id",
        "route.model",
        "route.repo",
        "route.reason",
        F.col("route.detection").isNull().alias("undetected"),
        "route.error",
    )


@query
def script_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = detect.with_script_counts(inputs.mixed_scripts(spark, sf), "t")
    return df.select("doc_id", F.explode("script_counts").alias("s")).select(
        "doc_id", "s.script", long("s.n").alias("n")
    )


@query
def script_profile_long(spark: SparkSession, sf: str) -> DataFrame:
    df = detect.detect(inputs.mixed_scripts(spark, sf), "t")
    return df.select("doc_id", F.explode("detection.script_profile").alias("script", "p")).select(
        "doc_id", "script", round4(F.col("p")).alias("share")
    )


@query
def dominant_script_mixed(spark: SparkSession, sf: str) -> DataFrame:
    df = detect.with_script_counts(inputs.mixed_scripts(spark, sf), "t")
    return df.select("doc_id", detect.dominant_script(F.col("script_counts")).alias("script"))


@query
def script_block_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts by a join: code points against the blocks of 16 that scripts consist of."""
    df = inputs.mixed_scripts(spark, sf).select(
        "doc_id", detect.detection_window(F.col("t")).alias("t")
    )
    letters = df.select("doc_id", F.explode(F.split(detect.letters(F.col("t")), "")).alias("ch"))
    counted = (
        letters.filter(F.col("ch") != "")
        .groupBy("doc_id", F.floor(F.ascii("ch") / 16).alias("block"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranges = [(n, lo, hi) for n, rs in fixed.SCRIPT_RANGES for lo, hi in rs]
    ranges += [("latin", lo, hi) for lo, hi in fixed.LATIN_RANGES]
    blocks = small_table(spark, ranges, "script string, lo int, hi int").select(
        "script",
        F.explode(F.sequence(F.floor(F.col("lo") / 16), F.floor(F.col("hi") / 16))).alias("block"),
    )
    # The ranges are fixed, so the blocks (about 3,000) are too.
    return (
        counted.join(F.broadcast(blocks), "block")
        .groupBy("doc_id", "script")
        .agg(F.sum("n").alias("n"))
    )


@query
def stopword_join(spark: SparkSession, sf: str) -> DataFrame:
    """Stopword hits per language by a join on the word."""
    df = inputs.documents(spark, sf, "text")
    low = detect.lower_simple(detect.detection_window(F.col("text")))
    words = df.select("doc_id", F.explode(detect.words(low)).alias("word"))
    counted = words.filter(F.col("word").isin(detect.ALL_WORDS)).groupBy("doc_id", "word").count()
    rows = [(lang, w) for lang, ws in detect.WORD_SETS.items() for w in ws]
    table = small_table(spark, rows, "language string, word string")
    return (
        counted.join(F.broadcast(table), "word")  # the word lists are fixed
        .groupBy("doc_id", "language")
        .agg(F.sum("count").alias("hits"))
    )


@query
def latin_language_guess(spark: SparkSession, sf: str) -> DataFrame:
    df = detect.with_latin_language(inputs.documents(spark, sf, "text", "lang"), "text", "guess")
    return df.select("doc_id", "lang", "guess")


@query
def language_agreement(spark: SparkSession, sf: str) -> DataFrame:
    df = detect.with_latin_language(inputs.documents(spark, sf, "text", "lang"), "text", "guess")
    return df.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


@query
def diacritic_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.documents(spark, sf, "text")
    low = detect.lower_simple(detect.detection_window(F.col("text")))
    return df.withColumn("low", low).select(
        "doc_id", long(detect.diacritic_count(F.col("low"))).alias("n")
    )


@query
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    names = list(fixed.ALIASES) + fixed.MODEL_NAMES + ["family", "family-multilingual", "nope", ""]
    name = inputs.pick("c_custkey", *[F.lit(n) for n in names])
    decorated = inputs.pick(
        F.floor(F.col("c_custkey") / 7),
        name,
        F.concat(F.lit("  "), F.upper(name), F.lit("\t ")),
        F.concat(name, F.lit("\n")),
        F.concat(name, F.lit("-"), F.col("c_mktsegment")),
    )
    options = RouterOptions(repo_base="owner/Family")
    model = resolve_name(F.col("name"), options)
    return df.withColumn("name", decorated).select(
        "c_custkey", "name", model.alias("model"), default_repo(model, options).alias("repo")
    )


@query
def alias_join(spark: SparkSession, sf: str) -> DataFrame:
    """Alias resolution as a join, with unresolved names kept."""
    df = alias_resolution(spark, sf).select("c_custkey", "name")
    known = [*RouterOptions(repo_base="owner/family").aliases().items()]
    known += [(n, n) for n in fixed.MODEL_NAMES]
    table = small_table(spark, known, "key string, model string")
    keyed = df.withColumn("key", F.lower(trim_space(F.col("name"))))
    found = lookup_join(keyed, table, "key", bounded=True)
    return found.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def _order_specs(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    sets = [fixed.WORKFLOWS[n] for n in sorted(fixed.WORKFLOWS)]
    listed = [F.array(*[F.lit(x) for x in s]) for s in sets]
    qids = inputs.pick(
        "o_orderkey",
        *listed,
        F.reverse(listed[1]),
        F.concat(listed[0], F.array(F.lit("urgency"))),
        F.slice(listed[2], 1, 4),
        F.concat(listed[3], F.array("o_orderpriority")),
        F.array("o_orderstatus"),
    )
    return df.withColumn("qids", qids)


@query
def workflow_match(spark: SparkSession, sf: str) -> DataFrame:
    df = _order_specs(spark, sf)
    return df.select("o_orderkey", specs.workflow_of(F.col("qids")).alias("workflow"))


@query
def workflow_route(spark: SparkSession, sf: str) -> DataFrame:
    df = _order_specs(spark, sf).withColumn("workflow", specs.workflow_of(F.col("qids")))
    df = route(
        df, "o_orderpriority", workflow="workflow", options=RouterOptions(auto_task=True)
    )
    return df.groupBy("workflow", "route.model", "route.reason").agg(F.count(F.lit(1)).alias("n"))


@query
def reason_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Half-even percentages and quoted names of routing reasons."""
    df = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    name = inputs.pick(
        "l_orderkey",
        F.col("l_returnflag"),
        F.concat(F.lit("it's "), F.col("l_returnflag")),
        F.concat(F.lit('say "'), F.col("l_returnflag"), F.lit("\" isn't")),
    )
    share = (F.col("l_linenumber") * 0.125 + F.col("l_discount") * 0.5) / 2
    return df.select(
        name.alias("name"), round4(share).alias("share")
    ).groupBy("name", "share").agg(F.count(F.lit(1)).alias("n")).select(
        quote_repr(F.col("name")).alias("quoted"),
        "share",
        percent_text(F.col("share")).alias("percent"),
        "n",
    )


@query
def round4_fractions(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x = 1 - F.col("l_suppkey").cast("double") / (F.col("l_partkey") + 3200).cast("double")
    tie = (F.col("l_partkey") % 4000 * 2 + 1) / F.lit(32.0)
    df = df.withColumn("x", x).withColumn("tie", tie)
    return df.groupBy(round4(F.col("x")).alias("share"), round4(F.col("tie")).alias("tie")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- email ------------------------------------------------------------------------------------


@query
def email_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return clean_email(inputs.documents(spark, sf, "text"), "text").select("doc_id", "clean_body")


@query
def email_clean_threads(spark: SparkSession, sf: str) -> DataFrame:
    return clean_email(inputs.email_threads(spark, sf), "body").select("doc_id", "clean_body")


@query
def email_clean_short(spark: SparkSession, sf: str) -> DataFrame:
    df = clean_email(inputs.email_threads(spark, sf), "body", max_chars=120)
    return df.select("doc_id", "clean_body")


@query
def email_clean_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return clean_email(inputs.conversations(spark, sf), "text").select(
        "conv_id", "turn", "clean_body"
    )


@query
def email_kept_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines ahead of the first quote header, counted with a window over line numbers.

    A window is as large as one message, which is one row of the table.
    """
    df = inputs.email_threads(spark, sf).select(
        "doc_id",
        F.posexplode(F.split(normalise_newlines(F.col("body")), "\n", -1)).alias("pos", "line"),
    )
    df = df.withColumn("quoted", is_quoted(F.col("line"))).withColumn(
        "header", is_quote_header(F.col("line"))
    )
    by_line = Window.partitionBy("doc_id").orderBy("pos")
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    kept_before = F.coalesce(F.sum(F.when(~F.col("quoted"), 1).otherwise(0)).over(before), F.lit(0))
    df = df.withColumn("stop", F.col("header") & (kept_before > 0))
    df = df.withColumn("stopped", F.max("stop").over(so_far))
    return df.groupBy("doc_id").agg(
        F.count_if(~F.col("stopped") & ~F.col("quoted")).alias("kept"),
        F.count_if(F.col("quoted")).alias("quoted"),
        F.count_if(F.col("header")).alias("headers"),
    )


@query
def email_state_json(spark: SparkSession, sf: str) -> DataFrame:
    df = clean_email(inputs.email_threads(spark, sf), "body", "cleaned", max_chars=200)
    sender = inputs.pick("doc_id", F.col("source"), F.lit(""), F.lit(None).cast("string"))
    subject = F.concat(F.lit("\t "), F.col("source"), F.lit(' "re"\\ '))
    extra = {"lang": inputs.pick("doc_id", F.col("lang"), F.lit(None).cast("string"))}
    fields = email_context(subject, "cleaned", sender, extra)
    return df.select("doc_id", pyjson.object_text(fields).alias("state"))


# --- specs ------------------------------------------------------------------------------------


@query
def preset_catalog(spark: SparkSession, sf: str) -> DataFrame:
    used = inputs.preset_contexts(spark, sf).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    listing = specs.preset_listing(spark).withColumnRenamed("name", "spec_id")
    sizes = specs.presets(spark).select("spec_id", long(F.size("questions")).alias("n_questions"))
    df = lookup_join(used, listing, "spec_id", bounded=True)
    return lookup_join(df, sizes, "spec_id", bounded=True).orderBy("spec_id")


@query
def preset_options(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts per option text. Contexts are counted per spec before they meet the options."""
    used = inputs.preset_contexts(spark, sf).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    rows = specs.question_rows(lookup_join(used, specs.presets(spark), "spec_id", bounded=True))
    q = {c: F.col(c) for c in ("qtype", "keys", "descs", "levels", "noul_false", "noul_true")}
    return rows.select(
        "spec_id",
        "qid",
        "n",
        long(specs.option_count(q)).alias("k"),
        F.posexplode(specs.option_texts(q)).alias("pos", "option"),
    ).select("spec_id", "qid", "n", "k", long("pos").alias("pos"), "option")


@query
def preset_spec_json(spark: SparkSession, sf: str) -> DataFrame:
    """The spec of every preset in use as JSON, with the number of its contexts."""
    used = inputs.preset_contexts(spark, sf).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    df = lookup_join(used, specs.presets(spark), "spec_id", bounded=True)
    return df.select("spec_id", "n", specs.spec_json("questions").alias("spec"))


@query
def question_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Every question over every context: heads, with the mask token kept out."""
    df = inputs.preset_contexts(spark, sf)
    state = F.concat(F.lit("[MASK]"), "text", F.lit(" [MASK]!"))
    df = lookup_join(df, specs.presets(spark), "spec_id", bounded=True)
    rows = specs.question_rows(df.withColumn("state", state))
    asked = F.concat(F.col("instructions"), F.lit(" [MASK] "), F.col("role"))
    return rows.withColumn("instructions", asked).select(
        "conv_id",
        "turn",
        long("q_pos").alias("q_pos"),
        "qid",
        long(specs.type_code("qtype")).alias("qcode"),
        specs.head_text({c: F.col(c) for c in ("qtype", "instructions")}).alias("head"),
        F.md5(specs.strip_mask(F.col("state"))).alias("state_md5"),
    )


@query
def custom_categories(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.documents(spark, sf, "source", "lang")
    pair = "array<struct<key:string,val:string>>"
    none = F.lit(None).cast("string")
    cats = inputs.pick(
        "doc_id",
        F.lit(None).cast(pair),
        F.array().cast(pair),
        F.array(
            F.struct(F.col("source").alias("key"), F.col("lang").alias("val")),
            F.struct(F.lit("other").alias("key"), none.alias("val")),
        ),
    )
    preset = inputs.pick("doc_id", F.lit("email"), F.lit("email"), F.lit("email"), F.lit("triage"))
    df = df.withColumn("cats", cats).withColumn("spec_id", preset)
    df = lookup_join(df, specs.presets(spark), "spec_id", bounded=True)
    df = specs.with_categories(df, "spec_id", "cats")
    return df.select("doc_id", "spec_id", F.posexplode("questions").alias("q_pos", "q")).select(
        "doc_id",
        "spec_id",
        long("q_pos").alias("q_pos"),
        "q.qid",
        F.array_join(specs.option_texts(F.col("q")), "|").alias("options"),
        long(specs.option_count(F.col("q"))).alias("k"),
    )


@query
def interned_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that carry their own questions, reduced to the distinct specs."""
    df = inputs.documents(spark, sf, "source", "lang")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    q = F.struct(
        F.lit("team").alias("qid"), F.lit("choice").alias("qtype"),
        F.lit("Which team?").alias("instructions"),
        F.array(F.lit("a"), F.col("source")).alias("keys"),
        F.array(none, F.col("lang")).alias("descs"),
        empty.alias("levels"), empty.alias("legend"),
        none.alias("noul_false"), none.alias("noul_true"),
    )
    _, distinct = intern_specs(df.withColumn("questions", F.array(q)))
    first = F.element_at("questions", 1)
    return distinct.select(
        F.array_join(specs.option_texts(first), "|").alias("options"), "n"
    )


# --- JSON -------------------------------------------------------------------------------------


@query
def json_conversations(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.conversations(spark, sf)
    awkward = F.concat(F.lit('say "hi"\\\t\u0001 '), "text", F.lit(" 😀\u007f"))
    none = F.lit(None).cast("string")
    context = F.struct(
        "role",
        awkward.alias("text"),
        F.struct(F.col("turn").alias("n"), none.alias("gone")).alias("at"),
        F.array(F.col("turn") > 2, F.lit(None).cast("boolean")).alias("flags"),
        F.create_map(F.lit("z"), F.col("role"), F.lit("a"), F.lit("x")).alias("tags"),
    )
    df = df.select("conv_id", "turn", context.alias("context"))
    text = pyjson.state_text("context", df.schema["context"].dataType)
    return df.withColumn("state", text).select(
        "conv_id", "turn", "state", pyjson.ascii_escape(F.col("state")).alias("ascii")
    )


@query
def json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    bal = F.col("c_acctbal")
    context = F.struct(
        F.col("c_custkey").alias("key"),
        bal.alias("balance"),
        F.array(bal / 3, bal * 1e20, bal / 1e9, F.lit(None).cast("double")).alias("scaled"),
        F.struct((bal * 0).alias("zero"), (-bal).alias("minus")).alias("more"),
    )
    df = df.select("c_custkey", context.alias("context"))
    return df.select(
        "c_custkey", pyjson.json_text("context", df.schema["context"].dataType).alias("state")
    )


def _nested_context(df: DataFrame) -> DataFrame:
    deep = F.struct(F.struct(F.struct(F.struct(F.col("role").alias("f")).alias("e")).alias("d"),
                             F.lit("five").alias("x")).alias("c"))
    context = F.struct(
        F.lit(1).alias("n"),
        F.split("text", "\n").alias("lines"),
        F.create_map(F.lit("b"), F.col("role"), F.lit("a"), F.col("turn").cast("string")).alias("m"),
        F.array(F.struct(F.lit(None).cast("string").alias("none"), F.col("role").alias("r"))).alias(
            "list"
        ),
        F.struct(F.struct(deep.alias("b"), F.struct(deep.alias("y")).alias("z")).alias("a")).alias(
            "deep"
        ),
    )
    return df.withColumn("context", context)


@query
def typed_request_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as typed requests, routed on their context."""
    df = inputs.conversations(spark, sf)
    context = F.struct("role", F.array("text", F.lit("ok")).alias("parts"), "turn")
    df = requests.typed_requests(df.withColumn("context", context))
    df = route(df, "context_text")
    return df.select("conv_id", "turn", "state_text", "route.model", "route.detection.language")


@query
def context_text_flatten(spark: SparkSession, sf: str) -> DataFrame:
    df = _nested_context(inputs.conversations(spark, sf))
    text = pyjson.context_text("context", df.schema["context"].dataType)
    return df.select("conv_id", "turn", text.alias("flat"))


@query
def map_context_sorted(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size")
    context = F.create_map(
        F.col("p_type"), F.col("p_brand"), F.lit("B"), F.col("p_type"), F.lit("a"),
        F.col("p_size").cast("string"),
    )
    df = df.withColumn("context", context)
    return df.select(
        "p_partkey", pyjson.json_text("context", df.schema["context"].dataType).alias("state")
    )


def _raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, doc: JSON texts with repeated keys, literal numbers and some broken ones."""
    df = inputs.events(spark, sf, "event_type", "value", "user_id", "props")
    kind = F.col("event_type")
    v = F.col("value").cast("decimal(18,2)").cast("string")
    user = F.col("user_id").cast("string")
    doc = inputs.pick(
        "event_id",
        F.col("props"),
        F.concat(F.lit('{"b": "'), kind, F.lit('", "a": [1, '), v, F.lit(', null, true, "'), user,
                 F.lit('"], "b": {"x": "é\\u00e9", "x": "'), kind, F.lit('"}, "p": '), "props",
                 F.lit("}")),
        F.concat(F.lit('"'), kind, F.lit('"')),
        F.concat(F.lit('[[[[[[["seven", "'), kind, F.lit('"], "six"]]], "'), user, F.lit('"]], '),
                 user, F.lit("]")),
        F.concat("props", F.lit(" x")),
        F.concat(F.lit('{"n": '), v, F.lit("e3, "), F.lit('"m": -0, "k": "'), kind, F.lit('"}')),
        F.concat(F.lit('{"n": '), user),
    )
    return df.select("event_id", doc.alias("doc"))


@query
def raw_json_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = raw_json.parse_json(_raw_events(spark, sf), "doc")
    root = F.try_element_at("nodes", F.lit(1))
    return df.select(
        "event_id",
        F.col("invalid").isNotNull().alias("broken"),
        "kind",
        "canonical",
        raw_json.flatten_text(F.col("nodes"), root).alias("flat"),
        raw_json.child(raw_json.children(F.col("nodes"), root), "b")["kind"].alias("kind_of_b"),
    )


@query
def raw_json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of the JSON documents, counted by kind, key and depth."""
    leaves = raw_json.leaf_rows(raw_json.parse_json(_raw_events(spark, sf), "doc"))
    return leaves.groupBy("kind", "key", long("depth").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts")
    )


# --- sequences --------------------------------------------------------------------------------


def _turn_options(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as questions: the lines of a turn are its options, the first line the head."""
    df = inputs.conversations(spark, sf)
    return df.select(
        "conv_id",
        "turn",
        F.lit("q").alias("qid"),
        inputs.word_ids(F.element_at(F.split("text", "\n"), 1)).alias("head_ids"),
        F.transform(F.split("text", "\n"), inputs.word_ids).alias("options"),
        inputs.word_ids(F.col("text")).alias("state_ids"),
        (F.pmod("conv_id", F.lit(9)).cast("int") * 16 + 24).alias("head_max_len"),
        F.lit(3).alias("mask_id"),
    )


@query
def option_budget(spark: SparkSession, sf: str) -> DataFrame:
    df = sequence.with_budget(_turn_options(spark, sf), "options", "mask_id", "head_max_len")
    return df.select(
        "conv_id",
        "turn",
        long(sequence.total_size(F.col("option_ids"))).alias("option_tokens"),
        long(F.array_max(F.transform("option_ids", F.size))).alias("longest"),
        long("head_budget").alias("head_budget"),
    )


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    df = _turn_options(spark, sf).withColumn("sep_id", F.lit(2)).withColumn("cls_id", F.lit(1))
    df = sequence.question_prefix(
        df, "head_ids", "options", "cls_id", "sep_id", "mask_id", "head_max_len"
    )
    max_len = (F.col("head_max_len") + 16 + F.pmod("turn", F.lit(4)).cast("int") * 40).alias("m")
    return sequence.assemble(df.withColumn("max_len", max_len), "state_ids", "sep_id", "max_len")


@query
def sequence_assemble(spark: SparkSession, sf: str) -> DataFrame:
    return _assembled(spark, sf).select(
        "conv_id",
        "turn",
        joined(F.col("ids")).alias("ids"),
        joined(F.col("markers")).alias("markers"),
        F.col("error").isNotNull().alias("failed"),
    )


def _preset_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of every turn for all questions of its preset; prefixes are made per question."""
    q = {c: F.col(c) for c in ("qtype", "instructions", "keys", "descs", "levels", "noul_false",
                               "noul_true")}
    rows = specs.question_rows(specs.presets(spark))
    rows = (
        rows.withColumn("head", inputs.word_ids(specs.head_text(q)))
        .withColumn("options", F.transform(specs.option_texts(q), inputs.word_ids))
        .withColumn("qcode", specs.type_code("qtype"))
    )
    for name, value in {"cls_id": 1, "sep_id": 2, "mask_id": 3, "head_max_len": 60}.items():
        rows = rows.withColumn(name, F.lit(value))
    rows = sequence.question_prefix(
        rows, "head", "options", "cls_id", "sep_id", "mask_id", "head_max_len"
    )
    prefixes = rows.groupBy("spec_id").agg(
        F.sort_array(F.collect_list(F.struct("q_pos", "qid", "qcode", "prefix", "markers"))).alias(
            "prefixes"
        )
    )
    df = inputs.preset_contexts(spark, sf).withColumn("state", inputs.word_ids(F.col("text")))
    df = lookup_join(df, prefixes, "spec_id", bounded=True).withColumn(
        "max_len", (F.pmod("turn", F.lit(3)).cast("int") * 60 + 80)
    )
    seqs = sequence.sequences("prefixes", "state", F.lit(2), F.col("max_len"))
    # The state is read once per question inside the array, so it is made before.
    return df.withColumn("n_state", F.size("state")).withColumn("sequences", seqs)


@query
def collate_padded(spark: SparkSession, sf: str) -> DataFrame:
    df = sequence.collate(_preset_sequences(spark, sf), "sequences", F.lit(0))
    rows = df.select("conv_id", "turn", "n_rows", "max_ids", "max_options", F.explode("batch").alias("b"))
    return rows.select(
        "conv_id",
        "turn",
        long("n_rows").alias("n_rows"),
        long("max_ids").alias("max_ids"),
        long("max_options").alias("max_options"),
        "b.qid",
        long("b.qcode").alias("qcode"),
        joined(F.col("b.input_ids")).alias("input_ids"),
        joined(F.col("b.attention_mask"), "").alias("attention_mask"),
        joined(F.col("b.marker_pos")).alias("marker_pos"),
        joined(F.col("b.marker_mask"), "").alias("marker_mask"),
    )


@query
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    df = _preset_sequences(spark, sf)
    return df.select(
        "conv_id",
        "turn",
        long(sequence.input_tokens("sequences")).alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"),
    )


@query
def batch_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, longest sequence and most options per preset over all requests."""
    df = _preset_sequences(spark, sf).select("spec_id", F.explode("sequences").alias("s"))
    return df.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(long(F.size("s.ids"))).alias("max_ids"),
        F.max(long(F.size("s.markers"))).alias("max_options"),
    )


@query
def truncation_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Context lost behind a fixed prefix of 60 ids at a window of 512, per language."""
    df = inputs.documents(spark, sf, "text", "lang")
    state = inputs.word_ids(F.col("text"))
    prefix = F.array_repeat(F.lit(1), 60)
    dropped = sequence.dropped_tokens(state, prefix, F.lit(512))
    report = sequence.truncation_report(df.withColumn("dropped", long(dropped)), "lang")
    return report.withColumn("share_cut", round4(F.col("share_cut")))


@query
def maxlen_check(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.documents(spark, sf, "n_chars").select(
        "doc_id",
        (inputs.pick("doc_id", F.col("n_chars"), F.lit(0), -F.col("n_chars"),
                     F.lit(None).cast("bigint"), F.col("n_chars") * 100)).cast("int").alias("asked"),
        inputs.pick("doc_id", F.lit(0), F.lit(2048)).alias("override"),
        inputs.pick("doc_id", F.lit(512), F.lit(1024), F.lit(1024)).alias("configured"),
        inputs.pick("doc_id", F.lit(192), F.lit(256)).alias("head_max_len"),
    )
    return df.select(
        "doc_id",
        long("asked").alias("asked"),
        catalog.max_len_error("asked", "head_max_len").alias("error"),
        long(catalog.effective_max_len("asked", "override", "configured")).alias("window"),
    )


# --- calibration ------------------------------------------------------------------------------


def _probabilities(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.checkpoint_settings(inputs.logits(spark, sf))
    t = calibrate.temperature_for("qtype", "k", "temperature", "temperature_by_options")
    df = df.withColumn("t", t)
    return df.withColumn("p", calibrate.scaled_softmax("logits", F.col("t")))


@query
def temperature_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _probabilities(spark, sf).select(
        "vec_id",
        "qtype",
        long("k").alias("k"),
        calibrate.temperature_bucket("qtype", "k").alias("bucket"),
        F.col("t").alias("temperature"),
    )


@query
def softmax_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    df = _probabilities(spark, sf).select("vec_id", F.posexplode("p").alias("pos", "p"))
    return df.select("vec_id", long("pos").alias("pos"), round4_float(F.col("p")).alias("p"))


@query
def choice_argmax(spark: SparkSession, sf: str) -> DataFrame:
    df = _probabilities(spark, sf).filter(F.col("qtype") == "choice")
    return df.select(
        "vec_id", calibrate.first_max(inputs.label_keys("k"), F.col("p")).alias("choice")
    )


@query
def expected_score(spark: SparkSession, sf: str) -> DataFrame:
    df = _probabilities(spark, sf).filter(F.col("qtype") == "score")
    df = df.withColumn("raw", calibrate.expected_level(F.col("p")))
    return df.select("vec_id", round4(F.col("raw")).alias("score"))


@query
def noul_answer(spark: SparkSession, sf: str) -> DataFrame:
    df = _probabilities(spark, sf).filter(F.col("qtype") == "noul")
    return df.select(
        "vec_id",
        round4_float(F.element_at("p", 2)).alias("noul"),
        calibrate.noul_confidence(F.col("p")).alias("confidence"),
    )


@query
def entropy_confidence(spark: SparkSession, sf: str) -> DataFrame:
    df = _probabilities(spark, sf)
    return df.select(
        "vec_id", round4_float(calibrate.entropy_confidence(F.col("p"))).alias("confidence")
    )


@query
def uncertainty_features(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.logits(spark, sf).withColumn("u", calibrate.uncertainty("logits"))
    return df.select(
        "vec_id", *[round4_float(F.col(f"u.{f}")).alias(f)
                    for f in ("top1", "margin", "entropy", "k_share")]
    )


@query
def act_probability(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.logits(spark, sf)
    return df.select("vec_id", calibrate.act_probability("act_logits").alias("act_probability"))


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """request_id, label, q_pos and answer fields: four embeddings make a request."""
    df = _probabilities(spark, sf).withColumn("act", calibrate.act_probability("act_logits"))
    levels = F.transform(
        inputs.label_keys("k"), lambda k: F.concat(F.lit('"level '), k, F.lit('"'))
    )
    q = F.struct(
        F.concat(F.lit("q"), F.pmod("vec_id", F.lit(4)).cast("string")).alias("qid"),
        "qtype",
        inputs.label_keys("k").alias("keys"),
        levels.alias("legend"),
    )
    df = df.withColumn("a", calibrate.answer(q, F.col("p"), F.col("act")))
    return df.select(
        F.floor(F.col("vec_id") / 4).alias("request_id"),
        "label",
        F.pmod("vec_id", F.lit(4)).cast("int").alias("q_pos"),
        "a.*",
    )


@query
def decision_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf).select(
        "request_id",
        long("q_pos").alias("q_pos"),
        "qid",
        "qtype",
        "choice",
        "score",
        "noul",
        F.array_join("legend", "|").alias("legend"),
        F.array_join("prob_keys", "|").alias("prob_keys"),
        "confidence",
        "act_probability",
    )


@query
def regroup_answers(spark: SparkSession, sf: str) -> DataFrame:
    df = sinks.regroup(_answered(spark, sf).drop("label"))
    return df.select(
        "request_id",
        long(F.size("answers")).alias("n"),
        F.array_join(F.col("answers")["qid"], "|").alias("qids"),
        joined(F.col("answers")["choice"], "|").alias("choices"),
    )


@query
def answer_json_text(spark: SparkSession, sf: str) -> DataFrame:
    df = sinks.regroup(_answered(spark, sf).drop("label"))
    return df.select("request_id", sinks.answers_json("answers").alias("answers"))


@query
def decision_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = reports.decision_summary(_answered(spark, sf), "label")
    return summary.select(
        long("label").alias("label"), "qid", "choice", "n",
        *[F.round(c, 6).alias(c) for c in ("mean_score", "mean_noul", "mean_confidence")],
    )


@query
def labelled_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Routing against the label table: documents per model, language and toxicity label."""
    # Only documents with a label are detected.
    marks = read_table(spark, sf, "labels", "doc_id", "toxic")
    routed = route(_flat_documents(spark, sf).join(marks, "doc_id"), "flat").select(
        "route.model", "route.detection.language", "toxic")
    return routed.groupBy("model", "language", long("toxic").alias("toxic")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def logit_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A graph variant with slightly moved logits against the original."""
    left = inputs.logits(spark, sf)
    moved = lambda z: F.transform(z, lambda x: (x + F.lit(0.003).cast("float")).cast("float"))
    right = left.withColumn("logits", moved("logits"))
    drift = reports.logit_drift(left, right, ["vec_id"])
    return drift.select(
        "n",
        F.round("max_logit_diff", 6).alias("max_logit_diff"),
        F.round("max_act_diff", 6).alias("max_act_diff"),
        "within_gate",
    )


@query
def answer_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs field by field; the second lost some answers and moved some confidences."""
    got = _answered(spark, sf).drop("label", "q_pos")
    want = got.filter(F.col("noul").isNull() | (F.col("noul") > 0.2)).withColumn(
        "confidence", F.col("confidence") + F.when(F.col("score") > 2, 0.01).otherwise(0.001)
    )
    lost = got.filter(F.col("choice").isNull() | (F.col("choice") != "o1"))
    verdicts = reports.answer_parity(lost, want, ["request_id", "qid"])
    return verdicts.groupBy("field", "verdict").agg(F.count(F.lit(1)).alias("n"))


# --- requests ---------------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, endpoint, preset, body: events as request bodies, many of them faulty."""
    df = inputs.events(spark, sf, "event_type", "user_id", "props")
    kind, props = F.col("event_type"), F.col("props")
    noul = '"spec": {"q": {"type": "noul", "instructions": "?"}}'

    def j(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def spec(text: str) -> Column:
        return j('{"context": ', props, ', "spec": ', text, "}")

    body = inputs.pick(
        "event_id",
        j('{"context": ', props, ", ", noul, "}"),
        F.lit(""),
        j('{"context": ', props),
        j("[", props, "]"),
        j('{"state": "', kind, '", "model": 3, ', noul, "}"),
        j('{"context": "', kind, '", "max_len": "2048", ', noul, "}"),
        j('{"context": "', kind, '", "max_len": 2.5, ', noul, "}"),
        j('{"context": "', kind, '", "max_len": 16384, ', noul, "}"),
        j('{"state": "', kind, '", "max_len": 4096, "lang": null, "task": "', kind, '", ', noul, "}"),
        j('{"bogus": 1, "context": "', kind, '"}'),
        j("{", noul, "}"),
        j('{"context": ', props, "}"),
        spec("[]"),
        spec("{}"),
        spec('{"q": "noul"}'),
        spec('{"q": {"instructions": "?"}}'),
        spec('{"a": {"type": "noul", "instructions": "?"}, "q": {"type": "rank", "instructions": "?"}}'),
        spec('{"q": {"type": "noul"}}'),
        spec('{"q": {"type": "choice", "instructions": "?", "criteria": null}}'),
        spec('{"q": {"type": "choice", "instructions": "?", "criteria": ["a", 1]}}'),
        spec('{"q": {"type": "choice", "instructions": "?", "criteria": "a"}}'),
        spec('{"q": {"type": "choice", "instructions": "?", "criteria": {}}}'),
        spec('{"q": {"type": "score", "instructions": "?", "criteria": {"a": 1}}}'),
        spec('{"q": {"type": "score", "instructions": "?", "criteria": ["one"]}}'),
        j('{"context": 1, "state": "', kind, '", "questions": {"c": {"type": "choice", "criteria": '
          '["x", "', kind, '", "x"], "instructions": {"é": "', kind, '", "n": 1.50}}, '
          '"n": {"type": "noul", "instructions": "?", "criteria": {"true": ["y", ',
          F.col("user_id").cast("string"), '], "false": ""}}, "s": {"type": "score", '
          '"instructions": "how?", "criteria": [null, {"a": 2.50}, "top"]}, '
          '"o": {"type": "choice", "instructions": "?", "criteria": {"a": null, "b": 0, "c": "", '
          '"d": ', props, "}}}}"),
    )
    return df.select("event_id", "event_type", "user_id", body.alias("body"))


@query
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    df = requests.parse_requests(_bodies(spark, sf))
    # Decoder messages differ between JSON libraries; the class of the error does not.
    message = F.when(F.startswith("error", F.lit("invalid JSON")), "invalid JSON").otherwise(
        F.col("error")
    )
    return df.select(
        "event_id",
        message.alias("error"),
        "error_class",
        "lang",
        "task",
        long("max_len").alias("max_len"),
        F.when(F.col("error").isNull(), F.col("context_text")).alias("context_text"),
        F.when(F.col("error").isNull(), F.col("state_text")).alias("state_text"),
    )


@query
def request_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the valid requests, normalised and rendered."""
    df, _ = requests.split_valid(requests.parse_requests(_bodies(spark, sf)))
    rows = specs.question_rows(df.select("event_id", "questions"))
    q = {c: F.col(c) for c in ("qtype", "keys", "descs", "levels", "noul_false", "noul_true")}
    return rows.select(
        "event_id",
        long("q_pos").alias("q_pos"),
        "qid",
        "qtype",
        "instructions",
        F.array_join(specs.option_texts(q), "|").alias("options"),
        F.array_join("legend", "|").alias("legend"),
    )


@query
def request_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters per class and kind of problem."""
    _, bad = requests.split_valid(requests.parse_requests(_bodies(spark, sf)))
    return bad.groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


@query
def preset_requests(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.events(spark, sf, "event_type", "props")
    kind = F.col("event_type")
    preset = inputs.pick("event_id", F.lit("email"), F.lit("guard"), F.lit("nope"), F.lit("email"))
    body = inputs.pick(
        "event_id",
        F.concat(F.lit('{"context": {"body": "'), kind, F.lit('"}, "categories": {"'), kind,
                 F.lit('": "x", "b": null}}')),
        F.concat(F.lit('{"context": '), F.col("props"), F.lit(', "spec": {}}')),
        F.concat(F.lit('{"context": "'), kind, F.lit('"}')),
        F.concat(F.lit('{"context": "'), kind, F.lit('", "categories": []}')),
        F.concat(F.lit('{"contex": "'), kind, F.lit('"}')),
    )
    df = df.select("event_id", preset.alias("preset"), body.alias("body"))
    df = requests.parse_requests(
        df, endpoint="preset", preset="preset", presets=specs.presets(spark)
    )
    every = F.transform(
        "questions", lambda q: F.concat(
            q["qid"], F.lit("="), F.array_join(specs.option_texts(q), "|")))
    return df.select(
        "event_id",
        "error",
        "error_class",
        F.when(F.col("error").isNull(), F.array_join(every, "; ")).alias("options"),
    )


@query
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.hinted(spark, sf)
    message = inputs.pick(
        "doc_id",
        F.concat(F.lit('unknown model "'), "lang", F.lit('"')),
        F.concat(F.lit("load "), "lang", F.lit(": no checkpoint")),
        F.lit('question "q" options exceed head_max_len=192'),
        F.lit("max_len must be positive, got -1"),
        F.concat(F.lit("graph failed on "), "lang"),
        F.lit(None).cast("string"),
    )
    df = df.withColumn("message", message)
    return df.groupBy("message", requests.failure_class(F.col("message")).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def checkpoint_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Routed documents against a catalog that lacks a checkpoint."""
    routed = _routed_documents(spark, sf).select("doc_id", "route.model")
    known = small_table(spark, [("english", "hub/en"), ("typed-decisions", "")],
                        "model string, repo string")
    # Counted once; the three models then meet the catalog.
    counts = catalog.with_checkpoint(
        routed.groupBy("model").agg(F.count(F.lit(1)).alias("n")), known)
    return counts.select(
        "model",
        "n",
        F.coalesce(
            F.nullif(F.col("checkpoint.repo"), F.lit("")),
            default_repo(F.col("model"), RouterOptions(repo_base="owner/family")),
        ).alias("repo"),
        F.when(F.col("checkpoint").isNull(), F.col("n")).otherwise(0).alias("unavailable"),
    )


# --- tokenisation, scoring, end to end --------------------------------------------------------


@query
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of whole documents with a stand-in vocabulary."""
    encode = token_ids(doubles.WordTokenizer())
    df = inputs.documents(spark, sf, "text")
    df = df.withColumn("ids", encode(F.col("text"), F.lit("english")))
    return df.select(
        "doc_id",
        long(F.size("ids")).alias("n"),
        long(F.size(F.filter("ids", lambda i: i == doubles.UNKNOWN_ID))).alias("unknown"),
        long(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + i)).alias("total"),
    )


@query
def score_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """A forward pass of a stand-in graph over the sequences of all turns."""
    df = _preset_sequences(spark, sf).select("conv_id", "turn", "sequences")
    model = inputs.pick("conv_id", F.lit("english"), F.lit("multilingual"))
    df = df.withColumn("model", model).withColumn("pad_id", F.lit(0))
    df = score(df, doubles.GraphDouble(), max_tokens=4096)
    rows = df.select(
        "conv_id", "turn", F.posexplode(F.arrays_zip("logits", "act_logits")).alias("q_pos", "z")
    )
    return rows.select(
        "conv_id",
        "turn",
        long("q_pos").alias("q_pos"),
        long(F.size("z.logits")).alias("k"),
        F.round(F.aggregate("z.logits", F.lit(0.0), lambda a, x: a + x), 4).alias("logit_sum"),
        F.round(F.element_at("z.act_logits", 1).cast("double"), 4).alias("act0"),
        F.round(F.element_at("z.act_logits", 2).cast("double"), 4).alias("act1"),
    )


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.preset_contexts(spark, sf)
    model = inputs.pick("conv_id", F.lit(None).cast("string"), F.lit("typed"), F.lit("nope"))
    max_len = inputs.pick("turn", F.lit(None).cast("int"), F.lit(300), F.lit(100), F.lit(9000))
    df = df.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        "spec_id",
        F.col("text").alias("context_text"),
        F.col("text").alias("state_text"),
        model.alias("model"),
        max_len.alias("max_len"),
    )
    return predict(
        df,
        specs.presets(spark),
        doubles.catalog(spark),
        doubles.WordTokenizer(),
        doubles.GraphDouble(),
        bounded_specs=True,
    )


@query
def result_json_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole results as JSON, with the parts that identify them taken out of the text again."""
    df = sinks.result_json(_predicted(spark, sf).filter(F.col("error").isNull()))
    answers = F.get_json_object("result", "$.answers")
    return df.select(
        "request_id",
        F.get_json_object("result", "$.model").alias("model"),
        F.get_json_object("result", "$.usage.input_tokens").cast("bigint").alias("input_tokens"),
        F.get_json_object("result", "$.routing.detection.script").alias("script"),
        F.get_json_object("result", "$.routing.reason").alias("reason"),
        long(F.size(F.json_object_keys(answers))).alias("n_answers"),
    )


@query
def predict_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Routing, tokenisation, scoring and calibration of every turn, end to end."""
    df = _predicted(spark, sf)
    return df.select(
        "request_id",
        F.when(F.col("error").isNull(), F.col("model")).alias("model"),
        "error_class",
        F.when(F.col("error").isNull(), long("input_tokens")).alias("input_tokens"),
        long(F.size("answers")).alias("n_answers"),
    ).withColumn("n_answers", F.when(F.col("error_class").isNull(), F.col("n_answers")))


@query
def predict_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = decisions(_predicted(spark, sf))
    return rows.select(
        "request_id", long("q_pos").alias("q_pos"), "qid", "qtype", "choice", "score", "noul",
        "confidence", "model",
    )


@query
def write_and_read_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results written by model and read back."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    done = _predicted(spark, sf).filter(F.col("error").isNull())
    for _ in range(2):  # the second time replaces the files of the first
        sinks.write_results(done.select("request_id", "model", "answers", "input_tokens"), path)
    back = spark.read.parquet(path)
    return back.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").cast("bigint").alias("input_tokens")
    )


@query
def stream_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream of requests: routed rows, with dead letters set apart."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
         T.StructField("lang", T.StringType())]
    )
    stream = (
        stream_table(spark, sf, "documents", schema)
        .withColumn("model_hint", inputs.pick("doc_id", F.lit(None).cast("string"), F.lit("nope"),
                                              F.lit("en")))
    )

    rows = route(stream, "text", "model_hint").select(
        "doc_id", "route.model", "route.reason", "route.error"
    )
    write_stream(rows, f"{base}/routed", f"{base}/checkpoint").awaitTermination()
    routed, dead = read_stream_results(spark, f"{base}/routed")
    both = routed.unionByName(dead)
    return both.groupBy("model", "reason", F.col("error").isNotNull().alias("dead")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- raw bodies to their end ------------------------------------------------------------------


def _noul(*fields) -> Column:
    """A body with one yes/no question and these fields."""
    parts = [F.lit(f) if isinstance(f, str) else f for f in fields]
    return F.concat(
        F.lit('{"spec": {"q": {"type": "noul", "instructions": "?"}}, '), *parts, F.lit("}"))


def _outcome_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, body: events as request bodies of every outcome."""
    df = inputs.events(spark, sf, "event_type")
    said = F.concat(F.lit('"context": "'), F.col("event_type"), F.lit('"'))
    return df.select("event_id", inputs.pick(
        "event_id",
        _noul(said, ', "model": "en"'),
        _noul(said, ', "model": "ml"'),
        _noul(said, ', "model": "a\\"b"'),
        _noul(said, ', "model": "en", "max_len": 100'),
        _noul(said, ', "model": "typed", "max_len": 8192'),
        _noul(said, ', "max_len": 2147483648'),
        _noul(said, ', "max_len": 9223372036854775808'),
        _noul(said, ', "max_len": -1'),
        _noul(said, ', "lang": 3'),
        _noul(said, ', "bogus": 1'),
        F.concat(F.lit("{"), said, F.lit(', "model": "en"}')),
        _noul(said, ', "lang": "fr", "max_len": 0'),
    ).alias("body"))


@query
def request_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bodies to what keeps them from an answer: 400, 503 or nothing, one row for each."""
    parsed = requests.parse_requests(_outcome_bodies(spark, sf))
    rows, own = intern_specs(parsed, f"{shared_dir(spark)}/specs-{uuid.uuid4().hex}")
    known = doubles.catalog(spark).where("model <> 'multilingual'")
    df = admit(rows, own, known)
    return df.select(
        "event_id", "error", "error_class",
        F.when(F.col("error").isNull(), F.col("model")).alias("model"),
        F.when(F.col("error").isNull(), long("window")).alias("window"))


@query
def request_route(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bodies routed; a spec is optional here, faulty bodies keep their error."""
    parsed = requests.parse_requests(_outcome_bodies(spark, sf), endpoint="route")
    df = route_requests(parsed)
    return df.select("event_id", "error", "error_class", "route.model")


@query
def raw_json_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Documents nested thousands of levels deep parse like flat ones."""
    depth = (F.lit(1500) + F.col("turn") * 500).cast("int")
    df = inputs.conversations(spark, sf).select(
        "conv_id", "turn", "text",
        F.concat(F.repeat(F.lit("["), depth), pyjson.quote(F.col("text")), F.repeat(F.lit("]"), depth))
        .alias("body"))
    df = raw_json.parse_json(df, "body")
    leaf = F.element_at("nodes", -1)
    return df.select(
        "conv_id", "turn", "invalid", "kind", long(F.size("nodes")).alias("n_nodes"),
        long(leaf["depth"]).alias("depth"), (leaf["text"] == F.col("text")).alias("same_text"))


@query
def order_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their line items, prices and a map of maps inside, as JSON text."""
    lines = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(
        F.struct("l_linenumber", "l_extendedprice", "l_tax"))).alias("rows"))
    items = F.transform("rows", lambda r: F.struct(
        r["l_linenumber"].alias("l_linenumber"), r["l_extendedprice"].alias("price"),
        F.create_map(F.lit("rates"), F.create_map(F.lit("tax"), r["l_tax"])).alias("more")))
    context = F.struct(F.col("l_orderkey").alias("order"), items.alias("items"))
    df = orders.select("l_orderkey", context.alias("context"))
    return df.select("l_orderkey", pyjson.state_text("context", df.schema["context"].dataType).alias("state"))


@query
def stream_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bodies as a stream: routed rows, and dead letters with their errors."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _outcome_bodies(spark, sf).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("event_id long, body string").option(
        "maxFilesPerTrigger", 64).parquet(f"{base}/in")
    rows = route_requests(requests.parse_requests(stream, endpoint="route")).select(
        "event_id", "error", "error_class", "route.model")
    write_stream(rows, f"{base}/out", f"{base}/state").awaitTermination()
    routed, dead = read_stream_results(spark, f"{base}/out")
    return routed.unionByName(dead).groupBy("model", "error_class").agg(
        F.count(F.lit(1)).alias("n"))


def _admitted_stream(spark: SparkSession, sf: str) -> str:
    """Events as a stream of bodies, each asking about its own type, admitted in several batches;
    the folder of the results."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    kind = F.col("event_type")
    more = inputs.pick("event_id", *[F.lit(x) for x in (
        "", ', "model": "ml"', ', "model": "en", "max_len": 100', ', "bogus": 1')])
    said = F.concat(
        F.lit('{"context": "'), kind, F.lit('", "spec": {"q": {"type": "noul", "instructions": "is it '),
        kind, F.lit('?"}}'), more, F.lit("}"))
    inputs.events(spark, sf, "event_type").select("event_id", said.alias("body")).repartition(
        4, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("event_id long, body string").option(
        "maxFilesPerTrigger", 2).parquet(f"{base}/in")
    known = doubles.catalog(spark).where("model <> 'multilingual'")
    admit_stream(requests.parse_requests(spread(stream)), f"{base}/out", f"{base}/state", known).awaitTermination()
    return f"{base}/out"


@query
def stream_admitted(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bodies as a stream up to admission: models, windows and errors of all batches."""
    ok, dead = read_stream_results(spark, f"{_admitted_stream(spark, sf)}/rows")
    fine = F.col("error").isNull()
    return ok.unionByName(dead).groupBy(
        "error", "error_class", F.when(fine, F.col("model")).alias("model"),
        F.when(fine, long("window")).alias("window")).agg(F.count(F.lit(1)).alias("n"))


@query
def stream_specs(spark: SparkSession, sf: str) -> DataFrame:
    """How often a stream of bodies handed on each spec, and what its batches observed."""
    out = _admitted_stream(spark, sf)
    asked = read_specs(spark, out).groupBy(F.col("questions")[0]["instructions"].alias("what")).agg(
        F.count(F.lit(1)).alias("n"))
    seen = read_batches(spark, out).unpivot(
        ["batch_id"], ["rows", "dead", "new_specs"], "what", "n").groupBy("what").agg(F.sum("n").alias("n"))
    return asked.unionByName(seen)


@query
def catalog_files(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration files written from counts of documents, read as a catalog and listed."""
    root = f"{shared_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
    counts = inputs.documents(spark, sf, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    forms = {
        "typed-decisions": F.concat(F.lit('{"name": "td", "max_len": 0, "temperature": [1, '),
                                    F.col("n"), F.lit("]}")),
        "english": F.concat(F.lit('{"name": "en", "repo": "hub/en", "encoder": "e", "max_len": '),
                            F.col("n"), F.lit(', "temperature": [1.5, 2, 0.5]}')),
        "unlisted": F.concat(F.lit('{"name": "x", "max_len": '), F.col("n"), F.lit("}")),
    }
    # The third takes all other languages together, rows without one included.
    form = F.when(F.col("lang").isin("fr", "en"), F.col("lang")).otherwise("other")
    counts = counts.groupBy(form.alias("lang")).agg(F.sum("n").alias("n"))
    for (name, text), lang in zip(forms.items(), ("fr", "en", "other"), strict=True):
        counts.where(F.col("lang") == lang).select(text).coalesce(1).write.text(f"{root}/{name}")
    known = catalog.read_catalog(spark, root, "part-*")
    listed = catalog.catalog_listing(known).select(
        F.col("name").alias("model"), F.col("max_len").alias("listed_len"))
    return known.join(listed, "model").select(
        "model", "name", "repo", long("max_len").alias("max_len"),
        long("head_max_len").alias("head_max_len"), long("listed_len").alias("listed_len"),
        F.array_join("temperature", "|").alias("temperature"), "graph_file")


# --- documents as wholes ----------------------------------------------------------------------


@query
def typed_leaf_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as contexts with dates, times, binaries and variants, beside doubles and without."""
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    at = day.cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.pmod("o_orderkey", F.lit(24)),
        secs=F.when(F.col("o_orderkey") % 2 == 0, 0.25).otherwise(0).cast("decimal(8,6)"))
    plain = F.struct(day.alias("day"), at.alias("at"), F.col("o_orderstatus").cast("binary").alias("raw"))
    priced = F.struct(
        day.alias("day"), at.alias("at"), F.col("o_orderstatus").cast("binary").alias("raw"),
        F.col("o_totalprice").alias("price"))
    variant = F.parse_json(F.concat(
        F.lit('{"day": "'), day.cast("string"), F.lit('", "key": '), F.col("o_orderkey").cast("string"),
        F.lit(', "tags": ["a", null, 2.5]}')))
    df = orders.select(
        "o_orderkey", plain.alias("flat"), F.array(plain, F.lit(None)).alias("list"),
        F.array(priced).alias("prices"), F.create_map(F.lit("k"), F.array(priced)).alias("map"),
        F.struct(variant.alias("v"), F.array(variant).alias("vs")).alias("variants"))
    texts = [c for c in df.columns if c != "o_orderkey"]
    return df.select("o_orderkey", *[
        pyjson.json_text(c, df.schema[c].dataType).alias(c) for c in texts])


def _documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two JSON documents per event; the second differs in one of eight ways, or not at all."""
    df = inputs.events(spark, sf, "event_type", "user_id", "value", "props")
    case = F.pmod("event_id", F.lit(8))

    def document(value: Column, props: Column, kind: Column, pair: Column, none: Column, more: Column):
        return F.concat(
            F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "v": '), value,
            F.lit(', "p": '), props, F.lit(', "m": {"type": "'), kind, F.lit('", "deep": {"n": ['), pair,
            F.lit(']}}, "z": '), none, more, F.lit("}"))

    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    pair, swapped = F.concat(user, F.lit(", 1.0")), F.concat(F.lit("1, "), user)
    null, nothing = F.lit("null"), F.lit("")
    got = document(value, F.col("props"), F.col("event_type"), pair, null, nothing)
    moved = (F.col("value") + F.when(case == 1, 0.0015).when(case == 2, 0.01).otherwise(0)).cast("string")
    want = document(
        moved,
        F.when(case == 3, "{}").when(case == 4, F.concat(F.lit('{"x": [], '), F.substring("props", 2, 99)))
        .otherwise(F.col("props")),
        F.when(case == 5, "other").otherwise(F.col("event_type")),
        F.when(case == 6, swapped).otherwise(pair),
        F.when(case == 7, "0.001").otherwise(null),
        F.when(case == 0, ', "more": {"a": {"b": true}}').otherwise(nothing))
    return df.select("event_id", got.alias("doc")), df.select("event_id", want.alias("doc"))


@query
def document_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Structural difference of two documents per event: nested, missing and extra values."""
    got, want = _documents(spark, sf)
    return reports.document_parity(got, want, ["event_id"], "doc").select("event_id", "path", "verdict")


@query
def equal_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents agree as a whole."""
    got, want = _documents(spark, sf)
    parity = reports.document_parity(got, want, ["event_id"], "doc")
    return reports.equal_documents(parity, ["event_id"])


# --- batches and variants ---------------------------------------------------------------------


def _length_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _preset_sequences(spark, sf).select("conv_id", "turn", F.explode("sequences").alias("s")).select(
        "conv_id", "turn", "s.qid", F.size("s.ids").alias("n_ids"), F.size("s.markers").alias("n_options"))
    folder = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    return sequence.length_batches(rows, "n_ids", ["conv_id", "turn", "qid"], 4096, folder)


@query
def length_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batch of every sequence of every turn, by length and a budget of padded ids."""
    return _length_batches(spark, sf).select(
        "conv_id", "turn", "qid", long("n_ids").alias("n_ids"), "batch_id")


@query
def length_batch_report(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions of these batches."""
    report = sequence.batch_report(_length_batches(spark, sf), "n_ids", "n_options")
    return report.select("batch_id", *[
        long(c).alias(c) for c in ("n_rows", "max_ids", "max_options", "ids", "padded_ids")])


@query
def probability_movement(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated probabilities of a graph variant with logits in steps of a quarter."""
    left = _probabilities(spark, sf)
    coarse = F.transform("logits", lambda x: (F.floor(x * 4 + 0.5) / 4).cast("float"))
    right = left.withColumn("p", calibrate.scaled_softmax(coarse, F.col("t")))
    found = reports.probability_movement(left, right, ["vec_id"])
    return found.select(
        "qtype", "n", F.round("max_movement", 4).alias("max_movement"),
        F.round("mean_movement", 4).alias("mean_movement"), "vec_id", long("n_flips").alias("n_flips"))


@query
def email_extras_json(spark: SparkSession, sf: str) -> DataFrame:
    """Email contexts with extras of every JSON kind, and what detection reads of them."""
    df = clean_email(inputs.email_threads(spark, sf), "body", "cleaned", max_chars=200)
    even = F.col("doc_id") % 2 == 0
    listed = F.array(F.struct(F.col("source").alias("s"), (F.col("doc_id") / 4).alias("x")), F.lit(None))
    types = df.select(listed.alias("l")).schema
    extra = {
        "id": (F.when(even, F.col("doc_id")), T.LongType()),
        "flag": (even, T.BooleanType()),
        "list": (F.when(F.col("doc_id") % 3 > 0, listed), types["l"].dataType),
        "lang": "lang",
    }
    fields = email_context(F.lit(" s "), "cleaned", None, extra)
    return df.select(
        "doc_id", pyjson.object_text(fields).alias("state"), email_text(fields).alias("read"))


@query
def compact_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON with spaces, made compact, and back again to the first text."""
    df = inputs.documents(spark, sf, "text", "lang", "n_chars")
    special = F.lit(json.dumps("<a href='&'>\u2028\u2029 \\ \x07 \x7f é"))
    text = F.concat(
        F.lit('{"z": '), pyjson.quote(F.col("text")), F.lit(', "a": [ ], "n": [1.50, -0, 1e5, '),
        F.col("n_chars").cast("string"), F.lit(', null, true], "<k>": {"b": {}, "s": '), special,
        F.lit(', "l": '), F.coalesce(pyjson.quote(F.col("lang")), F.lit("null")), F.lit("}}"))
    df = df.select("doc_id", text.alias("body")).withColumn("compact", raw_json.compact_json("body"))
    first = raw_json.parse_json(df, "body").select("doc_id", "compact", F.col("canonical").alias("first"))
    back = raw_json.parse_json(first, "compact")
    return back.select("doc_id", "compact", (F.col("canonical") == F.col("first")).alias("same"))


@query
def truncation_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the context ids lost at a window of 512, per source and language, rolled up."""
    df = inputs.documents(spark, sf, "text", "source", "lang")
    dropped = sequence.dropped_tokens(
        inputs.word_ids(F.col("text")), F.array_repeat(F.lit(1), 60), F.lit(512))
    sketches = sequence.truncation_sketches(
        df.select("doc_id", F.coalesce("source", F.lit("")).alias("source"),
                  F.coalesce("lang", F.lit("")).alias("lang"), dropped.alias("dropped")), "source", "lang")
    return sequence.truncation_percentiles(sketches, ["source", "lang"], (0.5, 0.9, 0.99))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as cases of four questions, with sequences as long as their options."""
    rows = _answered(spark, sf)
    answer = F.struct("q_pos", *[c for c in rows.columns if c not in ("request_id", "label", "q_pos")])
    ids = F.sequence(F.lit(1), F.col("q_pos") + 3)
    cases = rows.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("q_pos", F.struct(
            "qid", ids.alias("ids"), F.array("q_pos").alias("markers")).alias("s")))).alias("s"),
        F.array_sort(F.collect_list(answer), lambda a, b: a["q_pos"] - b["q_pos"]).alias("answers"))
    return cases.select(
        F.element_at(F.array(*[F.lit(m) for m in fixed.MODEL_NAMES]), (F.col("request_id") % 3 + 1).cast("int"))
        .alias("model"),
        F.col("request_id").cast("string").alias("case"),
        F.format_string('{"n": %d}', "request_id").alias("state"), F.lit("{}").alias("questions"),
        F.col("s.s").alias("sequences"), "answers",
        F.aggregate("s.s", F.lit(0), lambda n, s: n + F.size(s["ids"])).alias("input_tokens"))


@query
def golden_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Cases recorded to files, read back and compared with a run that lost and moved some values."""
    cases = _cases(spark, sf)
    path = f"{shared_dir(spark)}/golden-{uuid.uuid4().hex}"
    golden.write_golden(cases, path)
    odd = F.col("case").cast("long") % 5 == 0
    run = cases.withColumns({
        "answers": F.filter(
            F.transform("answers", lambda a: a.withField("confidence", a["confidence"] + F.when(
                odd, 0.01).otherwise(0.001))),
            lambda a: ~odd | (a["qid"] != "q1")),
        "sequences": F.when(odd, F.slice("sequences", 1, 3)).otherwise(F.col("sequences")),
        "input_tokens": F.col("input_tokens") + F.when(odd, 1).otherwise(0),
    })
    parity = golden.golden_parity(run, golden.read_golden(spark, path, lines=True))
    kind = F.regexp_replace("field", r"^(answers\.[^.]*\.(?:probabilities|legend))\..*", "$1")
    return parity.groupBy("model", kind.alias("field"), "verdict").agg(F.count(F.lit(1)).alias("n"))


# --- faulty rows ------------------------------------------------------------------------------


def _doubled(bodies: list[str]) -> list[int]:
    """A batch job that fails as a whole for one poisoned body."""
    return [2 * int(json.loads(b)["k"]) for b in bodies]


@query
def isolated_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A batch job over all events, some of them poisoned: these alone get an error."""
    df = inputs.events(spark, sf, "props").withColumn(
        "props", F.when(F.col("event_id") % 97 == 5, "{").otherwise(F.col("props")))
    done = map_isolated(df, "props", _doubled, "doubled", T.LongType())
    return done.select("event_id", "doubled", F.col("error").isNotNull().alias("failed"), "error_class")
