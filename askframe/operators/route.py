"""Routing: which checkpoint answers a request, and why.

``route`` adds struct columns only; names resolve through literal maps, so there is no join
and no shuffle. Rows that carry a hint skip detection altogether.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.detect import DETECTION_TYPE, detect
from askframe.functions.plan import aside, seal
from askframe.functions.text import col, fold_name, percent_text, quote_repr, quoted_name
from askframe.sources.tables import literal_map


@dataclass(frozen=True)
class RouterOptions:
    """Settings of the router.

    ``repo_base`` is the model hub id of the checkpoint family ("owner/name"). Its last part
    also gives the family aliases: name, name-multilingual and name-typed-decisions.
    """

    default: str = "english"
    auto_task: bool = False
    repo_base: str | None = None

    def aliases(self) -> dict[str, str]:
        names = dict(fixed.ALIASES)
        if self.repo_base:
            family = self.repo_base.rsplit("/", 1)[-1].lower()
            names[family] = "english"
            names[f"{family}-multilingual"] = "multilingual"
            names[f"{family}-typed-decisions"] = "typed-decisions"
        return names


def resolve_name(name: Column, options: RouterOptions = RouterOptions()) -> Column:
    """Canonical checkpoint name of a name or alias, null when unknown."""
    known = {**options.aliases(), **{n: n for n in fixed.MODEL_NAMES}}
    return F.try_element_at(literal_map(known), fold_name(name))


def unknown_model(name: Column, options: RouterOptions = RouterOptions()) -> Column:
    names = " ".join(fixed.MODEL_NAMES)
    aliases = " ".join(sorted(options.aliases()))
    return F.concat(
        F.lit("unknown model "),
        quoted_name(name),
        F.lit(f'; choose one of [{names}] (or an alias: [{aliases}])'),
    )


def default_repo(model: Column, options: RouterOptions = RouterOptions()) -> Column:
    suffix = F.try_element_at(literal_map(fixed.REPO_SUFFIXES), model)
    return F.concat(F.lit(options.repo_base), suffix)


def model_for_language(lang: Column) -> Column:
    """English codes go to the English checkpoint, everything else to the multilingual one."""
    base = F.element_at(F.split(lang, "-", 2), 1)
    return F.when(F.lower(base).isin(fixed.ENGLISH_CODES), "english").otherwise("multilingual")


def _present(c) -> Column:
    return F.lit(None).cast("string") if c is None else F.nullif(col(c), F.lit(""))


def route(
    df: DataFrame,
    text: Column | str,
    model: Column | str | None = None,
    task: Column | str | None = None,
    lang: Column | str | None = None,
    workflow: Column | str | None = None,
    repos: Column | None = None,
    out: str = "route",
    options: RouterOptions = RouterOptions(),
) -> DataFrame:
    """Add ``out``: struct(model, repo, reason, detection, workflow, error).

    Precedence: model hint, task hint, workflow (if ``auto_task``), language hint, detected
    script and language, default. Empty hints count as absent. ``workflow`` is the spec's
    ``workflow_of``; ``repos`` an optional MAP from checkpoint name to repo from a catalog.
    """
    helpers = ("_model", "_task", "_lang", "_workflow", "_detection", "_chosen", "_reason")
    given = [_present(model), _present(task), _present(lang), _present(workflow), col(text)]
    df, (model, task, lang, workflow, text), back = aside(df, helpers, *given)
    default = _canonical(options.default, options)
    m, t, lg, wf = (F.col(c) for c in ("_model", "_task", "_lang", "_workflow"))
    df = df.withColumns(
        {
            "_model": model,
            "_task": task,
            "_lang": lang,
            "_workflow": workflow,
        }
    )
    by_workflow = wf.isNotNull() if options.auto_task else F.lit(False)
    by_detection = m.isNull() & t.isNull() & lg.isNull() & ~by_workflow
    df = detect(df, text, "_detection", where=by_detection)

    task_name = F.when(
        F.replace(F.lower(t), F.lit("-"), F.lit("_")) == "typed_decisions", "typed-decisions"
    ).otherwise(t)
    script, english = F.col("_detection.script"), F.col("_detection.is_english")
    chosen = (
        F.when(m.isNotNull(), resolve_name(m, options))
        .when(t.isNotNull(), resolve_name(task_name, options))
        .when(by_workflow, "typed-decisions")
        .when(lg.isNotNull(), model_for_language(lg))
        .when(script == "unknown", default)
        .when((script != "latin") | ~english, "multilingual")
        .otherwise("english")
    )
    reason = (
        F.when(m.isNotNull(), F.concat(F.lit("explicit model="), quote_repr(m)))
        .when(t.isNotNull(), F.concat(F.lit("explicit task="), quote_repr(t)))
        .when(
            by_workflow,
            F.concat(
                F.lit("question ids match the "),
                quote_repr(wf),
                F.lit(" typed-decisions workflow"),
            ),
        )
        .when(lg.isNotNull(), F.concat(F.lit("explicit lang="), quote_repr(lg)))
        .when(
            script == "unknown", f"no letters detected in state; using default ({default})"
        )
        .when(
            script != "latin",
            F.concat(
                F.lit("non-Latin script ("),
                script,
                F.lit(", "),
                percent_text(F.col("_detection.non_latin_fraction")),
                F.lit("% of letters); the English checkpoint cannot read it"),
            ),
        )
        .when(
            ~english,
            F.concat(
                F.lit("Latin script but language looks like "),
                quote_repr(F.col("_detection.language")),
                F.lit(", not English"),
            ),
        )
        .otherwise("English Latin text")
    )
    # The name that failed to resolve: the task is checked after its own spelling is mapped.
    asked = F.coalesce(m, task_name)
    df = df.withColumns({"_chosen": chosen, "_reason": reason})
    model_col = F.col("_chosen")
    repo = default_repo(model_col, options)
    if repos is not None:
        repo = F.coalesce(F.nullif(F.try_element_at(repos, model_col), F.lit("")), repo)
    known = model_col.isNotNull()
    explicit = m.isNotNull() | t.isNotNull()
    result = F.struct(
        model_col.alias("model"),
        F.when(known, repo).alias("repo"),
        F.when(known, F.col("_reason")).alias("reason"),
        F.col("_detection").cast(DETECTION_TYPE).alias("detection"),
        F.when(known & ~explicit, wf).alias("workflow"),
        F.when(~known, unknown_model(asked, options)).alias("error"),
    )
    return back(seal(df.withColumn(out, result), out, drop=helpers))


def _canonical(name: str, options: RouterOptions) -> str:
    key = name.strip().lower()
    key = options.aliases().get(key, key)
    if key not in fixed.MODEL_NAMES:
        raise ValueError(f"unknown default model {name!r}")
    return key


def route_mix(df: DataFrame, *by: str) -> DataFrame:
    """Rows and share of rows per combination of the ``by`` columns.

    Partial aggregates shrink hot combinations before the shuffle. The total is a scalar
    subquery over the groups, whose exchange is reused.
    """
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").cast("double")).scalar()
    return groups.withColumn("share", F.col("n").cast("double") / total)


def route_mix_rollup(df: DataFrame, *by: str) -> DataFrame:
    """``route_mix`` with subtotals; ``level`` is the number of columns summed over.

    The subtotals come from the groups, not from the rows, so the expansion stays small.
    """
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    level = sum(F.grouping(c).cast("int") for c in by)
    return groups.rollup(*by).agg(F.sum("n").alias("n"), level.alias("level"))
