"""Checkpoint catalog: configuration files as a table, windows and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.text import col

CONFIG_SCHEMA = (
    "name string, repo string, encoder string, max_len int, head_max_len int, "
    "temperature array<double>, temperature_by_options map<string,double>, "
    "act_costs map<string,double>, "
    "special_tokens struct<cls_id:bigint,sep_id:bigint,mask_id:bigint,pad_id:bigint,"
    "cls:string,sep:string,mask:string,pad:string>, "
    "onnx struct<file:string,opset:int,inputs:array<string>,outputs:array<string>>"
)


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults of a configuration; 0 counts as missing for the two lengths."""
    def filled(c: Column, default: int) -> Column:
        return F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))

    def or_default(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    def listed(c: Column, default: list[str]) -> Column:
        return F.when(F.size(c) > 0, c).otherwise(_texts(default))

    onnx, tokens = F.col("onnx"), F.col("special_tokens")
    return df.select(
        *[c for c in df.columns if c not in CONFIG_NAMES],
        "name",
        "repo",
        "encoder",
        filled(F.col("max_len"), fixed.DEFAULT_MAX_LEN).alias("max_len"),
        filled(F.col("head_max_len"), fixed.DEFAULT_HEAD_MAX_LEN).alias("head_max_len"),
        F.when(F.size("temperature") >= 3, F.col("temperature"))
        .otherwise(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
        .alias("temperature"),
        F.coalesce("temperature_by_options", F.create_map().cast("map<string,double>")).alias(
            "temperature_by_options"
        ),
        "act_costs",
        *[
            F.coalesce(tokens[f"{t}_id"], F.lit(0)).cast("int").alias(f"{t}_id")
            for t in ("cls", "sep", "mask", "pad")
        ],
        or_default(tokens["mask"], fixed.DEFAULT_MASK).alias("mask"),
        or_default(onnx["file"], fixed.DEFAULT_GRAPH_FILE).alias("graph_file"),
        listed(onnx["inputs"], fixed.GRAPH_INPUTS).alias("graph_inputs"),
        listed(onnx["outputs"], fixed.GRAPH_OUTPUTS).alias("graph_outputs"),
    )


CONFIG_NAMES = [
    "name", "repo", "encoder", "max_len", "head_max_len", "temperature",
    "temperature_by_options", "act_costs", "special_tokens", "onnx",
]


def read_catalog(spark: SparkSession, root: str, files: str = "*_config.json") -> DataFrame:
    """Catalog of ``<root>/<model>/<config file>``: one row per known checkpoint directory.

    ``model`` is the directory, ``files`` the glob of the configuration file inside it.
    """
    raw = (
        spark.read.schema(CONFIG_SCHEMA)
        .option("multiLine", True)
        .json(f"{root.rstrip('/')}/*/{files}")
    )
    path = F.col("_metadata.file_path")
    named = raw.select(
        F.element_at(F.split(path, "/"), -2).alias("model"),
        path.alias("path"),
        F.struct(*CONFIG_NAMES).alias("config"),
    ).filter(F.col("model").isin(fixed.MODEL_NAMES))
    # One row per checkpoint, whatever the glob finds: joins rely on it.
    one = named.groupBy("model").agg(F.min_by("config", "path").alias("config"))
    return fill_defaults(one.select("model", "config.*"))


def catalog_listing(catalog: DataFrame, max_len: int = 0) -> DataFrame:
    """name, repo, encoder and effective window, in canonical order."""
    order = F.array_position(_texts(fixed.MODEL_NAMES), F.col("model"))
    window = F.lit(max_len) if max_len > 0 else F.col("max_len")
    return catalog.orderBy(order).select(
        F.col("model").alias("name"), "repo", "encoder", window.alias("max_len")
    )


def max_len_error(requested: Column | str, head_max_len: Column | str) -> Column:
    """Why a requested window is not accepted, or null; 0 and null mean the default."""
    n, least = col(requested), col(head_max_len) + 16
    text = n.cast("string")
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, None)
        .when(n < 0, F.concat(F.lit("max_len must be positive, got "), text))
        .when(
            n > fixed.MAX_CONTEXT,
            F.concat(
                F.lit("max_len "),
                text,
                F.lit(f" exceeds the encoder limit of {fixed.MAX_CONTEXT} tokens"),
            ),
        )
        .when(
            n < least,
            F.concat(
                F.lit("max_len "),
                text,
                F.lit(" is too small for head_max_len="),
                col(head_max_len).cast("string"),
                F.lit(" (need at least "),
                least.cast("string"),
                F.lit(")"),
            ),
        )
    )


def effective_max_len(
    requested: Column | str, override: Column | str, configured: Column | str
) -> Column:
    """Window of a request: its own, else the override, else the checkpoint's."""
    zero = F.lit(0)
    return F.coalesce(
        F.nullif(col(requested), zero), F.nullif(col(override), zero), col(configured)
    )


def _per_model(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("model").isin(*fixed.MODEL_NAMES)).dropDuplicates(["model"])


def with_checkpoint(df: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """Add the catalog row of each request's checkpoint as struct ``checkpoint``.

    At most one row per known model name is broadcast, whatever the catalog holds.
    """
    rows = _per_model(catalog).select(
        F.col("model").alias(model), F.struct(*catalog.columns).alias("checkpoint")
    )
    return df.join(F.broadcast(rows), model, "left")


def missing_checkpoints(df: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """Models that requests are routed to but that have no checkpoint, with their counts."""
    wanted = df.groupBy(model).agg(F.count(F.lit(1)).alias("n"))
    known = _per_model(catalog).select(F.col("model").alias(model))
    return wanted.join(F.broadcast(known), model, "left_anti")
