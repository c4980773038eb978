"""URL filter rules that follow redirects and canonical links.

Rules name a host and a path prefix. A page that no rule fits takes the decision of its aliases:
pages and targets linked by redirects or canonical links form a component, and a component with a
blocked member and no allowed one is blocked as a whole. An explicit allow rule beats an inherited
block, both on its own page and for the aliases of it.

Everything is Spark SQL functions; edges and labels stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions.plan import seal
from askframe.llm.common import col, kept
from askframe.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` allow or block for a host (with its subdomains) and a path prefix."""

    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case; null without ``://``."""
    rest = F.regexp_extract(_after(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), rest))


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one.

    Of rules of equal length an allow rule wins, then the smaller text.
    """
    by_length = sorted(rules, key=lambda r: (-len(r.where), r.verdict != "allow", r.where))
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.where).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in by_length
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, none)


def fit_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``fit`` (rule, verdict) for every different (host, path) of ``rows``
    that a rule of the table ``rules`` (columns ``where`` and ``verdict``) fits, as ``fitting`` has it.

    For rule tables of any size: every suffix of a host meets the lengths of the paths that the
    rules have there, and only the prefixes of these lengths meet the rules. Two equi-joins, no
    comparison of all rules. Rules with a null text, or a verdict other than allow and block, are
    left out; repeated rules count once.
    """
    where = col("where")
    cut = F.locate("/", where)
    known = rules.where(where.isNotNull() & F.col("verdict").isin("allow", "block")).select(
        where.alias("rule"), "verdict", F.substring_index(where, "/", 1).alias("suffix"),
        F.when(cut > 0, F.substring(where, cut, F.length(where))).otherwise(F.lit("/")).alias("prefix"))
    # The first of all rules for one host and path.
    order = F.struct(
        (-F.length("rule")).alias("size"), (F.col("verdict") != "allow").alias("later"), "rule", "verdict")
    known = known.groupBy("suffix", "prefix").agg(F.min(order).alias("found"))
    sizes = known.select("suffix", F.length("prefix").alias("n")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    asked = (
        rows.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
        .join(sizes, "suffix").where(F.col("n") <= F.length("path"))
        .withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n"))))
    return asked.join(known, ["suffix", "prefix"]).groupBy("host", "path").agg(
        F.min("found").alias("found")).select("host", "path", F.struct(
            F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict")).alias("fit"))


def _with_fit(rows: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``rows`` (with host and path) and ``fit``, computed once per row."""
    if isinstance(rules, DataFrame):
        return rows.join(fit_rules(rows, rules), ["host", "path"], "left")
    return seal(rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)), "fit")


def _resolved(target: Column, url: Column) -> Column:
    """A link target as an absolute URL, relative ones against the page's URL."""
    root = F.concat(F.regexp_extract(url, "^(.*?://)", 1), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)?", 0)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between the nodes of pages and the targets of their canonical links and
    refreshes. Null urls or pages, empty targets and links to itself give none."""
    tags = F.filter(
        F.regexp_extract_all(col(html), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b""")
        | t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""))
    target = F.when(
        F.col("tag").rlike("(?i)^<link"),
        F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1),
    ).otherwise(F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>;]+)""", 1))
    # Sealed step by step, else the filters below would unfold into one huge expression.
    found = seal(
        pages.select(col(url).alias("url"), F.explode(tags).alias("tag"))
        .select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target")),
        "url", "target").where("url is not null and target <> ''")
    absolute = seal(found.select(
        "url", _resolved(F.col("target"), F.col("url")).alias("target")), "url", "target")
    edges = seal(absolute.select(
        node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")), "a", "b")
    return edges.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, edges: DataFrame | None = None,
          key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` and ``verdict`` of every page, and
    ``inherited``, true where the verdict is an alias's block.

    ``rules`` are a short list, tested in turn, or a table of any size (``fit_rules``).
    ``edges`` (a, b) are further redirects between URLs without scheme and fragment (``node_of``).
    A null url, or one without ``://``, has an empty host and path, fits no rule, and is allowed.
    Repeated pages are judged alike; an empty table gives no rows.
    """
    found = links(pages, url, html)
    if edges is not None:
        found = found.unionByName(edges.select("a", "b"))
    members = components(found)
    address = F.concat(F.lit("http://"), F.col("node"))
    decided = _with_fit(seal(
        members.withColumns({"host": host_of(address), "path": path_of(address)}), "host", "path",
    ), rules).select("root", F.col("fit.verdict").alias("v"))
    blocked = kept(
        decided.groupBy("root").agg(
            F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("block"),
            F.max(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allow"))
        .where("block and not allow").join(members, "root").select("node").distinct(),
        "blocked-aliases")
    own = pages.select(
        col(key).alias("page_id"), col(url).alias("url"),
        host_of(F.coalesce(col(url), F.lit(""))).alias("host"),
        path_of(F.coalesce(col(url), F.lit(""))).alias("path"), node_of(col(url)).alias("node"),
    )
    # Computed once per page: conditions and join keys below only read the columns.
    own = _with_fit(seal(own, "host", "path", "node"), rules)
    heir = blocked.select("node", F.lit(True).alias("alias_blocked"))
    block = F.coalesce("alias_blocked", F.lit(False)) & F.col("fit").isNull()
    return own.join(heir, "node", "left").select(
        "page_id", "url", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(block, F.lit("block")), F.lit("allow")).alias("verdict"),
        block.alias("inherited"))
