"""URL filtering by a path-template tree with smoothed labelled purity.

Every host's paths form a tree of segments. Level by level a segment is generalised into a wildcard:
numbers, identifiers and dates by their shape, and what a branch point has too many different values
of, measured against its pages. Sibling branches whose labelled counts don't differ by a two-proportion test
are merged. Labels come from the caller or, without them, from the rules. A template's purity is
its share of blocked labels, smoothed towards its host's and that towards the global share; impure
templates are rejected. Rules that fit a URL win over the template's verdict.

The tree grows until no path has a further segment; a level only takes the paths that reach it. Everything is grouped
aggregation over distinct (host, path) pairs with counts, so a hot URL is one row; branch points, hosts and
templates meet their rows in joins that deal hot keys to many tasks.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is allowed;
a null label is no label; repeated rows count as often as they come; a very long URL is judged whole, a level for each
of its segments; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import settle, spread_join


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the beginning of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class TreeOptions:
    """fan_out: different values of a branch point from which it may become a wildcard;
    ratio: values per page at which it does; z: two-proportion score up to which siblings merge;
    pages: weight of the prior; labels: marked pages that a template needs to be judged by its purity at all;
    reject: purity from which a template is rejected."""

    fan_out: int = 16
    ratio: float = 0.2
    z: float = 1.96
    pages: float = 8.0
    labels: int = 5
    reject: float = 0.8


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    found = F.coalesce(F.locate("://", F.col(url)) > 0, F.lit(False))
    rest = F.substring_index(F.substring_index(F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"), "#", 1), "?", 1)
    slash = F.locate("/", rest)
    host = F.when(slash > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest)))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lower).otherwise(""), F.when(found, F.coalesce(path, F.lit(""))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    """A segment whose form shows that it varies becomes a typed wildcard; a file's suffix stays."""
    stem, suffix = F.regexp_replace(segment, r"\.[A-Za-z0-9]{1,5}$", ""), F.regexp_extract(segment, r"\.[A-Za-z0-9]{1,5}$", 0)
    kind = (
        F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$") | stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F]{12,}$"), "{id}")
        .when(stem.rlike(r"[0-9]{3,}") | (F.length(stem) > 40), "{slug}")
    )
    return F.when(kind.isNotNull(), F.concat(kind, F.lower(suffix))).otherwise(segment)


def _key(*columns: str) -> Column:
    return F.concat_ws("\u0001", *columns)


def path_templates(paths: DataFrame, options: TreeOptions) -> DataFrame:
    """host, path, n, bad, good (distinct host and path) with ``template``, grown level by level from the root."""
    parts = F.split(F.col("path"), "/")
    live = settle(paths.withColumns({"seg": F.transform(F.slice(parts, 2, F.size(parts)), _shape), "template": F.lit("")}))
    done, level = [], 0
    while True:
        ended = F.size("seg") <= level
        done.append(live.where(ended).drop("seg"))
        here = live.where(~ended).withColumns({"s": F.get("seg", F.lit(level)), "at": _key("host", "template")})
        child = settle(here.groupBy("at", "s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        if child.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # A branch point with many values, few pages each, varies: its rare children become one wildcard.
        point = settle(child.groupBy("at").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good")))
        both = spread_join(child, point, "at", ["s"], "inner", point.select("at", F.col("values").alias("n")))
        marked, all_marked = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good")
        share, all_share = F.try_divide("bad", marked), F.try_divide("all_bad", all_marked)
        rest = F.try_divide(F.col("all_bad") - F.col("bad"), all_marked - marked)
        spread = F.sqrt(all_share * (1 - all_share) * (F.try_divide(F.lit(1.0), marked) + F.try_divide(F.lit(1.0), all_marked - marked)))
        alike = (marked == 0) | (all_marked == marked) | (F.abs(share - rest) <= options.z * spread)
        varies = (F.col("values") >= options.fan_out) & (F.col("values") >= options.ratio * F.col("all_n"))
        several = (F.col("values") > 1) & alike & (marked > 0)
        wild = settle(both.filter((varies & alike) | several).select(_key("at", "s").alias("edge"), F.lit(True).alias("wild")))
        tree = spread_join(here.withColumn("edge", _key("at", "s")), wild, "edge", ["path"])
        step = F.concat(F.lit("/"), F.when(F.col("wild"), "*").otherwise(F.col("s")))
        live = settle(tree.withColumn("template", F.concat("template", step)).drop("s", "at", "edge", "wild"))
        level += 1


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, labels: DataFrame | None = None, options: TreeOptions = TreeOptions()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. ``labels``: (page_id, bad 0 or 1); none: the rules label."""
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if labels is None:
        labelled = rows.withColumn("bad", F.when(verdict == "block", 1).when(verdict == "allow", 0))
    else:
        marks = labels.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad"))
        labelled = rows.join(marks, F.col("page_id") == F.col("_id"), "left")
    paths = labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good"))
    paths = settle(paths)
    tree = path_templates(paths, options)
    total = paths.agg(F.sum("bad"), F.sum("good")).first()
    prior = ((total[0] or 0) + 0.5) / ((total[0] or 0) + (total[1] or 0) + 1)
    leaf = settle(tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")))
    site = leaf.groupBy("host").agg(((F.sum("bad") + options.pages * prior) / (F.sum("bad") + F.sum("good") + options.pages)).alias("site"), F.count(F.lit(1)).alias("n"))
    site = settle(site)
    met = spread_join(leaf, site.drop("n"), "host", ["template"], "inner", site.select("host", "n"))
    smoothed = (F.col("bad") + options.pages * F.col("site")) / (F.col("bad") + F.col("good") + options.pages)
    purity = settle(met.select(_key("host", "template").alias("leaf_key"), smoothed.alias("purity"), (F.col("bad") + F.col("good")).alias("marked"), "n"))
    leaves = tree.select("host", "path", "template", _key("host", "template").alias("leaf_key"))
    of_path = spread_join(leaves, purity.drop("n"), "leaf_key", ["path"], "inner", purity.select("leaf_key", "n"))
    of_path = settle(of_path.select(_key("host", "path").alias("url_key"), "template", "purity", "marked"))
    judged = spread_join(rows.withColumn("url_key", _key("host", "path")), of_path, "url_key", ["page_id"], sizes=paths.select(_key("host", "path").alias("url_key"), "n"))
    by_template = F.when((F.col("host") != "") & (F.col("marked") >= options.labels) & (F.col("purity") >= options.reject), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_template).alias("verdict"), "template", "purity")
