"""URL filters by a path-template tree.

For every host the paths form a tree of segments. Segments that are visibly variable (numbers, long hexadecimal
strings, dates, words with digits) stand as their shape from the start; below a node with many different children, a child that few paths take
becomes a wildcard. Siblings directly below the host (deeper ones are not merged) whose branches are statistically alike (the same dominant shape below, in the same share
to the nearest quarter, and the same standing of their labels by a Wilson interval) are merged and their labels pooled. A template is rejected
if its smoothed labelled purity, (bad + strength x prior) / (labelled + strength), is over the limit; templates
without labels stay at the prior and are allowed.

Labels are the verdicts of explicit host and path rules, which decide their own urls anyway; other labels can be given instead.

Urls are first aggregated to distinct shaped paths, so the tree is built on those. Verdicts return to
the rows by a join that broadcasts only paths with over 1/256 of all rows and shuffles all others.

Paths are generalised to ``depth`` segments; what lies deeper is one wildcard. Cases: a null url, or one without ``://``, has an empty host and
path, no rule, and is judged by the template of those. Repeated rows are judged alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """text is host and path, as in ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substr(url, found + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        made = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape_of(segment: Column) -> Column:
    """A placeholder for visibly variable segments, else the segment; a file ending stays."""
    stem, end = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5}[0-9]?)?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5}[0-9]?)?$", 2)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "{hex}")
        .when(stem.rlike("[0-9]"), "{mixed}")
    )
    return F.when(kind.isNotNull(), F.concat(kind, end)).otherwise(segment)


def templates(paths: DataFrame, *, depth: int, max_children: int, min_share: float) -> DataFrame:
    """paths(key, host, segments, n, bad, good) with the column template, an array of generalised segments."""
    tree = paths.withColumn("template", F.array().cast("array<string>"))
    for d in range(depth):
        child = F.when(F.size("segments") > d, F.get("segments", F.lit(d)))
        tree = tree.withColumn("child", child)
        children = tree.filter("child is not null").groupBy("host", "template", "child").agg(F.sum("n").alias("taken"))
        parents = children.groupBy("host", "template").agg(F.sum("taken").alias("all"), F.count("*").alias("children"))
        rare = children.join(parents, ["host", "template"]).filter((F.col("children") > max_children) & (F.col("taken") < F.col("all") * min_share))
        rare = rare.select("host", "template", "child", F.lit(True).alias("rare"))
        tree = tree.join(rare, ["host", "template", "child"], "left")
        grown = F.concat("template", F.array(F.when(F.col("rare"), "*").otherwise(F.col("child"))))
        tree = stored(tree.withColumn("template", F.when(F.col("child").isNull(), F.col("template")).otherwise(grown)).drop("child", "rare"), "tree")
    deeper = F.concat("template", F.array(F.lit("**")))
    return tree.withColumn("template", F.when(F.size("segments") > depth, deeper).otherwise(F.col("template")))


def wilson_standing(bad: Column, labelled: Column, z: float = 1.96) -> Column:
    """bad, good or open: whether the interval of the share of bad labels lies above, below or around one half."""
    p = bad / F.greatest(labelled, F.lit(1))
    middle = p + z * z / (2 * F.greatest(labelled, F.lit(1)))
    half = z * F.sqrt(p * (1 - p) / F.greatest(labelled, F.lit(1)) + z * z / (4 * F.greatest(labelled, F.lit(1)) ** 2))
    scale = 1 + z * z / F.greatest(labelled, F.lit(1))
    return F.when(labelled == 0, "open").when((middle - half) / scale > 0.5, "bad").when((middle + half) / scale < 0.5, "good").otherwise("open")


def merged(tree: DataFrame) -> DataFrame:
    """The column branch: the template, or its group of siblings that are alike in shape below and in labels."""
    top = F.coalesce(F.get("template", F.lit(0)), F.lit(""))
    below = F.array_join(F.slice("template", 2, 64), "/")
    t = tree.withColumn("top", top).withColumn("below", below)
    shapes = t.groupBy("host", "top", "below").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tops = shapes.groupBy("host", "top").agg(
        F.max(F.struct("n", "below")).alias("most"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    standing = wilson_standing(F.col("bad"), F.col("bad") + F.col("good"))
    share = F.round(F.col("most.n") / F.col("n") * 4).cast("int")
    # branches without labels prove nothing, so they are alike only to each other
    profile = F.concat_ws(" ", F.lit("~"), standing, F.when(F.col("bad") + F.col("good") == 0, "unlabelled").otherwise("labelled"), share.cast("string"), "most.below")
    return t.join(tops.select("host", "top", profile.alias("branch")), ["host", "top"])


def judge(
    pages: DataFrame,
    rules: list[Rule],
    *,
    depth: int = 4,
    max_children: int = 24,
    min_share: float = 0.02,
    prior: float = 0.25,
    strength: float = 4.0,
    limit: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages(page_id, url, ...)."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), shape_of)
    rows = rows.withColumn("segments", segments).withColumn("key", F.concat_ws("/", "host", F.array_join("segments", "/")))
    rows = stored(rows, "urls")
    bad, good = (F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0)) for v in (BLOCK, ALLOW))
    paths = rows.groupBy("key").agg(F.first("host").alias("host"), F.first("segments").alias("segments"), F.count("*").alias("n"), bad.alias("bad"), good.alias("good"))
    tree = merged(templates(stored(paths, "paths"), depth=depth, max_children=max_children, min_share=min_share))
    pooled = tree.groupBy("host", "branch", "below").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    purity = (F.col("b") + strength * prior) / (F.col("b") + F.col("g") + strength)
    template = F.concat(F.lit("/"), F.array_join("template", "/"))
    verdicts = tree.join(pooled, ["host", "branch", "below"]).select("key", "n", template.alias("template"), purity.alias("purity"))
    out = skew_join(rows.select("page_id", "host", "path", "r", "key"), stored(verdicts, "verdicts"), "key", "n")
    verdict = F.coalesce("r.verdict", F.when(F.col("purity") > limit, BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", "r.rule", verdict.alias("verdict"), "template", "purity")
