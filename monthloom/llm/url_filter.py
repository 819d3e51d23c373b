"""URL filtering by rules and by a tree of path templates.

Rules come first: the longest that fits decides. All other urls are judged by the template
their path belongs to. Templates are the nodes of a tree per host, built from the top:

1. Segments that are numbers or codes become shapes (`{n}`, `{x}`), file endings stay.
2. At each node, children that are many and each rare are one wildcard.
3. Children that continue alike are merged: the Bhattacharyya coefficient of what follows
   them must reach `ALIKE`. Children of the same kind of labels (mostly blocked, mixed, mostly
   allowed) are compared with each other, those without labels with all. In order, labelled
   and large ones first, each goes to the pivot it is most alike (of equal ones the first) or
   becomes a pivot.
4. A template is rejected if its share of blocked labels, smoothed by `PRIOR_WEIGHT`
   labels at the overall share, reaches `REJECT`. Without labels it is not.

Labels are the verdicts of the rules. The tree is built on distinct shaped paths with their
counts; only the first `DEPTH` segments make nodes, the rest of a path is one wildcard.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and
is allowed; repeated rows are judged once per row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.session import stage

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DEPTH = 4
MANY_CHILDREN = 20
RARE_SHARE = 0.05
ALIKE = 0.9
PRIOR_WEIGHT = 2.0
REJECT = 0.7
ANY = "*"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _UPPER.lower()), F.regexp_extract(after, "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule; of equally long ones the first by text. Null: none fits."""
    fitting = []
    for _, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        fitting.append(F.when(fits, F.lit(text)))
    return F.coalesce(*fitting, F.lit(None).cast("string"))


def shaped(segment: Column) -> Column:
    """Numbers and codes of eight or more characters with a digit as shapes."""
    code = r"^(?=[0-9A-Za-z_-]*[0-9])[0-9A-Za-z_-]{8,}(?=(\.[A-Za-z]{1,5})?$)"
    return F.regexp_replace(F.regexp_replace(segment, r"^[0-9]+(?=(\.[A-Za-z]{1,5})?$)", "{n}"), code, "{x}")


def segments(path: Column) -> Column:
    parts = F.transform(F.array_remove(F.split(path, "/"), ""), shaped)
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit(ANY)))).otherwise(parts)


def _label_kind(bad: Column, good: Column) -> Column:
    share = bad / (bad + good)
    return (
        F.when(bad + good == 0, 0).when(share >= 0.8, 1).when(share <= 0.2, 2).otherwise(3)
    )


def _place() -> Column:
    """The order in which children become pivots: labelled ones first, then by size."""
    return F.struct((F.col("kind") == 0).alias("bare"), (-F.col("n")).alias("less"), F.col("child").alias("name"))


def _groups(children: Column) -> Column:
    """(child, pivot) of a node's children in order: each goes to the pivot it is most alike,
    or else is a pivot itself."""
    none = F.array().cast("array<struct<child:string,pivot:string>>")

    def step(groups, x):
        pivots = F.transform(F.filter(groups, lambda g: g["child"] == g["pivot"]), lambda g: g["pivot"])
        near = F.filter(x["near"], lambda c: F.array_contains(pivots, c["pivot"]))
        pivot = F.coalesce(F.get(near, F.lit(0))["pivot"], x["child"])
        return F.concat(groups, F.array(F.struct(x["child"].alias("child"), pivot.alias("pivot"))))

    return F.aggregate(children, none, step)


def _grow(paths: DataFrame, level: int) -> DataFrame:
    """`paths` with the segment at `level` generalised or merged in its node."""
    here = (
        paths.where(F.size("now") > level)
        .withColumn("node", F.array_join(F.slice("now", 1, level), "/"))
        .withColumn("child", F.get("now", F.lit(level)))
        .withColumn("rest", F.array_join(F.slice("now", level + 2, DEPTH + 1), "/"))
    )
    key = ["host", "node"]
    children = here.groupBy(*key, "child").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    nodes = children.groupBy(*key).agg(F.sum("n").alias("all"), F.count("*").alias("many"))
    children = stage(
        children.join(nodes, key).select(
            *key,
            "child",
            "n",
            _label_kind(F.col("bad"), F.col("good")).alias("kind"),
            F.when((F.col("many") > MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all")), F.lit(ANY))
            .otherwise(F.col("child"))
            .alias("name"),
        )
    )
    named = children.where(F.col("name") != ANY)
    follows = (
        here.groupBy(*key, "child", "rest")
        .agg(F.sum("n").alias("m"))
        .join(named, [*key, "child"])
        .select(*key, "rest", "child", F.col("m") / F.col("n"), _place().alias("place"), "kind")
        .toDF(*key, "rest", "child", "share", "place", "kind")
    )
    before = follows.toDF(*key, "rest", "pivot", "pivot_share", "pivot_place", "pivot_kind")
    # A node has few named children, so a rest has few holders.
    near = (
        follows.join(before, [*key, "rest"])
        .where((F.col("pivot_place") < F.col("place")) & ((F.col("kind") == 0) | (F.col("kind") == F.col("pivot_kind"))))
        .groupBy(*key, "child", "pivot")
        .agg(F.sum(F.sqrt(F.col("share") * F.col("pivot_share"))).alias("alike"), F.min("pivot_place").alias("pivot_place"))
        .where(F.col("alike") >= ALIKE)
        .groupBy(*key, "child")
        .agg(F.sort_array(F.collect_list(F.struct((-F.round("alike", 9)).alias("far"), "pivot_place", "pivot"))).alias("near"))
    )
    alike = (
        named.join(near, [*key, "child"], "left")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct(_place().alias("place"), "child", "near"))).alias("children"))
        .select(*key, F.explode(_groups(F.col("children"))).alias("group"))
        .select(*key, "group.child", "group.pivot")
        .where("child != pivot")
    )
    # A merged branch is named after its pivot.
    renamed = children.join(alike, [*key, "child"], "left").select(
        *key, "child", F.coalesce("pivot", "name").alias("new")
    )
    grown = here.join(renamed, [*key, "child"]).select(
        "host",
        "shape",
        "n",
        "bad",
        "good",
        F.concat(
            F.slice("now", 1, level), F.array("new"), F.slice("now", level + 2, DEPTH + 1)
        ).alias("now"),
    )
    done = paths.where(F.size("now") <= level).select(*grown.columns)
    return stage(grown.unionByName(done))


def templates(urls: DataFrame) -> DataFrame:
    """From rows (host, shape, verdict or null): one row per shaped path of a host with its
    template, the labels of the template and the verdict."""
    label = lambda v: F.sum((F.coalesce(F.col("verdict"), F.lit("")) == v).cast("long"))
    paths = stage(
        urls.groupBy("host", "shape").agg(
            F.count("*").alias("n"), label("block").alias("bad"), label("allow").alias("good")
        )
    ).withColumn("now", F.array_remove(F.split("shape", "/"), ""))
    total = paths.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    prior = (total["bad"] or 0) / max(1, (total["bad"] or 0) + (total["good"] or 0))
    deepest = paths.agg(F.max(F.size("now"))).first()[0] or 0
    for level in range(min(DEPTH, deepest)):
        paths = _grow(paths, level)
    paths = paths.withColumn("template", F.concat(F.lit("/"), F.array_join("now", "/")))
    sums = paths.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    purity = (F.col("bad") + PRIOR_WEIGHT * prior) / (F.col("bad") + F.col("good") + PRIOR_WEIGHT)
    judged = sums.withColumn("blocked_share", purity).withColumn(
        "template_verdict",
        F.when((F.col("bad") > 0) & (purity >= REJECT), "block").otherwise("allow"),
    )
    return paths.select("host", "shape", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page row: `page_id`, `host`, `path`, `rule`, `verdict`, `template`,
    `blocked_share`."""
    host, path = host_and_path(F.col("url"))
    verdicts = F.create_map(*(F.lit(x) for verdict, text in rules for x in (text, verdict)))
    urls = (
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("verdict", F.element_at(verdicts, F.col("rule")))
        .withColumn("shape", F.array_join(segments(F.col("path")), "/"))
    )
    found = stage(templates(urls))
    return urls.join(found, ["host", "shape"], "left").select(
        F.col("page_id").alias(page_id),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "template_verdict", F.lit("allow")).alias("verdict"),
        "template",
        "blocked_share",
    )


def op9_path_template_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
