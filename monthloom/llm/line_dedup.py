"""Removal of repeated line runs by a suffix array over line ids.

Texts are sequences of lines. Suffixes of all sequences are ranked by distributed prefix
doubling: the rank by one line, then by the ranks of a suffix and of the one 2^k lines on,
so each step sorts on twice as many lines. A rank is an interval of the suffix array whose
suffixes share that prefix. Lines that occur once end every run; only stretches of repeated
lines are ranked, and only as deep as the shortest run that counts is long.

A run counts if it holds `min_words` words. For every suffix the shortest prefix that counts
is looked up in the array by its two ranks (its first and its last power of two, which
overlap), and its interval's first suffix in document order is the original. A suffix that
is not the first is a later copy; it is extended line by line as far as it agrees with the
original, and all those lines are deleted.

Everything is DataFrame functions. Intervals are plain aggregates, so a line that a third of
all documents hold is summed map-side; sorted parts are cut by range, and equal keys meet in
an aggregate before they are sorted.

Document order is by id, then by row. Defined cases: a null text stays null and an empty one
empty; a text without later copies is unchanged, byte for byte; repeated rows are copies of
the first of them; null ids come first; extra columns are kept. Lines are compared by a
64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.arrays import let
from monthloom.session import scratch, stage

MIN_WORDS = 50
_BLANK = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, _BLANK), ""))


def _ranked(keys: DataFrame, names: list[str]) -> DataFrame:
    """Distinct `keys` with `rank`: their place in the order by `names`, from 0.

    The keys are cut into sorted ranges; a range's first rank is the number of keys in the
    ranges before it. Only the ranges' counts, one row per range, are summed together."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(
        keys.repartitionByRange(parts, *names).withColumn("part_", F.spark_partition_id())
    )
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cut.groupBy("part_")
        .agg(F.count("*").alias("n_"))
        .withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
        .drop("n_")
    )
    inside = Window.partitionBy("part_").orderBy(*names)
    return (
        cut.withColumn("place_", F.row_number().over(inside) - 1)
        .join(bases, "part_")
        .select(*names, (F.col("base_") + F.col("place_")).alias("rank"))
    )


def _stretches(lines: DataFrame) -> DataFrame:
    """Repeated lines only, with `block`: stretches of neighbours in a document."""
    repeated = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    kept = lines.join(repeated, "id", "left_semi")
    in_doc = Window.partitionBy("row").orderBy("line")
    return kept.withColumn("block", F.col("line") - F.row_number().over(in_doc))


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Per line of a stretch the `length` of the shortest run from it that counts.

    Borders between lines (at `before` words, and the stretch's end) and wishes (at `before`
    plus the minimum) are sorted together, last first; a wish takes the nearest border."""
    block = ["row", "block"]
    upto = Window.partitionBy(*block).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    wish = placed.select(*block, "line", (F.col("before") + min_words).alias("at"), F.lit(None).cast("int").alias("border"))
    ends = placed.select(
        *block,
        F.lit(None).cast("int").alias("line"),
        (F.col("before") + F.col("words")).alias("at"),
        (F.col("line") + 1).alias("border"),
    )
    nearest = (
        Window.partitionBy(*block)
        .orderBy(F.desc("at"), F.desc_nulls_last("border"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # Of borders at the same count (lines without words between) the first in the text.
    found = wish.unionByName(ends).withColumn("to", F.last("border", ignorenulls=True).over(nearest))
    return found.where("line is not null and to is not null").select(
        "row", "block", "line", (F.col("to") - F.col("line")).alias("length")
    )


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """From rows (key, row, line, id, words): later copies with their original,
    (row, line, length, from_row, from_line)."""
    lines = stage(_stretches(lines))
    runs = stage(_shortest_runs(lines, min_words))
    longest = runs.agg(F.max("length")).first()[0] or 0
    level = _ranked(lines.select("id").distinct(), ["id"])
    ranks = stage(lines.join(level, "id").select("row", "block", "line", "rank", F.lit(0).alias("level")))
    keys = None
    step = 0
    while longest >= 1 << step:
        size = 1 << step
        deep = F.floor(F.log2(F.col("length") + 0.5)).cast("int") == step
        mine = runs.where(deep).join(ranks.select("row", "line", "rank"), ["row", "line"])
        last = ranks.select("row", F.col("line").alias("last"), F.col("rank").alias("rank_last"))
        mine = mine.withColumn("last", F.col("line") + F.col("length") - size).join(last, ["row", "last"])
        mine = stage(mine.select("row", "line", "length", "rank", "rank_last"))
        keys = mine if keys is None else keys.unionByName(mine)
        step += 1
        if longest < 1 << step:
            break
        on = ranks.select("row", "block", (F.col("line") - size).alias("line"), F.col("rank").alias("next"))
        pairs = stage(ranks.select("row", "block", "line", "rank").join(on, ["row", "block", "line"]))
        level = _ranked(pairs.select("rank", "next").distinct(), ["rank", "next"]).toDF("a", "b", "rank")
        ranks = stage(
            pairs.join(level, (pairs["rank"] == F.col("a")) & (pairs["next"] == F.col("b"))).select(
                "row", "block", "line", level["rank"]
            )
        )
    if keys is None:
        return runs.select(
            "row", "line", "length", F.col("row").alias("from_row"), F.col("line").alias("from_line")
        ).limit(0)
    order = lines.select("row", "key").distinct()
    placed = keys.join(order, "row").withColumn("spot", F.struct("key", "row", "line"))
    interval = ["length", "rank", "rank_last"]
    first = placed.groupBy(*interval).agg(F.min("spot").alias("first"))
    return (
        placed.join(first, interval)
        .where(~F.col("spot").eqNullSafe(F.col("first")))
        .select(
            "row", "line", "length", F.col("first.row").alias("from_row"), F.col("first.line").alias("from_line")
        )
    )


def _agreeing(a: Column, b: Column, at_a: Column, at_b: Column) -> Column:
    """Equal elements of `a` from `at_a` and `b` from `at_b` (from 0) before the first difference."""
    left = F.slice(a, at_a + 1, F.greatest(F.lit(0), F.size(a) - at_a))
    right = F.slice(b, at_b + 1, F.greatest(F.lit(0), F.size(b) - at_b))
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def deleted_runs(rows: DataFrame, row: str, key: str, text: str, min_words: int) -> DataFrame:
    """(row, runs): per document the line ranges [from, to) to delete, merged and in order."""
    texts = rows.select(F.col(key).alias("key"), F.col(row).alias("row"), _lines(F.col(text)).alias("t"))
    lines = texts.select("key", "row", F.posexplode("t").alias("line", "value")).select(
        "key", "row", "line", F.xxhash64("value").alias("id"), _line_words(F.col("value")).alias("words")
    )
    copies = stage(later_copies(lines, min_words))
    diagonal = ["row", "from_row", "shift"]
    copies = copies.withColumn("shift", F.col("line") - F.col("from_line"))
    along = Window.partitionBy(*diagonal).orderBy("line")
    ends = copies.withColumn("follows", F.coalesce(F.lead("line").over(along) == F.col("line") + 1, F.lit(False)))
    inner = ends.where("follows").select("row", "line", (F.col("line") + F.col("length")).alias("to"))
    outer = stage(ends.where(~F.col("follows")))
    wanted = stage(outer.select("row").unionByName(outer.select(F.col("from_row").alias("row"))).distinct())
    ids = stage(
        texts.join(wanted, "row", "left_semi").select("row", F.transform("t", lambda x: F.xxhash64(x)).alias("ids"))
    )
    grown = (
        outer.join(ids, "row")
        .join(ids.toDF("from_row", "from_ids"), "from_row")
        .select(
            "row",
            "line",
            (
                F.col("line")
                + F.col("length")
                + _agreeing(
                    F.col("ids"),
                    F.col("from_ids"),
                    F.col("line") + F.col("length"),
                    F.col("from_line") + F.col("length"),
                )
            ).alias("to"),
        )
    )
    spans = inner.unionByName(grown).groupBy("row", "line").agg(F.max("to").alias("to"))
    order = Window.partitionBy("row").orderBy("line")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", (F.col("line") > F.coalesce(reached, F.lit(-1))).cast("int"))
        .withColumn("group", F.sum("new").over(order))
        .groupBy("row", "group")
        .agg(F.min("line").alias("from"), F.max("to").alias("to"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))
    )


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """All rows and columns, `text` without its later copies, and the columns
    `n_lines_deleted` and `runs_deleted` (a column of that name in the input is replaced)."""
    docs = docs.drop("n_lines_deleted", "runs_deleted")
    row, found = "row_", "runs_"
    while row in docs.columns or found in docs.columns:
        row, found = row + "_", found + "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    with scratch(docs.sparkSession) as tables:
        runs = tables.keep(stage(deleted_runs(rows, row, doc_id, text, min_words)))
    runs = runs.toDF(row, found)

    def without(runs_: Column) -> Column:
        kept = F.filter(
            _lines(F.col(text)),
            lambda line, i: ~F.exists(runs_, lambda r: (i >= r["from"]) & (i < r["to"])),
        )
        return F.array_join(kept, "\n")

    count = F.aggregate(found, F.lit(0), lambda n, r: n + r["to"] - r["from"])
    shorter = F.when(F.col(found).isNull(), F.col(text)).otherwise(let(F.col(found), without))
    return rows.join(runs, row, "left").select(
        *(shorter.alias(c) if c == text else F.col(c) for c in docs.columns),
        F.coalesce(count, F.lit(0)).cast("long").alias("n_lines_deleted"),
        F.coalesce(found, F.array().cast("array<struct<from:int,to:int>>")).alias("runs_deleted"),
    )


def op5_suffix_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_lines_deleted",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.array_join(
            F.transform("runs_deleted", lambda r: F.concat_ws(":", r["from"].cast("string"), r["to"].cast("string"))), ","
        ).alias("runs"),
    )
