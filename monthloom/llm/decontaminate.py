"""Benchmark decontamination by winnowing.

A document shares a passage with a benchmark item when a run of `span` consecutive item
words occurs in it. Of every text only few fingerprints are kept: the smallest hash of each
`span - gram + 1` consecutive `gram`-word runs. Any shared run of `span` words then shares
a fingerprint, so joining fingerprints loses nothing. Documents that share one are read
again and the hits are extended over whole runs, with all their words compared by hash.

An item of fewer words than `span` is one run as a whole. For each such length that occurs
in the benchmark the same scheme is applied with that length as the span.

Defined cases: a null or empty text has no words, is never hit and hits nothing; items
without words are ignored; an item text given twice counts under each of its ids; a
document id that occurs on several rows is judged row by row (`row` keeps them apart).
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm import words
from monthloom.session import stage

SPAN = 10
GRAM = 5


def scheme(length: int) -> tuple[int, int, int]:
    """(span, words in a hashed run, runs in a window): the guarantee is exactly `length`."""
    gram = min(GRAM, length)
    return length, gram, length - gram + 1


def _winnow(hashes, doc, plan):
    """Smallest run hash of each window, without direct repeats, and the document."""
    span, gram, window = plan
    values, first = words.runs(hashes, doc, gram)
    owner = doc[first]
    count = len(values) - window + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    least = values[:count].copy()
    for k in range(1, window):
        np.minimum(least, values[k : k + count], out=least)
    whole = owner[:count] == owner[window - 1 :]
    least, owner = least[whole], owner[:count][whole]
    if len(least):
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        least, owner = least[new], owner[new]
    return words.mix(least + np.uint64(span)), owner


def _fingerprints(plans):
    def task(batches):
        for batch in batches:
            for a, b in words.slices(batch.column(1)):
                w = words.cut(batch.column(1), a, b, words.ALPHANUMERIC)
                hashes = w.hashes()
                found = [_winnow(hashes, w.doc, plan) for plan in plans]
                value = np.concatenate([x for x, _ in found])
                owner = np.concatenate([x for _, x in found])
                order = np.argsort(owner, kind="stable")
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        words.lists(owner[order], words.signed(value[order]), b - a),
                    ],
                    names=["id", "prints"],
                )

    return task


def _windows(lengths):
    """Rows (id, n_words, candidate windows as parallel lists of hash, place, length)."""

    def task(batches):
        for batch in batches:
            wanted = np.asarray(batch.column(2).is_valid())
            for a, b in words.slices(batch.column(1)):
                w = words.cut(batch.column(1), a, b, words.ALPHANUMERIC)
                count = w.counts()
                first_word = np.cumsum(count) - count
                keep = wanted[a:b][w.doc]
                hashes, doc = w.hashes()[keep], w.doc[keep]
                place = (np.arange(len(w.doc)) - first_word[w.doc])[keep]
                value, owner, at, size = [], [], [], []
                for length in lengths:
                    run, first = words.runs(hashes, doc, length)
                    value.append(words.mix(run + np.uint64(length)))
                    owner.append(doc[first])
                    at.append(place[first])
                    size.append(np.full(len(run), length, dtype=np.int32))
                owner = np.concatenate(owner)
                order = np.argsort(owner, kind="stable")
                owner = owner[order]
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(words.signed(np.concatenate(value)[order])),
                        pa.array(np.concatenate(at)[order]),
                        pa.array(np.concatenate(size)[order]),
                    ],
                    names=["window", "place", "size"],
                )
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(count),
                        words.lists(owner, spans, b - a),
                    ],
                    names=["id", "n_words", "spans"],
                )

    return task


def _item_windows(span):
    def task(batches):
        for batch in batches:
            for a, b in words.slices(batch.column(1)):
                w = words.cut(batch.column(1), a, b, words.ALPHANUMERIC)
                hashes, count = w.hashes(), w.counts()
                value, owner, size = [], [], []
                for length in np.unique(np.minimum(count[count > 0], span)).tolist():
                    mine = (np.minimum(count, span) == length)[w.doc]
                    run, first = words.runs(hashes[mine], w.doc[mine], length)
                    value.append(words.mix(run + np.uint64(length)))
                    owner.append(w.doc[mine][first])
                    size.append(np.full(len(run), length, dtype=np.int32))
                if value:
                    owner = np.concatenate(owner)
                    yield pa.record_batch(
                        [
                            batch.column(0).slice(a, b - a).take(pa.array(owner)),
                            pa.array(words.signed(np.concatenate(value))),
                            pa.array(np.concatenate(size)),
                        ],
                        names=["item", "window", "size"],
                    )

    return task


def shared_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", span: int = SPAN,
) -> DataFrame:
    """One row per document row: `doc_id`, `n_words`, `n_hit` (words inside any shared run),
    `n_items`, `items` (ids as sorted strings) and `spans` (hit runs as [start, end) words)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    targets = stage(
        words.map_arrow(items, _item_windows(span), "item string, window long, size int").distinct()
    )
    # At most `span` lengths, whatever the benchmark holds.
    lengths = sorted(r["size"] for r in targets.select("size").distinct().collect())
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = keyed.schema["id"].dataType.simpleString()
    lengths = lengths or [span]
    plans = [scheme(x) for x in lengths]
    prints = f"id {id_type}, prints array<long>"
    item_prints = stage(
        words.map_arrow(
            items.select(F.lit(0).alias("id"), "text"), _fingerprints(plans), "id int, prints array<long>"
        )
        .select(F.explode("prints").alias("mark"))
        .distinct()
    )
    candidates = stage(
        words.map_arrow(keyed, _fingerprints(plans), prints)
        .select("id", F.explode("prints").alias("mark"))
        .join(item_prints, "mark", "left_semi")
        .select("id")
        .distinct()
    )
    marked = keyed.join(
        candidates.select("id", F.lit(True).alias("wanted")), keyed["id"].eqNullSafe(candidates["id"]), "left"
    ).select(keyed["id"], "text", "wanted")
    found = stage(
        words.map_arrow(
            marked,
            _windows(lengths),
            f"id {id_type}, n_words long, "
            "spans array<struct<window:long,place:long,size:int>>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    hits = (
        found.select("row", F.explode("spans").alias("s"))
        .select("row", "s.*")
        .join(targets, ["window", "size"])
    )
    named = (
        hits.groupBy("row", "item")
        .agg(F.lit(1))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    before = Window.partitionBy("row").orderBy("place", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.groupBy("row", "place")
        .agg((F.col("place") + F.max("size")).alias("end"))
        .withColumn("reached", F.greatest("place", F.coalesce(F.max("end").over(before), F.lit(0))))
        .withColumn("more", F.greatest(F.lit(0), F.col("end") - F.col("reached")))
        .groupBy("row")
        .agg(
            F.sum("more").cast("long").alias("n_hit"),
            F.array_sort(F.collect_list(F.struct("place", "end"))).alias("spans"),
        )
    )
    return (
        found.select("row", "id", "n_words")
        .join(named.join(covered, "row"), "row", "left")
        .select(
            F.col("id").alias(doc_id),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<place:bigint,end:bigint>>")).alias("spans"),
        )
    )


def op7_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shared_passages(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (
  SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM ip),
dp AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (
  SELECT doc_id, i, d.k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp) d
  JOIN win ON win.k = d.k AND win.g = d.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
