"""Hard negatives by a multiway hyperplane tree with sibling ranges.

The score of two rows is the inner product of their whole-number vectors. All rows are lifted
onto a sphere of radius M (the largest norm) by one more component, so that for an anchor a of
the flat space |a - x|^2 = |a|^2 + M^2 - 2 score: a window of scores is a ring of distances
around the anchor. A node of the tree has up to `FAN` split points; a row goes to the nearest
one, and for every pair (split point, sibling subtree) the least and largest distance is kept,
over all rows. A subtree is skipped when its range from any split point does not meet the
range which the ring allows. Leaves are compared exactly, in whole numbers.

Split points come from a sample of at most `SAMPLE` rows; every row is placed. A tree has at
most about `LEAVES` leaves whatever the input; the rows of a leaf are dealt into chunks of
about `CHUNK` by a hash of their id, and the anchors that search a chunk into groups of about
`GROUP`, so a leaf that holds a third of all rows (one very common vector), or that all
anchors search, is many tasks. An anchor first searches the leaf it lies in: its fifth best
row there bounds the ring of the second search.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part, nor do rows with a null id, which could not be named; rows that agree in id, label and
vector count once, and rows that share an id otherwise are rows of their own, but never
positives of each other; components that a shorter vector lacks count as zero; an anchor without
positives, or a positive without negatives in its window, has no rows (a window under a
negative positive score is empty). Products that would not fit 64 bits are an error. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.session import stage

SCALE = 256
EVERY = 100
KEEP = 5
LOW, HIGH = 80, 100

FAN = 8
SAMPLE = 8192
LEAF = 1024
LEAVES = 4096
CHUNK = 8192
GROUP = 1024
SLICE = 128
#: Bounds of an open window; scores stay below.
OPEN = 2**62


class Tree:
    """Split points, children (a node, or ~leaf) and the ranges of distances, by node."""

    def __init__(self, sample: np.ndarray, radius: int, leaves: int):
        self.width, self.radius = sample.shape[1], float(radius)
        self.points: list[np.ndarray] = []
        self.kids: list[list[int]] = []
        self.leaves = 0
        lifted = self.lift(sample, (sample * sample).sum(axis=1))
        self.root = self._grow(lifted, leaves)
        self.low = np.full((len(self.points), FAN, FAN), np.inf)
        self.high = np.full((len(self.points), FAN, FAN), -np.inf)

    def lift(self, x: np.ndarray, square: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.radius - square, 0.0))])

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        chosen = self._spread(x, min(FAN, leaves)) if leaves > 1 and len(x) >= 2 * FAN else []
        if len(chosen) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        own, points = len(self.points), x[chosen]
        self.points.append(points)
        self.kids.append([])
        nearest = np.argmin(self._gaps(x, points), axis=1)
        for c in range(len(chosen)):
            part = x[nearest == c]
            self.kids[own].append(self._grow(part, round(leaves * len(part) / len(x))))
        return own

    def _spread(self, x: np.ndarray, count: int) -> list[int]:
        """Points far from each other, one after the other; fewer if the rest coincide."""
        chosen = [0]
        gap = self._gaps(x, x[:1])[:, 0]
        while len(chosen) < count and gap.max() > self.slack():
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, self._gaps(x, x[chosen[-1:]])[:, 0])
        return chosen

    def _gaps(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.radius - 2 * (x @ points.T), 0.0))

    def slack(self) -> float:
        """More than the rounding of a distance, which is worst near zero."""
        return 1e-5 * (1.0 + self.radius**0.5)

    def place(self, x: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The leaf of each row; widens `low` and `high`, shaped like the tree's ranges."""
        lifted = self.lift(x, square)
        at = np.full(len(x), self.root, dtype=np.int32)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                rows = np.flatnonzero(at == node)
                gaps = self._gaps(lifted[rows], self.points[node])
                nearest = np.argmin(gaps, axis=1)
                for c in np.unique(nearest):
                    mine, m = gaps[nearest == c], gaps.shape[1]
                    low[node, :m, c] = np.minimum(low[node, :m, c], mine.min(axis=0))
                    high[node, :m, c] = np.maximum(high[node, :m, c], mine.max(axis=0))
                at[rows] = np.array(self.kids[node], dtype=np.int32)[nearest]
        return ~at

    def search(self, anchor: np.ndarray, square: int, low: np.ndarray, high: np.ndarray) -> list[int]:
        """Leaves that may hold a row with a score in any window [low, high]."""
        far = np.sqrt(np.maximum(square + self.radius - 2.0 * low, 0.0))[:, None, None]
        near = np.sqrt(np.maximum(square + self.radius - 2.0 * high, 0.0))[:, None, None]
        found, open_nodes, slack = [], [self.root], self.slack() + 1e-5 * square**0.5
        while open_nodes:
            node = open_nodes.pop()
            if node < 0:
                found.append(~node)
                continue
            points = self.points[node]
            own = np.sqrt(np.maximum(square + self.radius - 2 * (points[:, :-1] @ anchor), 0.0))[None, :, None]
            m = len(points)
            least, most = self.low[node, :m, :m][None], self.high[node, :m, :m][None]
            meets = (least <= own + far + slack) & (most >= np.maximum(own - far, near - own) - slack)
            open_nodes.extend(self.kids[node][c] for c in np.flatnonzero(meets.all(axis=1).any(axis=0)))
        return found


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one int64 array, filled up with zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), dtype=np.int64)
    if len(flat) == out.size:
        return flat.astype(np.int64).reshape(out.shape)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _once(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Places of rows in the order of their ids, one of each set of equal rows."""
    order = np.argsort(ids, kind="stable")
    again = np.zeros(len(order), dtype=bool)
    again[1:] = ids[order][1:] == ids[order][:-1]
    if again.any():
        seen, keep = set(), np.ones(len(order), dtype=bool)
        shared = again.copy()
        shared[:-1] |= again[1:]
        for k in np.flatnonzero(shared):
            row = (ids[order[k]], labels[order[k]], vectors[order[k]].tobytes())
            keep[k] = row not in seen
            seen.add(row)
        order = order[keep]
    return order


def _whole_task(scale):
    def task(batches):
        for batch in batches:
            lists = batch.column(2)
            known = np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid())
            known &= np.asarray(batch.column(1).is_valid())
            batch = batch.take(pa.array(np.flatnonzero(known)))
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row, weights=~np.isfinite(values), minlength=len(size)) == 0
            values = np.floor(scale * values[good[row]])
            if np.abs(values).max(initial=0) >= 2**31:
                raise ValueError("A component does not fit 32 bits after scaling.")
            batch, size = batch.take(pa.array(np.flatnonzero(good))), size[good]
            start = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            whole = pa.ListArray.from_arrays(start, pa.array(values.astype(np.int32)))
            x = _matrix(whole, int(size.max(initial=0)))
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = pa.array(_once(ids, labels, x))
            out = [batch.column(0), batch.column(1), whole, pa.array((x * x).sum(axis=1)), pa.array(size)]
            most = pa.array(np.abs(x).max(axis=1, initial=0))
            yield pa.record_batch(
                [c.take(order) for c in [*out, most]], names=["id", "label", "v", "square", "size", "most"]
            )

    return task


_PLACED = (
    "leaf int, id long, label long, v array<int>, square long, "
    "node int, point int, kid int, low double, high double"
)


def _place_task(tree, width):
    def task(batches):
        t = tree.value
        low, high = np.full_like(t.low, np.inf), np.full_like(t.high, -np.inf)
        for batch in batches:
            x = _matrix(batch.column(2), width).astype(np.float64)
            leaf = t.place(x, batch.column(3).to_numpy(zero_copy_only=False), low, high)
            none = [pa.nulls(len(leaf), pa.int32())] * 3 + [pa.nulls(len(leaf), pa.float64())] * 2
            yield pa.record_batch(
                [pa.array(leaf), *(batch.column(i) for i in range(4)), *none],
                names=["leaf", "id", "label", "v", "square", "node", "point", "kid", "low", "high"],
            )
        node, point, kid = np.nonzero(low <= high)
        n = len(node)
        yield pa.record_batch(
            [
                *(pa.nulls(n, x) for x in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())),
                *(pa.array(x.astype(np.int32)) for x in (node, point, kid)),
                pa.array(low[node, point, kid]),
                pa.array(high[node, point, kid]),
            ],
            names=["leaf", "id", "label", "v", "square", "node", "point", "kid", "low", "high"],
        )

    return task


def _route_task(tree, width, skip_home):
    """Adds the leaves an anchor has to search, by its windows."""

    def task(batches):
        t = tree.value
        for batch in batches:
            x = _matrix(batch.column(3), width).astype(np.float64)
            square, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            leaves = []
            for k, (low, high) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist())):
                low, high = np.array(low, dtype=np.float64), np.array(high, dtype=np.float64)
                some = low <= high
                found = t.search(x[k], int(square[k]), low[some], high[some]) if some.any() else []
                leaves.append([f for f in found if not (skip_home and f == home[k])])
            yield pa.record_batch(
                [*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"]
            )

    return task


_QUERY = "key long, id long, label long, v array<int>, square long, home int, low array<long>, high array<long>"


def _compare_task(width, same, keep, exact_floats):
    """The best `keep` rows of a chunk in each window of each anchor of a group."""
    kind = np.float64 if exact_floats else np.int64

    def best(score, ids, low, high):
        order = np.argsort(-score, kind="stable")  # rows are in the order of their ids
        sorted_score = score[order]
        for slot, (a, b) in enumerate(zip(low, high)):
            first = np.searchsorted(-sorted_score, -b)
            part = order[first : first + keep]
            part = part[score[part] >= a]
            yield slot, ids[part], score[part]

    def task(key, queries, rows):
        label = rows.column("label").to_numpy()
        ids = rows.column("id").to_numpy()
        x = _matrix(rows.column("v").combine_chunks(), width)
        order = _once(ids, label, x)
        ids, label, x = ids[order], label[order], x[order].astype(kind).T
        out = [[], [], [], []]
        for at in range(0, queries.num_rows, SLICE):
            part = queries.slice(at, SLICE)
            scores = _matrix(part.column("v").combine_chunks(), width).astype(kind) @ x
            own = part.select(["key", "id", "label", "low", "high"]).to_pylist()
            for q, score in zip(own, scores):
                fits = ((label == q["label"]) & (ids != q["id"])) if same else label != q["label"]
                fits &= (score >= min(q["low"])) & (score <= max(q["high"]))
                fits = np.flatnonzero(fits)
                for slot, found, s in best(score[fits], ids[fits], q["low"], q["high"]):
                    out[0].append(np.full(len(found), q["key"]))
                    out[1].append(np.full(len(found), slot, dtype=np.int32))
                    out[2].append(found)
                    out[3].append(s.astype(np.int64))
        kinds = (np.int64, np.int32, np.int64, np.int64)
        columns = [np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(out, kinds)]
        return pa.table([pa.array(c) for c in columns], names=["key", "slot", "found", "score"])

    return task


def _compare(queries: DataFrame, rows: DataFrame, task) -> DataFrame:
    """Anchors meet the chunks of the leaves they search; `queries` has a `leaf` a row."""
    asked = {r["leaf"]: r["count"] for r in queries.groupBy("leaf").count().collect()}
    held = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    sizes = queries.sparkSession.createDataFrame(
        [(leaf, -(-held[leaf] // CHUNK), -(-n // GROUP)) for leaf, n in asked.items() if leaf in held],
        "leaf int, chunks int, groups int",
    )
    sizes = F.broadcast(sizes)  # a row per leaf of the tree, whose number is bounded
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    dealt = lambda column, count: F.pmod(F.xxhash64(column), F.col(count)).cast("int")
    left = queries.join(sizes, "leaf").withColumn("group", dealt("key", "groups")).withColumn("chunk", every("chunks"))
    right = rows.join(sizes, "leaf").withColumn("chunk", dealt("id", "chunks")).withColumn("group", every("groups"))
    own = ["leaf", "chunk", "group"]
    return (
        left.select(*own, "key", "id", "label", "v", "low", "high")
        .groupBy(*own)
        .cogroup(right.select(*own, "id", "label", "v").groupBy(*own))
        .applyInArrow(task, "key long, slot int, found long, score long")
    )


def _ranked(found: DataFrame, keep: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    every: int = EVERY, keep: int = KEEP, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor (id divisible by `every`) and each of its `keep` best rows of the same label, the
    `keep` best rows of other labels between `low` and `high` hundredths of that score."""
    spark = vectors.sparkSession
    raw = vectors.select(
        F.col(id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    kept = stage(
        raw.mapInArrow(
            _whole_task(scale), "id long, label long, v array<int>, square long, size long, most long"
        )
    )
    total, radius, width, most = kept.agg(
        F.count("*"), F.max("square"), F.max("size"), F.max("most")
    ).first()
    width = max(width or 0, 1)
    if 100 * width * (most or 0) ** 2 >= 2**62:
        raise ValueError("Products of these vectors do not fit 64 bits.")
    drawn = kept if total <= SAMPLE else kept.sample(min(1.0, 2 * SAMPLE / total), seed=7)
    sample = [r["v"] for r in drawn.select("v").limit(SAMPLE).collect()]
    points = np.zeros((len(sample), width))
    for k, v in enumerate(sample):
        points[k, : len(v)] = v
    tree = Tree(points, radius or 0, min(LEAVES, -(-total // LEAF)))
    empty = spark.sparkContext.broadcast(tree)
    placed = stage(
        kept.select("id", "label", "v", "square").mapInArrow(_place_task(empty, width), _PLACED)
    )
    ranges = placed.where("node is not null").groupBy("node", "point", "kid")
    for r in ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[r["node"], r["point"], r["kid"]] = r["low"]
        tree.high[r["node"], r["point"], r["kid"]] = r["high"]
    known = spark.sparkContext.broadcast(tree)
    rows = placed.where("node is null").select("leaf", "id", "label", "v", "square")
    anchors = stage(
        rows.where(F.col("id") % every == 0)
        .dropDuplicates(["id", "label", "v"])
        .select(F.monotonically_increasing_id().alias("key"), "id", "label", "v", "square", F.col("leaf").alias("home"))
    )
    exact = width * (most or 0) ** 2 < 2**53
    same, other = (_compare_task(width, x, keep, exact) for x in (True, False))

    def windows(frame, lows, highs):
        return frame.select("key", "id", "label", "v", "square", "home", lows.alias("low"), highs.alias("high"))

    def routed(frame, skip_home=False):
        found = frame.mapInArrow(_route_task(known, width, skip_home), f"{_QUERY}, leaves array<int>")
        return stage(found.withColumn("leaf", F.explode("leaves")).drop("leaves"))

    everything = windows(anchors, F.array(F.lit(-OPEN)), F.array(F.lit(OPEN)))
    near = stage(_compare(everything.withColumn("leaf", F.col("home")), rows, same))
    bound = near.groupBy("key").agg(
        F.when(F.count("*") >= keep, F.min("score")).otherwise(F.lit(-OPEN)).alias("bound")
    )
    bounded = anchors.join(bound, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(-OPEN)))
    searched = routed(windows(bounded, F.array("bound"), F.array(F.lit(OPEN))), skip_home=True)
    positives = stage(
        _ranked(near.unionByName(_compare(searched, rows, same)), keep, "key").select(
            "key", "rank", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")
        )
    )
    tops = positives.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("tops"))
    above = F.transform("tops", lambda t: t["positive_score"])
    # Least whole score that is not under `low` hundredths.
    hundred = F.lit(100).cast("decimal(3,0)")
    under = F.transform(above, lambda s: F.ceil(F.lit(low) * s / hundred).cast("long"))
    over = F.transform(above, lambda s: F.floor(F.lit(high) * s / hundred).cast("long"))
    asked = routed(windows(anchors.join(tops, "key"), under, over))
    found = _ranked(_compare(asked, rows, other), keep, "key", "slot").withColumnRenamed("rank", "place")
    named = positives.join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    named = named.select("key", (F.col("rank") - 1).alias("slot"), "anchor_id", "positive_id", "positive_score")
    return found.join(named, ["key", "slot"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hyperplane_tree_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")))


ORACLE = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a, r WHERE a.vec_id % {EVERY} = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {KEEP}),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {KEEP}
"""
