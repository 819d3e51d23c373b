"""N-gram Jaccard self-join over count vectors, and its connected groups.

A document is the set of its distinct word shingles. Every shingle is hashed into a group,
and a document becomes the point of its group counts. The shingles two documents share are
at most the sum over the groups of the smaller count, so two documents can only link if
their points are close in the sum of absolute differences.

*Upper level.* The groups are cut into `slices` of neighbouring groups. Documents that link
differ in at most `reach` shingles, and a shingle touches one slice, so of more than `reach`
slices at least one agrees in all its counts. A node of the upper level is one slice with
its exact counts; equality of nodes is a shuffle key, and no link is lost. Sizes are cut into
families, each with its own number of slices; a document enters the family of its size and
that below it if a partner there is possible.

*Fewest nodes.* A document has more slices than `reach`, so it may leave out that many nodes
more (`slack`): linked documents share more nodes than the slack of either. Once the links of the
first step are known, only shared nodes whose documents are in several parts count. In one order of
them, rarest first, a document leaves out as many of its last ones as its slack allows; the first
node that two linked documents share is not among them, so again no link is lost. Documents that
share no more nodes than their slack, such as those with a widespread passage, leave out all.

*Lower level.* First each document is paired with the first one of one of its nodes; nodes whose
documents are joined by these links are done. In an open node the documents outside the largest
part are paired with a few of its documents. What is still apart is searched in an R-tree over
the count vectors, block by block, with the bound above at inner nodes and leaves. Long sets
have more groups, as in few ones all of them look alike. Surviving pairs are verified on the
sets themselves. Pairs inside a found group are not verified again, so a group of copies
costs what it holds, not its square.

Equal sets are one point. Defined cases: null, empty and blank texts have the empty set and
link with nothing; a text of fewer words than a shingle is one shingle; repeated ids are
rows of their own; extra columns are ignored. Shingles are compared by a 54-bit hash, points
by a 64-bit one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm import words
from monthloom.llm.components import components
from monthloom.session import reclaim, scratch, stage

#: Least number of coordinates of the count vectors in the R-tree, and the most shingles for
#: each: with more, all long sets of one size look alike.
GROUPS = 64
CROWD = 8
#: Growth of the size families.
FAMILY_RATIO = 1.5
#: Slices in proportion to the least number that is lossless.
SPARE = 1.35
#: Nodes with fewer further documents are never left out; 1: every node counts for the slack.
FREQUENT = 1
#: Groups for each shingle of a set in the second bound.
COARSE = 8
BLOCK = 512
PIVOTS = 3
#: Ids or pairs up to this number are sent to all tasks; more are joined by a shuffle.
SENT_IDS = 500_000
FANOUT = 16
_VALUE_BITS = np.uint64(54)
_VALUE_MASK = np.uint64(2**54 - 1)


class Families:
    """Size families of a threshold `num`/`den` and their slices."""

    def __init__(self, num: int, den: int):
        low = [1]
        while low[-1] < 2**31:
            low.append(max(low[-1] + 1, int(low[-1] * FAMILY_RATIO)))
        self.low = np.array(low[:-1], dtype=np.int64)
        high = np.array(low[1:], dtype=np.int64) - 1
        self.partner = high * den // num  # the largest size that can link with `high`
        self.reach = (den - num) * (high + self.partner) // (num + den)
        self.slices = np.ceil(SPARE * (self.reach + 1)).astype(np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def shingle_sets(column: pa.Array, a: int, b: int, length: int):
    """Distinct shingles of the rows as 54-bit values, ascending in each row, and the row."""
    w = words.cut(column, a, b, words.NOT_BLANK)
    hashes, count = w.hashes(), w.counts()
    value, first = words.runs(hashes, w.doc, length)
    owner = w.doc[first]
    for few in range(1, length):
        short = (count == few)[w.doc]
        if short.any():
            run, at = words.runs(hashes[short], w.doc[short], few)
            value = np.concatenate([value, run])
            owner = np.concatenate([owner, w.doc[short][at]])
    tagged = (owner.astype(np.uint64) << _VALUE_BITS) | (value >> np.uint64(10))
    tagged = np.unique(tagged)
    return tagged & _VALUE_MASK, (tagged >> _VALUE_BITS).astype(np.int64)


def _point_ids(value, owner, rows):
    total = np.zeros(rows, dtype=np.uint64)
    size = np.bincount(owner, minlength=rows).astype(np.int64)
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        total[owner[starts]] = np.add.reduceat(words.mix(value), starts)
    return words.signed(words.mix(total + size.astype(np.uint64))), size


def _nodes(value, owner, size, family, families):
    """Node keys of the rows in the given family of each row (-1: none), and the slack."""
    use = family[owner] >= 0
    value, owner = value[use], owner[use]
    which = family[owner]
    group = value >> np.uint64(22)
    part = (group * families.slices[which].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(new)
    rows = len(size)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(rows, -1, np.int64)
    content = np.add.reduceat(words.mix(group), starts)
    row, part, which = owner[starts], part[starts], which[starts]
    filled = np.bincount(row, minlength=rows)
    slack = np.where(family >= 0, filled - families.reach[family] - 1, -1)
    # A row without slack enters its empty slices too; they are few, as such rows are small.
    bare = [i for i in np.flatnonzero((family >= 0) & (slack < 0) & (size > 0))]
    for i in bare:
        absent = np.setdiff1d(
            np.arange(families.slices[family[i]], dtype=np.uint64), part[row == i]
        )
        content = np.concatenate([content, np.zeros(len(absent), dtype=np.uint64)])
        part = np.concatenate([part, absent])
        row = np.concatenate([row, np.full(len(absent), i)])
        which = np.concatenate([which, np.full(len(absent), family[i])])
    key = words.mix(content + words.mix(part + np.uint64(1)))
    key = (key << np.uint64(6)) | which.astype(np.uint64)
    return words.signed(key), row, slack


def _both_families(size, families):
    own = np.where(size > 0, families.of(np.maximum(size, 1)), -1)
    below = own - 1
    reached = (below >= 0) & (size <= families.partner[np.maximum(below, 0)])
    return own, np.where(reached, below, -1)


def _vectors(value, owner, size) -> list[bytes]:
    """Group counts of each set, in a power of two of groups that grows with its size."""
    ends = np.cumsum(size)
    found = []
    for end, n in zip(ends.tolist(), size.tolist(), strict=True):
        groups = GROUPS
        while groups * CROWD < n:
            groups *= 2
        place = (value[end - n : end] % np.uint64(groups)).astype(np.int64)
        found.append(np.bincount(place, minlength=groups).astype(np.int32).tobytes())
    return found


def _points(length, families):
    def task(batches):
        for batch in batches:
            column = batch.column(1)
            for a, b in words.slices(column):
                value, owner = shingle_sets(column, a, b, length)
                ids, size = _point_ids(value, owner, b - a)
                slack = [
                    _nodes(value, owner, size, f, families)[2]
                    for f in _both_families(size, families)
                ]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(ids),
                        pa.array(size),
                        pa.array(slack[0]),
                        pa.array(slack[1]),
                        pa.array(_vectors(value, owner, size), type=pa.binary()),
                    ],
                    names=["id", "point", "size", "slack_own", "slack_below", "counts"],
                )

    return task


def _node_rows(length, families):
    """Rows (node, point). A task gives the nodes of equal sets once, as far as it remembers."""

    def task(batches):
        seen: set[int] = set()
        for batch in batches:
            column = batch.column(0)
            for a, b in words.slices(column):
                value, owner = shingle_sets(column, a, b, length)
                ids, size = _point_ids(value, owner, b - a)
                if len(seen) > 200_000:
                    seen.clear()
                fresh = np.zeros(b - a, dtype=bool)
                for i, point in enumerate(ids.tolist()):
                    if point not in seen:
                        seen.add(point)
                        fresh[i] = True
                for family in _both_families(size, families):
                    key, row, _ = _nodes(value, owner, size, np.where(fresh, family, -1), families)
                    yield pa.record_batch([pa.array(key), pa.array(ids[row])], names=["node", "point"])

    return task


def _members(batches):
    """From rows sorted by (node, point): (node, point, first) for every further point."""
    node = first = last = None
    for batch in batches:
        keys, points = (np.asarray(batch.column(i)) for i in (0, 1))
        if node is not None:
            keys = np.concatenate([[node], keys])
            points = np.concatenate([[last], points])
        if len(keys) == 0:
            continue
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        heads = points[starts].copy()
        if node is not None:
            heads[0] = first
        lead = heads[np.cumsum(new) - 1]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = new[1:] | (points[1:] != points[:-1])
        if node is not None:
            fresh[0] = False
        keep = fresh & (points != lead)
        node, first, last = keys[-1], lead[-1], points[-1]
        yield pa.record_batch(
            [pa.array(keys[keep]), pa.array(points[keep]), pa.array(lead[keep])],
            names=["node", "point", "first"],
        )


def _coarse(value: np.ndarray) -> bytes:
    """The first bits of a set's shingles in order, `COARSE` groups a shingle, as differences.
    Two sets share at most as many shingles as their groups allow."""
    bits = min(32, max(6, int(np.ceil(np.log2(COARSE * max(1, len(value)))))))
    steps = np.diff(value >> (_VALUE_BITS - np.uint64(bits)), prepend=np.uint64(0))
    width = next(w for w in (1, 2, 4) if steps.max(initial=0) < 256**w)
    return bytes([bits, width]) + steps.astype(f"<u{width}").tobytes()


def _groups_of(data: bytes) -> tuple[np.ndarray, int]:
    return np.cumsum(np.frombuffer(data, dtype=f"<u{data[1]}", offset=2), dtype=np.int64), data[0]


def _shared_groups(left: bytes, right: bytes) -> tuple[int, int]:
    """The most shingles that two sets can share by their groups, and their sizes together."""
    (a, fine_a), (b, fine_b) = _groups_of(left), _groups_of(right)
    bits = min(fine_a, fine_b)
    a_group, a_count = np.unique(a >> (fine_a - bits), return_counts=True)
    b_group, b_count = np.unique(b >> (fine_b - bits), return_counts=True)
    _, i, j = np.intersect1d(a_group, b_group, assume_unique=True, return_indices=True)
    return int(np.minimum(a_count[i], b_count[j]).sum()), len(a) + len(b)


def _set_rows(length):
    def task(batches):
        for batch in batches:
            column = batch.column(0)
            for a, b in words.slices(column):
                value, owner = shingle_sets(column, a, b, length)
                ids, _ = _point_ids(value, owner, b - a)
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                sets = [value[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch(
                    [
                        pa.array(ids),
                        pa.array([_coarse(x) for x in sets], type=pa.binary()),
                        pa.array([x.tobytes() for x in sets], type=pa.binary()),
                    ],
                    names=["point", "coarse", "shingles"],
                )

    return task


def _least_common(total, num, den):
    """Shared shingles that two sets with `total` elements together need to link."""
    return -(-num * total // (num + den))


def _matrix(vectors: list[bytes], groups: int) -> np.ndarray:
    """Vectors folded to a number of groups that none of them is short of."""
    found = np.empty((len(vectors), groups), dtype=np.int32)
    for i, v in enumerate(vectors):
        found[i] = np.frombuffer(v, dtype=np.int32).reshape(-1, groups).sum(axis=0)
    return found


def _bounded(num, den):
    def task(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, pair in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.int32) for x in pair)
                groups = min(len(a), len(b))
                a, b = (x.reshape(-1, groups).sum(axis=0) for x in (a, b))
                keep[i] = np.minimum(a, b).sum() >= _least_common(a.sum() + b.sum(), num, den)
            yield pa.record_batch(
                [c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["u", "v"]
            )

    return task


def _coarsely(num, den):
    """Pairs that may link by the groups of their shingles."""

    def task(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                most, total = _shared_groups(left.as_py(), right.as_py())
                keep.append(most >= _least_common(total, num, den))
            keep = pa.array(keep, type=pa.bool_())
            yield pa.record_batch([c.filter(keep) for c in batch.columns[:2]], names=["u", "v"])

    return task


def _verified(num, den):
    def task(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a = np.frombuffer(left.as_buffer(), dtype=np.uint64)
                b = np.frombuffer(right.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * common >= num * (len(a) + len(b) - common))
            keep = pa.array(keep, type=pa.bool_())
            yield pa.record_batch([c.filter(keep) for c in batch.columns[:2]], names=["u", "v"])

    return task


class Tree:
    """An R-tree, packed by sorting and tiling: levels of (upper corners, least size)."""

    def __init__(self, points: np.ndarray):
        size = points.sum(axis=1)
        order = np.argsort(size, kind="stable")
        tiles = max(1, round((len(points) / FANOUT) ** 0.5))
        step = -(-len(points) // tiles)
        order = np.concatenate(
            [
                tile[np.lexsort((points[tile, 1], points[tile, 0]))]
                for tile in (order[i : i + step] for i in range(0, len(order), step))
            ]
        )
        self.order = order
        self.levels = [(points[order], size[order])]
        while len(self.levels[-1][0]) > FANOUT:
            corner, least = self.levels[-1]
            cuts = np.arange(0, len(corner), FANOUT)
            self.levels.append(
                (np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts))
            )

    def search(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Points whose bound lets them link with `query`."""
        size = query.sum()
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            at = at[at < len(corner)]
            most = np.minimum(query, corner[at]).sum(axis=1)
            at = at[most >= _least_common(size + least[at], num, den)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return self.order[at]


def _tree_pairs(num, den):
    """Candidate pairs of one block: its searched points against its indexed ones."""

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        searched = np.asarray(table["searched"])
        ids, part = np.asarray(table["point"]), np.asarray(table["part"])
        left, right = [], []
        if searched.any() and not searched.all():
            vectors = table["counts"].to_pylist()
            vectors = _matrix(vectors, min(len(v) for v in vectors) // 4)
            rest = np.flatnonzero(~searched)
            tree = Tree(vectors[rest])
            for i in np.flatnonzero(searched):
                found = rest[tree.search(vectors[i], num, den)]
                found = found[part[found] != part[i]]
                left += [ids[i]] * len(found)
                right += ids[found].tolist()
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return task


class JaccardJoin:
    """The join of one table; its steps share the staged points."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, length: int, num: int, den: int):
        self.docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        self.length, self.num, self.den = length, num, den
        self.families = Families(num, den)
        kind = self.docs.schema["id"].dataType.simpleString()
        self.points = stage(
            words.map_arrow(
                self.docs,
                _points(length, self.families),
                f"id {kind}, point long, size long, slack_own long, slack_below long, counts binary",
            )
        )
        self.unique = stage(self.points.where("size > 0").dropDuplicates(["point"]))

    def members(self) -> DataFrame:
        """(node, point, first) of nodes with two points or more."""
        rows = words.map_arrow(
            self.docs.select("text"), _node_rows(self.length, self.families), "node long, point long"
        )
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stage(
            words.map_arrow(
                rows.repartition(parts, "node").sortWithinPartitions("node", "point"),
                _members,
                "node long, point long, first long",
            )
        )

    def early_pairs(self, members: DataFrame) -> DataFrame:
        """One pair for each point, with the first point of one of its nodes. They settle most of
        a group of copies, whose nodes are then done with."""
        return members.groupBy("point").agg(F.min_by("first", F.xxhash64("node")).alias("first")).select(
            F.least("point", "first").alias("u"), F.greatest("point", "first").alias("v")
        ).distinct()

    def still_open(self, members: DataFrame, parts: DataFrame) -> DataFrame:
        """(node, point) of nodes whose points are in several parts, each point in no more nodes
        than it needs."""
        part = parts.toDF("point", "part")
        labelled = members.join(part, "point", "left").select(
            "node", "point", "first", F.coalesce("part", "point").alias("part")
        )
        lead = part.toDF("first", "lead")
        sizes = stage(
            labelled.join(lead, "first", "left")
            .groupBy("node")
            .agg(
                F.count("*").alias("n"),
                F.max(F.col("part") != F.coalesce("lead", "first")).alias("open"),
                F.first("first").alias("first"),
            )
            .where("open")
            .select("node", "n", "first")
        )
        found = members.select("node", "point").join(self._sent(sizes.select("node", "n")), "node")
        rows = found.unionByName(sizes.select("node", F.col("first").alias("point"), "n"))
        family = F.col("node").bitwiseAND(F.lit(63))
        lows = F.array(*(F.lit(int(x)) for x in self.families.low))
        own = F.aggregate(lows, F.lit(-1), lambda n, x: n + (x <= F.col("size")).cast("int"))
        slack = F.when(F.col("family") == own, F.col("slack_own")).otherwise(F.col("slack_below"))
        # Two linked documents of different parts share more of these nodes than the slack of
        # either, so the first one in any order of all nodes has `slack` others after it in both.
        after = F.row_number().over(
            Window.partitionBy("point", "family").orderBy(F.desc("n"), F.desc("node"))
        )
        return stage(
            rows.withColumn("family", family)
            .withColumn("after", after)
            .join(self.unique.select("point", "size", "slack_own", "slack_below"), "point")
            .where((F.col("after") > slack) | (F.col("n") < FREQUENT))
            .select("node", "point")
        )

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (`u`, `v`) that link."""
        with scratch(self.docs.sparkSession) as tables:
            return tables.keep(self._verify(pairs))

    def _sent(self, staged: DataFrame) -> DataFrame:
        """Ids or pairs of ids, broadcast if they are few: the long rows then stay in place."""
        return F.broadcast(staged) if staged.count() <= SENT_IDS else staged

    def _verify(self, pairs: DataFrame) -> DataFrame:
        vectors = self.unique.select("point", "counts")
        close = stage(
            words.map_arrow(
                self._sent(stage(pairs))
                .join(vectors.toDF("u", "a"), "u")
                .join(vectors.toDF("v", "b"), "v")
                .select("u", "v", "a", "b"),
                _bounded(self.num, self.den),
                "u long, v long",
            )
        )
        needed = close.select("u").unionByName(close.select(F.col("v").alias("u"))).distinct()
        ids = stage(
            self.unique.join(needed, self.unique["point"] == needed["u"], "left_semi")
            .select(F.col("id").alias("wanted"))
            .distinct()
        )
        texts = self.docs.join(self._sent(ids), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
        sets = stage(
            words.map_arrow(
                texts.select("text"), _set_rows(self.length), "point long, coarse binary, shingles binary"
            )
        )
        coarse = self._paired(close, sets.select("point", "coarse"))
        closer = stage(words.map_arrow(coarse, _coarsely(self.num, self.den), "u long, v long"))
        whole = self._paired(closer, sets.select("point", "shingles"))
        return stage(words.map_arrow(whole, _verified(self.num, self.den), "u long, v long").distinct())

    def _paired(self, pairs: DataFrame, data: DataFrame) -> DataFrame:
        """Pairs with the data of both points. Few pairs are sent to the data; of the other side
        only the rows that are asked for travel."""
        other = pairs.select("u").distinct()
        return (
            self._sent(pairs)
            .join(data.toDF("v", "b"), "v")
            .join(data.toDF("u", "a").join(self._sent(stage(other)), "u", "left_semi"), "u")
            .select("u", "v", "a", "b")
        )

    def open_nodes(self, members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their part, and the nodes whose points are in several parts: each
        with its largest part. Nodes with the same points are given once."""
        labelled = members.join(parts.toDF("point", "part"), "point", "left").select(
            "node", "point", F.coalesce("part", "point").alias("part")
        )
        by_part = labelled.groupBy("node", "part").agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("point")).alias("x"),
            F.sum(F.hash("point").cast("long")).alias("y"),
        )
        nodes = (
            by_part.groupBy("node")
            .agg(
                F.sum("n").alias("n"),
                F.bit_xor("x").alias("x"),
                F.sum("y").alias("y"),
                F.count("*").alias("parts"),
                F.max_by("part", F.struct("n", "part")).alias("main"),
                F.max("n").alias("most"),
            )
            .where("parts > 1")
            .groupBy("n", "x", "y")
            .agg(F.min_by(F.struct("node", "main", "most"), "node").alias("s"))
            .select(
                "s.node",
                "s.main",
                F.ceil(F.col("n") / BLOCK).alias("indexed"),
                F.ceil((F.col("n") - F.col("s.most")) / BLOCK).alias("searched"),
            )
        )
        return stage(labelled), stage(nodes)

    def pivot_pairs(self, labelled: DataFrame, nodes: DataFrame) -> DataFrame:
        """Each point outside the largest part of its node with a few points of that part.
        They settle nearly all of a large group of near copies; the tree does the rest."""
        rows = labelled.join(self._sent(nodes), "node")
        drawn = [
            F.min_by("point", F.xxhash64("point", F.lit(seed))).alias(f"p{seed}") for seed in range(PIVOTS)
        ]
        pivots = (
            rows.where("part = main")
            .groupBy("node")
            .agg(*drawn)
            .select("node", F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("pivots"))
        )
        return (
            rows.where("part <> main")
            .join(pivots, "node")
            .select("point", F.explode("pivots").alias("pivot"))
            .select(F.least("point", "pivot").alias("u"), F.greatest("point", "pivot").alias("v"))
            .distinct()
        )

    def tree_pairs(self, labelled: DataFrame, nodes: DataFrame) -> DataFrame:
        """All candidate pairs left in open nodes, by R-tree and block by block."""
        rows = labelled.join(self._sent(nodes), "node").join(self.unique.select("point", "counts"), "point")
        blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        place = lambda n, seed: F.pmod(F.xxhash64("point", F.lit(seed)), F.col(n))
        columns = ["node", "point", "part", "counts", "q", "i"]
        searched = (
            rows.where("part <> main")
            .withColumn("q", place("searched", 1))
            .withColumn("i", blocks("indexed"))
            .select(*columns, F.lit(True).alias("searched"))
        )
        indexed = (
            rows.withColumn("i", place("indexed", 2))
            .withColumn("q", blocks("searched"))
            .select(*columns, F.lit(False).alias("searched"))
        )
        found = searched.unionByName(indexed).groupBy("node", "q", "i").applyInArrow(
            _tree_pairs(self.num, self.den), "u long, v long"
        )
        return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    def groups(self) -> DataFrame:
        """(`node`, `component`) over the points that link with another one."""
        spark = self.docs.sparkSession
        with scratch(spark) as tables:
            members = self.members()
            reclaim(spark)  # the nodes' shuffle is by far the largest
            parts = stage(components(self.verify(stage(self.early_pairs(members)))))
            members = self.still_open(members, parts)
            for candidates in (self.pivot_pairs, self.tree_pairs):
                labelled, nodes = self.open_nodes(members, parts)
                if nodes.isEmpty():
                    break
                parts = self._joined(parts, candidates(labelled, nodes))
            return tables.keep(parts)

    def _joined(self, parts: DataFrame, pairs: DataFrame) -> DataFrame:
        """The parts after those of the pairs that link. The parts found so far are stars."""
        pairs = stage(self._apart(pairs, parts))
        if pairs.isEmpty():
            return parts
        links = self.verify(pairs)
        if links.isEmpty():
            return parts
        return stage(components(parts.toDF("u", "v").unionByName(links)))

    def _apart(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs of points that are not yet in one part."""
        label = lambda c: parts.toDF(c, f"{c}_part")
        return (
            pairs.join(label("u"), "u", "left")
            .join(label("v"), "v", "left")
            .where(F.coalesce("u_part", "u") != F.coalesce("v_part", "v"))
            .select("u", "v")
        )


def jaccard_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 5,
    num: int = 80, den: int = 100,
) -> DataFrame:
    """One row per document row: `doc_id`, `n_shingles`, `point` (equal for equal sets),
    `component_id` (the least id reachable by links of similarity `num`/`den` or more)."""
    join = JaccardJoin(docs, doc_id, text, length, num, den)
    parts = join.groups().toDF("point", "part")
    labelled = join.points.select("id", "size", "point").join(parts, "point", "left").select(
        "id", "size", "point", F.coalesce("part", "point").alias("part")
    )
    filled = labelled.where("size > 0")
    least = filled.groupBy("part").agg(F.min("id").alias("least"))
    linked = filled.join(least, "part").select("id", "size", "point", "least")
    alone = labelled.where("size = 0").select("id", "size", "point", F.col("id").alias("least"))
    return linked.unionByName(alone).select(
        F.col("id").alias(doc_id),
        F.col("size").alias("n_shingles"),
        "point",
        F.col("least").alias("component_id"),
    )


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs, length=4, num=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
c AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep, list(doc_id) AS ids FROM s WHERE len(s) > 0 GROUP BY 1, 2),
e AS (SELECT rep, n, unnest(s) AS g FROM c),
f AS (SELECT g, count(*) AS f FROM e GROUP BY g HAVING count(*) > 1),
o AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM (SELECT * FROM e SEMI JOIN f USING (g)) a JOIN (SELECT * FROM e SEMI JOIN f USING (g)) b
    ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * o >= 85 * (na + nb - o)),
l2 AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, l2.b FROM r JOIN l2 ON r.b = l2.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
q AS (SELECT unnest(ids) AS doc_id, n, rep FROM c)
SELECT s.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
FROM s LEFT JOIN q ON q.doc_id = s.doc_id LEFT JOIN m ON m.a = q.rep
"""
