"""Vector operators against plain versions, and their defined cases."""

import hashlib
import math

import numpy as np
import pytest

from monthloom.llm import centroids, hard_negatives

WIDE = "vec_id long, embedding array<float>, label int, cluster string, id string, d0 int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", 0) for i, v, l in rows], WIDE)


def _plain_clusters(rows, k, rounds):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, _ in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = [x for x in kept if x[0] is not None]
    places = [v for _, v in sorted(named, key=lambda x: hashlib.sha256(f"2:{x[0]}".encode()).hexdigest())[:k]]

    def assign():
        out = []
        for i, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in places]
            out.append((i, v, gaps.index(min(gaps)), min(gaps)))
        return out

    for _ in range(rounds):
        now = assign()
        for c in range(len(places)):
            members = [v for _, v, own, _ in now if own == c]
            if members:
                places[c] = [sum(x) // len(members) for x in zip(*members)]
    now = assign()
    per = {c: sum(d for *_, own, d in now if own == c) for c in range(len(places))}
    return sorted(
        (repr(i), c, d, per[c], sum(per.values()), tuple(places[c])) for i, _, c, d in now
    )


def _vectors(seed, n, scale=0.2):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in np.float32(rng.normal(0, scale, 64))] for _ in range(n)]


def test_clusters_equal_plain_rounds(spark):
    base = _vectors(4, 60) + _vectors(5, 6, 900.0)
    rows = [(i, v, 0) for i, v in enumerate(base)]
    rows += [(1000 + i, base[3], 1) for i in range(40)] + [(7, base[7], 0), (None, base[9], None)]
    bad = [*base[0]]
    for i, x in enumerate((None, float("nan"), float("inf"))):
        rows.append((2000 + i, [x, *bad[1:]], 0))
    rows += [(2100, None, 0), (2101, [], 0), (2102, bad[:63], 0), (2103, [*bad, 0.0], 0)]
    frame = _frame(spark, rows).repartition(5)
    found = centroids.cluster(frame, k=12, rounds=4).collect()
    plain = _plain_clusters(rows, 12, 4)
    assert sorted((repr(r.vec_id), *r[1:5], tuple(r.centroid)) for r in found) == plain


def test_clusters_of_few_or_no_vectors(spark):
    assert centroids.cluster(_frame(spark, [])).collect() == []
    assert centroids.cluster(_frame(spark, [(None, [0.5] * 64, 1)])).count() == 1
    (row,) = centroids.cluster(_frame(spark, [(3, [-0.001] * 64, 1)])).collect()
    assert (row.cluster, row.distance, row.inertia, row.centroid) == (0, 0, 0, [-1] * 64)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(_frame(spark, [(3, [1e30] * 64, 1)])).collect()


def test_planes_are_exact_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**27), 2**27, (9, 64))
    c = np.concatenate([rng.integers(-5, 5, (4, 64)), np.full((1, 64), -(2**27)), np.zeros((1, 64), dtype=np.int64)])
    assert (centroids.unpack(centroids.pack(x)) == x).all()
    assert (centroids.dots(centroids.pack(x), centroids.pack(c)) == x @ c.T).all()
    assert (centroids.squares(centroids.pack(x)) == (x * x).sum(axis=1)).all()


def _plain_negatives(rows, every, keep=5):
    kept = {
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    }
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for anchor, label, v in kept:
        if anchor % every:
            continue
        own = sorted((-dot(v, w), i) for i, other, w in kept if other == label and i != anchor)[:keep]
        rest = sorted((-dot(v, w), i) for i, other, w in kept if other != label)
        for p, i in own:
            fits = [(s, n) for s, n in rest if 80 * -p <= 100 * -s <= 100 * -p][:keep]
            out += [(anchor, i, k + 1, n, -p, -s) for k, (s, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("leaf, chunk, group", [(1024, 8192, 1024), (16, 24, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf, chunk, group):
    for name, value in (("LEAF", leaf), ("CHUNK", chunk), ("GROUP", group)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(leaf)
    middle = rng.normal(0, 0.5, (6, 12))
    near = [[float(x) for x in np.float32(middle[i % 6] + rng.normal(0, 0.1, 12))] for i in range(500)]
    rows = [(i, v, int(rng.integers(0, 4)) - 1) for i, v in enumerate(near)]
    rows += [(600 + i, near[0], i % 2) for i in range(90)] + rows[:30] + [(5, near[9], 0), (100, near[1], 2)]
    rows += [(700 + i, near[3][: i % 5], 1) for i in range(20)] + [(800, [0.0] * 12, 1), (-10, near[4], 1)]
    rows += [(900, None, 1), (910, near[2], None), (None, near[2], 1), (920, [None, 1.0], 1), (930, [math.inf], 1)]
    found = hard_negatives.mine(_frame(spark, rows).repartition(3), every=10).collect()
    assert sorted(tuple(r) for r in found) == _plain_negatives(rows, 10)


def test_negatives_of_few_or_no_rows(spark):
    assert hard_negatives.mine(_frame(spark, [])).collect() == []
    assert hard_negatives.mine(_frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])).collect() == []
    two = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.8], 2), (3, [0.79], 2), (4, [1.0], 0)]
    found = hard_negatives.mine(_frame(spark, two)).collect()
    assert [(r.positive_id, r["rank"], r.negative_id) for r in sorted(found)] == [(1, 1, 4)]
    with pytest.raises(Exception, match="fit"):
        hard_negatives.mine(_frame(spark, [(0, [1e6] * 64, 1)])).collect()


def test_tree_skips_subtrees_and_loses_none():
    """On rows in separate clusters most leaves are skipped, and every row of a ring is in a found one."""
    rng = np.random.default_rng(2)
    x = np.floor(np.repeat(rng.normal(0, 400, (40, 16)), 50, axis=0) + rng.normal(0, 12, (2000, 16)))
    square = (x * x).sum(axis=1)
    tree = hard_negatives.Tree(x, int(square.max()), 40)
    leaf = tree.place(x, square, tree.low, tree.high)
    visited = 0
    for a in range(0, 2000, 100):
        score = x @ x[a]
        high = np.sort(score)[-5:].astype(float)
        low = np.ceil(0.95 * high)
        found = set(tree.search(x[a], int(square[a]), low, high))
        wanted = ((score[:, None] >= low) & (score[:, None] <= high)).any(axis=1)
        assert set(leaf[wanted].tolist()) <= found
        visited += len(found)
    assert visited < 0.3 * 20 * tree.leaves
