"""Operators over whole tables against plain versions, and their defined cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import frame, groups, lower, passages, shingles, without_copies

from monthloom.llm import chat, components, line_dedup, ngram_join, url_filter


def _near_copies(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 20, 60]))] for _ in range(20)]
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for i in range(260):
        words = list(rng.choice(base))
        if rng.random() < 0.4:
            words[3:3] = passage
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 30)}"
        texts.append((i, " ".join(words)))
    return texts + [(900, None), (901, ""), (902, "one"), (903, "One"), (904, "a b"), (905, " \n ")]


@pytest.mark.parametrize("frequent, block", [(64, 512), (3, 8)])
def test_join_finds_every_group(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = _near_copies(frequent)
    rows = ngram_join.jaccard_groups(frame(spark, texts, extra=True), length=4, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups(texts, 4, 85)


def test_join_leaves_out_documents_that_only_share_a_passage(spark):
    """Their pairs would grow with the square of the documents that hold it."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(16))
    texts = [(i, " ".join([*(f"w{rng.randint(0, 10**6)}" for _ in range(150)), passage])) for i in range(60)]
    texts += [(100, texts[0][1] + " more"), (101, texts[1][1] + " x"), (102, texts[1][1] + " y")]
    join = ngram_join.JaccardJoin(frame(spark, texts), "doc_id", "text", 4, 85, 100)
    members = join.members()
    none = spark.createDataFrame([], "node long, component long")
    left = join.still_open(members, none)
    few = {r.point for r in join.points.where("id in (0, 1, 100, 101, 102)").collect()}
    found = {r.point for r in left.collect()}
    assert members.count() > 60 and found == few
    rows = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(frame(spark, texts), length=4, num=85).collect()}
    assert rows == {i: x for i, (_, x) in groups(texts, 4, 85).items()}


def test_join_with_repeated_and_missing_ids(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "z"), (None, None)]
    rows = ngram_join.jaccard_groups(frame(spark, texts)).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == {(1, 1): 2, (None, 1): 1, (0, 0): 1, (None, None): 1}
    assert ngram_join.jaccard_groups(frame(spark, [])).collect() == []


def test_families_hold_every_pair_that_can_link():
    """In the family of the smaller set both are entered, and its slices are enough."""
    for num, den in ((85, 100), (80, 100)):
        f = ngram_join.Families(num, den)
        for a in [*range(1, 200), 1000, 4097]:
            for b in {a, a + 1, (a + a * den // num) // 2, a * den // num}:
                if b >= a and den * a >= num * b:
                    own = int(f.of(np.array([a]))[0])
                    assert own in {int(x[0]) for x in ngram_join._both_families(np.array([b]), f)}
                    common = -(-num * (a + b) // (num + den))
                    assert a + b - 2 * common <= f.reach[own] < f.slices[own]


def test_long_sets_have_vectors_that_tell_them_apart():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**54, n, dtype=np.uint64)) for n in (6000, 6200, 30)]
    vectors = ngram_join._vectors(np.concatenate(sets), np.repeat(range(3), [len(x) for x in sets]), np.array([len(x) for x in sets]))
    size = [np.frombuffer(v, np.int32).sum() for v in vectors]
    assert size == [len(x) for x in sets] and len(vectors[2]) == 4 * ngram_join.GROUPS
    a, b = ngram_join._matrix(vectors[:2], len(vectors[0]) // 4)
    assert np.minimum(a, b).sum() < ngram_join._least_common(a.sum() + b.sum(), 85, 100)
    a, b = ngram_join._matrix(vectors[:2], ngram_join.GROUPS)
    assert np.minimum(a, b).sum() >= ngram_join._least_common(a.sum() + b.sum(), 85, 100)


def test_tree_keeps_every_point_within_the_bound():
    rng = np.random.default_rng(3)
    points = rng.poisson(2, (500, ngram_join.GROUPS)).astype(np.int32)
    points[250:] = points[:250] + (rng.random((250, ngram_join.GROUPS)) < 0.05)
    tree = ngram_join.Tree(points)
    size = points.sum(axis=1)
    for q in points[::37]:
        bound = np.minimum(q, points).sum(axis=1)
        expected = np.flatnonzero(bound >= -(-85 * (q.sum() + size) // 185))
        assert sorted(tree.search(q, 85, 100)) == expected.tolist()


def test_groups_of_shingles_bound_what_sets_share():
    rng = np.random.default_rng(4)
    tight = 0
    for n, m in [(1, 1), (3, 4), (40, 44), (300, 300), (5000, 5400), (0, 0)]:
        pool = np.unique(rng.integers(0, 2**54, n + m + 8, dtype=np.uint64))
        for share in (0, n // 2, n):
            a = np.sort(rng.permutation(pool)[:n])
            b = np.sort(np.concatenate([a[:share], np.setdiff1d(pool, a)[: max(0, m - share)]]))
            most, total = ngram_join._shared_groups(ngram_join._coarse(a), ngram_join._coarse(b))
            true = len(np.intersect1d(a, b))
            assert total == len(a) + len(b) and true <= most <= true + 0.2 * total + 2
            tight += most < 0.5 * total
    assert tight


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)]
    edges += [(500, i) for i in range(501, 540)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert found == {x: root(x) for x in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    lines = ["a b", "c", "d e f", "", "  ", "g", "h i", "u1", "u2 x"]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(100)]
    texts += [(500, None), (501, ""), (None, "a b\nc\nd e f\ng"), (502, "a b\n" * 60), (503, "q " * 5000)]
    rows = line_dedup.dedup_lines(frame(spark, texts, extra=True), min_words=5).collect()
    assert {(r.doc_id, r.n_lines_deleted, r.text) for r in rows} == set(without_copies(texts, 5))
    assert all(r.source == "s" and r.runs == "x" for r in rows)


def test_line_dedup_of_repeated_rows_and_none(spark):
    texts = [(1, "a b c\nd e"), (1, "a b c\nd e"), (2, "a b c\nd e\nnew")]
    rows = line_dedup.dedup_lines(frame(spark, texts), min_words=4).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, ""), (1, "a b c\nd e"), (2, "new")]
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_ranks_are_places_in_order(spark):
    keys = spark.range(200).selectExpr("hash(id) % 50 as a", "id as b")
    rows = sorted((r.a, r.b, r.rank) for r in line_dedup._ranked(keys, ["a", "b"]).collect())
    assert [r[2] for r in rows] == list(range(200))


def _turns(*turns):
    return [{"role": r, "text": t} for r, t in turns]


def test_preferences(spark):
    q, a, b = ("user", "Q"), ("assistant", "A"), ("assistant", "Bé")
    more = [("user", "more"), ("assistant", "end")]
    pairs = [
        (1, _turns(q, a), _turns(q, b, *more)),
        (2, _turns(q, a), _turns(q, a)),
        (3, _turns(a), _turns(b)),
        (4, None, _turns(q, b)),
        (5, [], []),
        (6, _turns(q, (None, None)), _turns(q, ("unknown", ""))),
    ]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(pairs, f"pair_id long, chosen {kind}, rejected {kind}")
    rows = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    one = rows[1]
    assert one.prompt == "<|user|>\nQ<|end|>\n" and one.n_prompt_turns == 1
    trained = lambda text, spans: [text[s.start : s.end] for s in spans]
    assert trained(one.chosen, one.chosen_spans) == ["A<|end|>\n"]
    assert trained(one.rejected, one.rejected_spans) == ["Bé<|end|>\n", "end<|end|>\n"]
    assert {i for i, r in rows.items() if r.usable} == {1, 3}
    assert rows[2].chosen == "" and rows[2].n_prompt_turns == 2
    assert rows[3].prompt == "" and rows[4].chosen == ""


def test_conversations_become_arrays(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x"), (2, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.turn_arrays(table).collect()}
    assert found == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], 2: [("unknown", "")]}
    pairs = {r.pair_id: r for r in chat.swapped_replies(table).collect()}
    assert pairs[1].rejected[2].text == "" and pairs[1].chosen[2].text == "b"
    assert chat.format_preferences(chat.swapped_replies(table.where("conv_id = 9"))).collect() == []


URLS = [
    ("http://a.COM/x?y", "a.com", "/x", "com/"),
    ("https://sub.example.com/en/1", "sub.example.com", "/en/1", "example.com/en/"),
    ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/"),
    ("ftp://b.net/es/q", "b.net", "/es/q", "net/es/"),
    ("http://b.net/es", "b.net", "/es", None),
    ("http://com", "com", "", None),
    ("http://telecom/x", "telecom", "/x", None),
    ("http://b.org?u=c://d/e", "b.org", "", None),
    ("no scheme/en/", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("://", "", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
]


def test_urls_and_rules(spark):
    table = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] * 2, "page_id long, url string")
    rows = url_filter.filter_urls(table).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter(
        {(i, *u[1:]): 2 for i, u in enumerate(URLS)}
    )
    verdicts = {text: verdict for verdict, text in url_filter.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in rows if r.rule)
    assert all(r.verdict == "allow" for r in rows if r.host == "")
    assert url_filter.filter_urls(table.where("page_id < 0")).collect() == []


def test_templates_generalise_merge_and_reject(spark):
    rules = (("block", "s.t/bad/q/"), ("allow", "s.t/good/"))
    urls = [f"http://s.t/bad/q/{i}" for i in range(30)] + [f"http://s.t/good/q/{i}" for i in range(40)]
    urls += [f"http://s.t/u{chr(97 + i % 26)}{chr(97 + i // 26)}/home" for i in range(60)]
    urls += ["http://s.t/bad/Q/77", "http://s.t/bad/q"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.filter_urls(table, rules).collect()}
    assert {rows[i].template for i in range(30)} == {"/bad/q/{n}"}
    assert rows[0].blocked_share > 0.9
    assert len({rows[70 + i].template for i in range(60)}) == 1  # one wildcard or one merged branch
    assert all(rows[70 + i].verdict == "allow" for i in range(60))


def test_shapes(spark):
    paths = spark.createDataFrame(
        [("/en/123.html",), ("/a1b2c3d4e5/x",), ("/plain-words-here/",), ("/1/2/3/4/5/6",), ("",)], "path string"
    )
    from pyspark.sql import functions as F

    found = [r[0] for r in paths.select(url_filter.segments(F.col("path"))).collect()]
    assert found == [["en", "{n}.html"], ["{x}", "x"], ["plain-words-here"], ["{n}"] * 4 + ["*"], []]


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("the ing ea on er st".split()) for _ in range(3))
    text = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    texts = [(i, text(14)) for i in range(40)]
    items = [(1, " ".join(word() for _ in range(20))), (2, None)]
    texts += [(50, texts[3][1]), (51, texts[4][1] + "\n" + text(3)), (52, texts[5][1].replace("\n", " "))]
    texts += [(60, text(3) + "\n" + items[0][1].upper()), (61, "1 2 3"), (62, None), (63, ""), (64, texts[6][1].replace("\n", " \n"))]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    left = [(i, t) for i, n, t in without_copies(left, line_dedup.MIN_WORDS) if n == 0 or t.strip()]
    near = groups(left, pipeline.SHINGLE, *pipeline.SIMILAR)
    left = [(i, t) for i, t in left if near[i][1] == i]
    hit = passages(left, items)
    left = [i for i, _ in left if not hit[i][1]]
    assert {50, 52, 60, 61, 62, 63, 64}.isdisjoint(left) and 51 in left
    assert sorted({r.doc_id for r in rows}) == left
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert [name for name, _ in pipeline.STAGES] == [
        "language_id", "line_dedup", "near_duplicates", "decontamination", "packing"
    ]


def test_plain_helpers_agree():
    assert shingles("A a\tb", 5) == {("a", "a", "b")} and lower(None) == ""


def test_branches_without_labels_join_the_labelled_ones_they_resemble(spark):
    rules = (("block", "s.t/bad/"), ("allow", "s.t/good/"))
    urls = [f"http://s.t/bad/{a}/{i}" for a in ("buy", "win") for i in range(20)]
    urls += [f"http://s.t/good/{a}/{i}" for a in ("read", "learn") for i in range(30)]
    urls += [f"http://s.t/new/{a}/{i}" for a in ("buy", "win") for i in range(8)]
    urls += [f"http://s.t/old/{a}/{i}" for a in ("read", "learn") for i in range(9)]
    urls += [f"http://s.t/{c}/x/y{k}" for c in ("p", "q", "r") for k in "ab"] + ["http://s.t/z/alone"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {u: r for r in url_filter.filter_urls(table, rules).collect() for u in [urls[r.page_id]]}
    assert all(rows[u].verdict == ("block" if "/bad/" in u or "/new/" in u else "allow") for u in urls)
    assert {rows[u].template.split("/")[1] for u in urls if "/old/" in u} == {"good"}
    # A second and a third pivot of the node: neither is the largest child.
    assert len({rows[f"http://s.t/{c}/x/ya"].template for c in "pqr"}) == 1
