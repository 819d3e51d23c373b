"""Operators on single texts against plain versions, and their defined cases."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from plain import BLANK_WORD, base_quality, frame, lower, passages, sha

from monthloom.llm import decontaminate, language_id, language_model, packing, pii, quality

CASES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "a b c d e f g h " * 5),
    (6, "x y\nx y\n \n" + " ".join(f"w{i % 11}" for i in range(90))),
    (7, "Ünïcode 日本語 text 😀 tail"),
    (8, "<|endoftext|> <|ENDOFTEXT|> don't stop...! café."),
    (9, "w " * 30_000),
    (10, "z" * 20_000),
    (4, "one"),
    (None, "no id here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, CASES, extra=True)


def test_quality_counts(docs):
    rows = quality.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == Counter(
        (i, *base_quality(t)) for i, t in CASES
    )
    assert not any(r.kept for r in rows if r.base_failed)


def test_quality_rejects_what_is_unlike_its_language(spark):
    rng = random.Random(3)
    plain = [(i, " ".join(rng.choice("the of and cat tree house river stone".split()) for _ in range(120))) for i in range(40)]
    odd = (99, " | ".join(f"K{i}#" for i in range(100)))
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, [*plain, odd])).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_quality_without_rows(spark):
    assert quality.judge(frame(spark, [])).collect() == []


def _plain_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [
        ("ip", *m.span())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m[0].split("."))
    ]
    spans += [
        ("card", *m.span())
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
        if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))
    ]
    return spans + [
        ("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15
    ]


def test_personal_data_on_random_texts():
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice("a1.9@+- 2_b%(") for _ in range(rng.randint(0, 40)))
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == _plain_spans(text)


def test_personal_data_checksums_and_context():
    text = "card 4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00, bad DE88 3704 0044 0532 0130 00"
    assert [s[0] for s in pii.spans_of(text)] == ["card", "iban"]
    assert pii.spans_of("social security 123-45-6789")[0][0] == "ssn"
    assert pii.spans_of("order 123-45-6789") == []
    assert pii.mask("mail a@b.co now", pii.spans_of("mail a@b.co now")) == "mail <email> now"


def test_personal_data_query_columns(spark):
    texts = [(1, "a@b.co +1 (222) 555-0101"), (2, None), (2, None), (None, "1.2.3.4 " + "9" * 50_000)]
    rows = pii.personal_data(frame(spark, texts, extra=True), masked=True).collect()
    assert Counter((r.doc_id, tuple(s.kind for s in r.spans)) for r in rows) == Counter(
        {(1, ("email", "phone")): 1, (2, ()): 2, (None, ("ip",)): 1}
    )


def test_passages_on_random_texts(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((0, 1, 3, 6, 10, 12, 25))]
    items += [(50, items[4][1]), (51, None)]
    texts = [(i, " ".join(word() + word() for _ in range(rng.randint(0, 40)))) for i in range(40)]
    texts += [(100 + i, f"{t[1]}, {items[i % 7][1].upper()}! {t[1]}") for i, t in enumerate(texts)]
    texts += [(300, None), (301, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.shared_passages(frame(spark, texts, extra=True), table).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == passages(texts, items)
    assert all(s.end > s.place for r in rows for s in r.spans)


def test_passages_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.shared_passages(frame(spark, [(1, "a b"), (1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in rows] == [(2, 0, 0)] * 2
    assert decontaminate.shared_passages(frame(spark, []), none).collect() == []


@pytest.mark.parametrize("capacity", [7, 4096])
def test_packing_round_trip(docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_file())
    rows = packing.pack(docs, packing.vocabulary_file(), capacity=capacity, with_ids=True).collect()
    expected = Counter()
    for i, text in CASES:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected[i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), tuple(part)] += 1
    assert expected == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    assert len(ends) <= -(-sum(r.length for r in rows) // capacity) * 1.3 + 1


def test_packing_is_best_fit_decreasing():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 40) for _ in range(500)), reverse=True)
    rooms = []
    for n in lengths:
        fitting = [i for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(40 - n)
    plan = packing.sweep(dict(Counter(lengths)), 40)
    used = {s for _, _, n, first, _ in plan for s in range(first, first + n)}
    assert len(used) == len(rooms)
    assert packing.sweep({}, 40) == []


def test_packing_splits_one_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    pieces = spark.range(100).selectExpr("id", "1L + id % 2 as length")
    rows = packing.best_fit(pieces, 4).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 100
    assert len({r.sequence_id for r in rows}) == 38
    assert packing.best_fit(pieces.where("id < 0"), 4).collect() == []


def test_language_is_learned_and_undefined_without_letters(spark):
    rng = random.Random(4)
    say = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(60))
    parts = {"xx": ["tha", "ing", "on", "er"], "yy": ["eau", "que", "éi", "ou"]}
    texts = [(i, say(parts["xx" if i % 2 else "yy"]).capitalize()) for i in range(40)]
    rows = [(i, t, "xx" if i % 2 else "yy") for i, t in texts]
    labelled = spark.createDataFrame(rows[:30] + [(90, "ignored", None)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled, language_id.vocabulary_file())
    asked = frame(spark, [*texts[30:], *CASES[:3], (77, "12 34 !"), (78, "日本"), (79, "q" * 500)], extra=True)
    found = {r.doc_id: r for r in language_id.identify(asked, model, keep=["row", "text"]).collect()}
    assert all(found[i].lang_pred == ("xx" if i % 2 else "yy") for i, _ in texts[30:])
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 77))
    assert found[78].lang_pred in ("xx", "yy")  # by the start mark alone
    assert 0 <= found[79].score <= 1 and found[79].text == "q" * 500
    empty = language_id.fit(labelled.where("lang is null"), language_id.vocabulary_file())
    assert {r.lang_pred for r in language_id.identify(asked, empty).collect()} == {"und"}


def test_equal_languages_tie_to_the_first_name(spark):
    text = "the thing and another thing on it"
    labelled = spark.createDataFrame([(1, text, "yy"), (2, text, "xx")], "doc_id long, text string, lang string")
    model = language_id.fit(labelled, language_id.vocabulary_file())
    (row,) = language_id.identify(frame(spark, [(5, "another thing")]), model).collect()
    assert row.lang_pred == "xx" and row.score == pytest.approx(0.5)


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = language_id.Pieces(["a", "ab", "b", "bab", "▁"])
    p = np.array([[0.2], [0.3], [0.1], [0.05], [0.25], [1e-7]])

    def by_hand(text):
        names = {"a": 0.2, "ab": 0.3, "b": 0.1, "bab": 0.05, "▁": 0.25}
        if not text:
            return 1.0
        return sum(names[text[:k]] * by_hand(text[k:]) for k in range(1, min(3, len(text)) + 1) if text[:k] in names)

    for text in ("ab", "abab", "babab"):
        codes = language_id._codes([text], len(text))
        assert language_id.forward(pieces, p, codes)[-1][0, 0] == pytest.approx(by_hand(text))
        uses = language_id.expected(pieces, p[:, 0], codes, np.array([2]))
        assert (uses[:5] * np.array([1, 2, 1, 3, 1])).sum() == pytest.approx(2 * len(text))
        logs = language_id.log_forward(pieces, np.log(p), codes)
        assert np.exp(logs[-1, 0]) == pytest.approx(by_hand(text))
        assert language_id.log_expected(pieces, np.log(p[:, 0]), codes, 2) == pytest.approx(uses)


def test_all_letter_pieces_and_words_of_any_length():
    import numpy as np

    names = language_id.pieces_of(language_id.vocabulary_file())
    assert max(map(len, names)) > 12
    pieces = language_id.Pieces(names)
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(len(names) + 1), 2).T
    scorer = language_id.Scorer(names, p)
    text = "".join(rng.choice(list("thegraqué日ß"), 100_000))
    whole = scorer.rows(np.array([5], dtype=np.uint64), lambda at: [text])
    assert np.isfinite(whole).all() and whole[0, -1] == 1
    # A piece may lie anywhere, also over the place where blocks used to end.
    for size in (31, 32, 33, 40):
        codes = language_id._codes([("▁" + "international" * 4)[:size]], size)
        exact = language_id.forward(pieces, p, codes)[-1][0]
        assert np.exp(language_id.log_forward(pieces, np.log(p), codes)[-1]) == pytest.approx(exact)


def test_scores_against_plain_counts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("A b c d, e. ff gg hh".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    texts += [(i, t) for i, t in CASES if i is not None]
    part = F.crc32(F.col("doc_id").cast("string")) % 10
    rows = language_model.interpolated_scores(frame(spark, texts, extra=True), part != 0, part == 1, rounds=2).collect()
    tokens = [(i, [*BLANK_WORD.findall(lower(t)), None], zlib.crc32(str(i).encode()) % 10 == 0) for i, t in texts]
    count = Counter(x for _, w, out in tokens if not out for x in w)
    total, distinct = sum(count.values()), len(count)
    expected = Counter(
        (i, out, len(w), sum(count[x] > 0 for x in w), total,
         round(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 4))
        for i, w, out in tokens
    )
    assert expected == Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows
    )
    assert all(r.score < 0 for r in rows)


def test_scores_do_not_depend_on_where_counts_are_kept(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    texts = [(i, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(40))) for i in range(50)]
    part = F.crc32(F.col("doc_id").cast("string")) % 10
    score = lambda: {
        r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6))
        for r in language_model.interpolated_scores(frame(spark, texts), part != 0, part == 1, rounds=2).collect()
    }
    whole = score()
    monkeypatch.setattr(language_model, "LOCAL", 20)
    assert score().keys() == whole.keys()
    assert {i: v[:2] for i, v in score().items()} == {i: v[:2] for i, v in whole.items()}


def test_model_is_a_distribution():
    import numpy as np

    m = language_model
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 3, (m.SYMBOLS + 1, m.SYMBOLS)).astype(np.int32)
    triples = np.zeros((m.COARSE * m.COARSE, m.SYMBOLS), dtype=np.int32)
    triples[5, :40] = 2
    model = m.Model(pairs, triples, m.even_weights())
    every = np.arange(m.SYMBOLS)
    whole = 10 ** model.log10(every, np.full(m.SYMBOLS, 7), np.full(m.SYMBOLS, 5))
    assert whole.sum() == pytest.approx(1)


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    none = frame(spark, [])
    assert packing.pack(none, packing.vocabulary_file()).collect() == []
    assert pii.personal_data(none).collect() == []
    assert language_model.interpolated_scores(none, F.lit(True), F.lit(False), rounds=1).collect() == []
    assert sha("") == pii.base_digest([])


def test_scores_against_plain_interpolation_over_all_words(spark, monkeypatch):
    """More words than any table of the most frequent ones holds; pairs and triples of rare words."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    pairs = [f"r{i} s{i} t{i}" for i in range(900)]
    texts = [(i, " ".join(rng.choice(pairs) for _ in range(rng.randint(0, 60)))) for i in range(90)]
    part = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in texts}
    tokens = {i: ["<s>", "<s>", *BLANK_WORD.findall(t), None] for i, t in texts}

    def counts(ids):
        grams = [Counter() for _ in range(4)]
        for i in ids:
            for k in range(2, len(tokens[i])):
                for n in range(1, 4):
                    grams[n][tuple(tokens[i][k - n + 1 : k + 1])] += 1
                    if n > 1:
                        grams[0][n, *tokens[i][k - n + 1 : k]] += 1
        return grams

    def parts(grams, i):
        level = lambda n: math.ceil(math.log2(n + 1))
        for k in range(2, len(tokens[i])):
            u, v, w = tokens[i][k - 2 : k + 1]
            c3, c2 = grams[0][3, u, v], grams[0][2, v]
            p0 = 1 / (len(grams[1]) + 1)
            p1 = grams[1][w,] / grams[1].total()
            p2 = grams[2][v, w] / c2 if c2 else p1
            p3 = grams[3][u, v, w] / c3 if c3 else p2
            yield (level(c3), level(c2)), (p3, p2, p1, p0)

    kept = counts([i for i in part if part[i] > 1])
    weights = Counter()
    for _ in range(3):
        new = {}
        for i in part:
            for bucket, p in parts(kept, i) if part[i] == 1 else ():
                a = weights.get(bucket, (0.25,) * 4)
                whole = sum(x * y for x, y in zip(a, p))
                new[bucket] = [s + x * y / whole for s, x, y in zip(new.get(bucket, [1.0] * 4), a, p)]
        weights = {b: [x / sum(s) for x in s] for b, s in new.items()}
    every = counts([i for i in part if part[i] > 0])
    expected = {
        i: sum(
            math.log10(sum(x * y for x, y in zip(weights.get(b, (0.25,) * 4), p))) for b, p in parts(every, i)
        )
        for i in part
    }
    rule = F.crc32(F.col("doc_id").cast("string")) % 10
    for size in (language_model.LOCAL, 200):
        monkeypatch.setattr(language_model, "LOCAL", size)
        rows = language_model.interpolated_scores(frame(spark, texts), rule != 0, rule == 1, rounds=3).collect()
        assert {r.doc_id: r.score for r in rows} == pytest.approx(expected)
