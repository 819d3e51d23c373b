import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import ALNUM_WORD, BLANK_WORD, lower

from monthloom.llm import words

TEXT = st.text(st.sampled_from("aB1 \n\t.é-ÜZ\x1f\x00"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    for table, pattern in ((words.NOT_BLANK, BLANK_WORD), (words.ALPHANUMERIC, ALNUM_WORD)):
        w = words.cut(column, 0, len(texts), table)
        found = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends, strict=True)]
        expected = [(i, x) for i, t in enumerate(texts) for x in pattern.findall(lower(t))]
        assert list(zip(w.doc.tolist(), found, strict=True)) == expected
        names = dict(zip(found, w.hashes().tolist(), strict=True))
        assert len(set(names.values())) == len(names)
        assert [names[x] for x in found] == w.hashes().tolist()


def test_runs_stay_in_a_document():
    column = pa.array(["a b c", None, "b c", "a b c d"])
    w = words.cut(column, 0, 4, words.NOT_BLANK)
    value, first = words.runs(w.hashes(), w.doc, 3)
    assert w.doc[first].tolist() == [0, 3, 3]
    assert value[0] == value[1] != value[2]


def test_slices_cover_all_rows_and_sliced_columns():
    column = pa.array(["x" * n for n in (5, 0, 30, 1, 9)])
    assert list(words.slices(column, 10)) == [(0, 2), (2, 3), (3, 5)]
    part = column.slice(2, 3)
    w = words.cut(part, 1, 3, words.NOT_BLANK)
    assert (w.ends - w.starts).tolist() == [1, 9]


def test_a_slice_over_the_table_of_powers():
    long = "ab " * (words.CHUNK_BYTES // 2)
    w = words.cut(pa.array([long, "ab"]), 0, 2, words.NOT_BLANK)
    assert len(np.unique(w.hashes())) == 1
