import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from focuslake.llm.words import repeat_ranges, run_hashes, slices, span_hashes, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t.é文", max_size=12)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_are_runs_between_ascii_white_space(texts, limit):
    found = []
    for s in slices(pa.array(texts, pa.string()), limit):
        w = words(s)
        for i in range(s.rows):
            found.append([s.data[a:z].tobytes().decode() for a, z in zip(w.start[w.row[i]:w.row[i + 1]], w.end[w.row[i]:w.row[i + 1]])])
    assert found == [[x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x] for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes(texts):
    seen = {}
    for s in slices(pa.array(texts, pa.string()), 16):
        w = words(s)
        for a, z, h, f in zip(w.start, w.end, span_hashes(s, w.start, w.end), span_hashes(s, w.start, w.end, fold=True)):
            word = s.data[a:z].tobytes()
            assert seen.setdefault(word, h) == h
            assert seen.setdefault(("folded", bytes(word.replace(b"B", b"b"))), f) == f
    assert len(set(seen.values())) >= len({k for k in seen if isinstance(k, bytes)})


def test_runs():
    h = np.arange(1, 7, dtype=np.uint64)
    a = run_hashes(np.concatenate([h, h]), np.array([0, 6, 1]), np.array([3, 9, 3]))
    assert a[0] == a[1] != a[2]
    assert repeat_ranges(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
