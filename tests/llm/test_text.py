"""The text kernel against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import rules
from tidemill.llm import text as T

TEXT = st.text(alphabet="abAB \n\t#|é漢1", max_size=60)


def cut(x):
    return x.encode().lower().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_of_any_slicing(texts, limit):
    got = [[] for _ in texts]
    for s in T.slices(pa.array(texts, pa.string()), limit):
        w = T.words(s)
        for d, a, n in zip(w.doc, w.start, w.size, strict=True):
            got[s.first + d].append(s.buf[a : a + n].tobytes().lower())
    assert got == [cut(t or "") for t in texts]


def test_equal_words_have_equal_hashes_and_others_not():
    s = next(T.slices(pa.array(["Ab ab aB b a ba abc " + "z" * 5000, "ab"])))
    h = T.words(s).hash
    assert len(set(h[:3].tolist()) | {h[-1]}) == 1 and len(set(h.tolist())) == 6


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_base_counts(texts):
    s = next(T.slices(pa.array(texts)))
    got = rules.base_counts(s)
    for i, t in enumerate(texts):
        w = cut(t)
        raw = t.encode().split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {x for x in windows if windows.count(x) > 1}
        covered = {k + j for k, x in enumerate(windows) if x in twice for j in range(8)}
        full = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in raw), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered))
        assert tuple(int(v[i]) for v in got.values()) == want


def test_ngrams_stay_inside_a_text():
    s = next(T.slices(pa.array(["a b c", "d e"])))
    w = T.words(s)
    assert len(T.ngrams(w.doc, w.hash, 3)[0]) == 1 and len(T.ngrams(w.doc, w.hash, 2)[0]) == 3


def test_sliced_and_chunked_arrays():
    a = pa.chunked_array([pa.array(["x y", None, "z"]).slice(1), pa.array(["q"])])
    assert sum(T.words(s).per_doc(s.n).sum() for s in T.slices(a)) == 2
    assert list(T.slices(pa.array([], pa.string()))) == []
    assert np.array_equal(T.mix(np.array([1], np.uint64)), T.mix(np.array([1], np.uint64)))
