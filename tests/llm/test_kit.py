import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import textkit as kit
from tidemark.llm.recompression import levels


def hashes(texts, split=kit.BLANK_SPLIT, fold=False, block=kit.BLOCK_BYTES):
    return [b.hashes[b.ptr[d] : b.ptr[d + 1]].tolist() for b in kit.blocks(pa.array(texts, pa.string()), split, fold, block) for d in range(b.docs)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé \n\tB.", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_are_those_of_bytes_split(texts, block):
    got = hashes(texts, block=block)
    want = [(t or "").encode().split() for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    known = {}
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert known.setdefault(b, a) == a
    assert len(set(known.values())) == len(known)


def test_long_text_over_several_blocks_equals_short_ones():
    words = [f"w{i % 977}" for i in range(400_000)]
    whole = hashes([" ".join(words)])[0]
    table = dict(zip([f"w{i}" for i in range(977)], sum(hashes([" ".join(f"w{i}" for i in range(977))]), []), strict=True))
    assert whole == [table[w] for w in words]


def test_fold_is_ascii_only():
    a, b, c, d = hashes(["ABC", "abc", "É", "é"], kit.ALNUM_SPLIT, True)
    assert a == b and c != d


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 12))
def test_rolling_hash_tells_windows_apart(values, k):
    h = np.array(values, dtype=np.uint64)
    got = kit.rolling(h, k).tolist()
    want = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(got) == max(0, len(want))
    seen = {}
    for g, w in zip(got, want, strict=True):
        assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) == len(seen)


def test_symbols_that_a_window_decides_are_the_same_wherever_it_stands():
    rng = random.Random(3)
    for alphabet in (2, 5, 50):
        core = [rng.randrange(alphabet) for _ in range(50)]
        docs = [[rng.randrange(alphabet) for _ in range(rng.randint(0, 40))] + core + [rng.randrange(alphabet) for _ in range(rng.randint(0, 40))] for _ in range(6)]
        views = []
        for d in docs:
            at = next(i for i in range(len(d)) if d[i : i + 50] == core)
            found = levels(np.array(d, dtype=np.uint64) + np.uint64(1000), np.array([0, len(d)]), 6, 2)
            views.append([sorted((int(n), int(a) - at, int(b) - at) for n, a, b in zip(x.name, x.lo, x.hi, strict=True) if a >= at and b <= at + 50) for x in found])
            assert all((np.diff(x.lo) >= 0).all() and (np.diff(x.hi) >= 0).all() for x in found)
        assert all(v == views[0] for v in views)
