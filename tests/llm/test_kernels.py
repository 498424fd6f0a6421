import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cropcube.llm import kernels as K

TEXT = st.text(alphabet="aAbB9 \t\nz.é中", max_size=40)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_as_the_expressions_say(texts):
    raw, offsets = K.texts_of(pa.array(texts, pa.string()))
    for table, pattern in ((K.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (K.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        s, e, first = K.word_bounds(raw, offsets, table)
        got = [[raw[a:b].tobytes().decode() for a, b in zip(s[x:y], e[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
        assert got == [re.findall(pattern, t or "") for t in texts]


@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_shingles_tell_word_runs_apart(texts, k):
    raw, offsets = K.texts_of(pa.array(texts, pa.string()))
    s, e, first = K.word_bounds(raw, offsets, K.NOT_SPACE)
    h, at = K.shingles(K.span_hashes(raw, s, e), first, k)
    seen = {}
    for d, t in enumerate(texts):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
        got = h[at[d] : at[d + 1]].tolist()
        assert len(got) == len(want)
        for x, y in zip(got, want, strict=True):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_packing_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (K.unpack(K.pack(v)) == v).all()


def test_groups_cover_everything():
    offsets = np.array([0, 0, 10, 10, 5000, 5001, 5001])
    parts = list(K.groups(offsets, 100))
    assert [i for i, _ in parts][0] == 0 and parts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_long_words_hash_as_short_pieces_do():
    raw = np.frombuffer(b"x" * (K.PIECE + 100) + b" yy", np.uint8)
    s, e, _ = K.word_bounds(raw, np.array([0, len(raw)]), K.NOT_SPACE)
    h = K.span_hashes(raw, s, e)
    t = K.span_hashes(np.frombuffer(b"yy", np.uint8), np.array([0]), np.array([2]))
    assert h[1] == t[0] and h[0] != h[1]
