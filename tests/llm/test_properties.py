"""Round trips and small searches on generated cases."""

import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import chat, sentencepieces, substrings, tokens

settings.register_profile("here", deadline=None)
settings.load_profile("here")

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("\\ehc</turn># :\n", max_size=30)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_what_is_rendered_reads_back(turns):
    assert chat.read_back(chat.render(turns)) == turns


@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_spans_hold_their_turns(turns):
    found = chat.locate(chat.render, turns)
    assert found.rewritten_at == -1
    assert [chat.unescape(found.text[a:b]) for a, b in found.contents] == [t for _, t in turns]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_hashes_unpack(values):
    values = np.sort(np.array(values, np.uint64))
    assert (substrings.unpack(substrings.pack(values)) == values).all()


@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_those_of_split(texts):
    data, offsets = tokens.column_bytes(pa.array(texts, pa.string()))
    starts, ends, of = tokens.words(data, offsets)
    got = [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(of[:-1], of[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    h = tokens.span_hashes(data, starts, ends)
    words = [w for ws in got for w in ws]
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_windows_stay_in_their_texts(texts, n):
    data, offsets = tokens.column_bytes(pa.array(texts, pa.string()))
    _, _, of = tokens.words(data, offsets)
    want = [i for a, b in zip(of[:-1], of[1:], strict=True) for i in range(a, b - n + 1)]
    assert np.flatnonzero(tokens.whole_windows(of, n)).tolist() == want


@settings(max_examples=40)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_choices_down_the_tree_are_a_best_path(n, seed):
    rng = np.random.default_rng(seed)
    sizes = [1, *rng.integers(1, 4, n - 1).tolist(), 1]
    matrices = [np.where(rng.random((a, b)) < 0.8, rng.integers(-5, 0, (a, b)).astype(float), -np.inf) for a, b in itertools.pairwise(sizes)]
    weight = lambda path: sum(m[i, j] for m, (i, j) in zip(matrices, itertools.pairwise(path), strict=True))
    best = max(weight(p) for p in itertools.product(*map(range, sizes)))
    if best == -np.inf:
        return
    chosen = sentencepieces.choose_states(matrices)
    assert all(a[1] == b[0] for a, b in itertools.pairwise(chosen))
    assert weight([chosen[0][0], *(j for _, j in chosen)]) == best
