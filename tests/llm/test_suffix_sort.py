import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cartomill.llm import suffix_sort as S


def slow(text):
    t = [int(x) for x in text]
    return sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 200), max_size=60), st.sampled_from([1, 7, 1 << 20]))
def test_order(symbols, memory):
    text = np.array([*symbols, 0])
    assert S.sort_suffixes(text, memory=memory).tolist() == slow(text)


def test_repetitive_text_spills():
    rng = np.random.default_rng(0)
    part = rng.integers(2, 6, 300)
    text = np.concatenate([part, [1], part, [1], part[50:], np.full(200, 3), [1], part, [0]])
    assert S.sort_suffixes(text, memory=20).tolist() == slow(text)


def test_recursion_goes_down(monkeypatch):
    depth = []
    real = S.sorted_stars
    monkeypatch.setattr(S, "sorted_stars", lambda *a: depth.append(1) or real(*a))
    text = np.concatenate([np.tile([2, 1, 3, 1, 2, 2], 60), np.tile([1, 2, 3], 50), [0]])
    assert S.sort_suffixes(text).tolist() == slow(text)
    assert len(depth) > 1


def test_doubling():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 200), 0)
    assert S.doubled(text).tolist() == slow(text)
