"""Phrases against plain counting of all n-grams, cuts and longer phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cartomill.llm import collocations as module
from cartomill.llm.collocations import collocations, packed, unpacked
from tests.llm.cases import crowded, frame

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                count.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    good = {key: f for key, f in count.items() if len(key[1]) > 1 and f >= least}
    around = Counter()
    for (lang, p), f in good.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                around[lang, p[i : i + m]] = max(around[lang, p[i : i + m]], f)
    out = []
    for (lang, p), f in good.items():
        if 100 * around[lang, p] >= 80 * f:
            continue
        score, _, l, r = min((2_000_000 * f // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -f, " ".join(p).encode(), l, r))
    result, rank = [], Counter()
    for lang, score, f, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], p.decode(), -f, l, r, n[lang], -score))
    return sorted(result)


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "b", "C", "ß", "日本", "x'", "#", "É"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
            continue
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", " ! "]) for _ in range(rng.choice([0, 1, 3, 20, 60])))
        out.append((text, rng.choice(["en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("w " * 3000, "en"), ("\x01 \x85   " * 20, "de"), ("A a " * 500, None)]


@pytest.mark.parametrize(("seed", "least", "top", "size", "bits"), [(1, 3, 1000, 50, 20), (2, 5, 7, 300, 2), (3, 30, 2000, 1 << 20, 20)])
def test_equals_plain_counting(spark, monkeypatch, seed, least, top, size, bits):
    monkeypatch.setattr(module, "PART_BITS", bits)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in collocations(df, least, top, size).select(*COLUMNS).collect())
    assert got == plain(rows, least, top)
    assert got


def test_packed_numbers():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 3_000) >> rng.integers(0, 62, 3_000)
    heads = np.unique(np.append(0, rng.integers(0, len(x), 40)))
    column = packed(x, heads)
    for a, b in ((0, len(heads)), (7, 20)):
        got, length = unpacked(column.slice(a, b - a))
        edges = np.append(heads, len(x))
        assert got.tolist() == x[edges[a] : edges[b]].tolist() and length.tolist() == np.diff(edges[a : b + 1]).tolist()
    assert [len(c) for c in unpacked(packed(x[:0], heads[:0]))] == [0, 0]


def test_columns_and_clashes(spark):
    got = collocations(crowded(spark), 2)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, collocations(frame(spark), 2).collect()))


def test_empty(spark):
    assert collocations(frame(spark, []), 2).collect() == []
    assert collocations(frame(spark, [(1, "a b", "en", "s", 3)]), 2).collect() == []
