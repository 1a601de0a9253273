import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cartomill.llm.simhash import allocated, components, fingerprint, links, near_duplicates, one_of_each, search_plan

from .cases import SCHEMA, crowded, frame, rows


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(data):
    """doc_id, fingerprint, component_id, by comparing all pairs."""
    fps = [(d, slow_fingerprint(t)) for d, t, *_ in data]
    distinct = sorted({f for _, f in fps})
    comp = {f: f for f in distinct}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                comp[find(a)] = find(b)
    least = {}
    for d, f in fps:
        least[find(f)] = min(least.get(find(f), d), d)
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in fps)


def test_fingerprint():
    for _, t, *_ in rows():
        assert fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_near_duplicates(spark):
    got = near_duplicates(crowded(spark))
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == brute(rows())


def groups(pairs, values):
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_links_connect_what_all_pairs_would(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = {c for c in centres} | {0}
    for c in centres * 12 + centres[:1] * 300:  # one large group
        for _ in range(rng.randrange(7)):
            c ^= 1 << rng.randrange(64)
        fps.add(c)
    values = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = list(map(tuple, links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()))
    assert set(got) <= want and len(set(got)) == len(got) and len(got) < len(want) / 3
    assert groups(got, values) == groups(want, values)


def test_plan_holds_the_pigeonhole(spark):
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9):
        sample = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        plan = search_plan(sample, n)
        x = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
        y = x.copy()
        for _ in range(4):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        found = np.zeros(len(x), dtype=bool)
        for part, t in plan:
            found |= np.bitwise_count((x ^ y) & np.uint64(sum(1 << b for b in part))) <= t
        assert found.all()


def test_thresholds_are_least():
    costs = np.array([[0.0, 1, 5, 9], [0, 4, 4.5, 30], [0, 2, 8, 9]])
    cost, chosen = allocated(costs, 0)
    assert sum(chosen) == 0 and cost == min(costs[0][a] + costs[1][b] + costs[2][c] for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_one_of_each(spark):
    data = [r for r in rows() if r[0] is not None]
    alone = "no id and like none of the others at all in any of its words"
    docs = crowded(spark, data + [(None, alone, None, None, None)] * 2 + [(None, data[0][1], None, None, None), (None, "", "en", None, None)])
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == sorted({c for _, _, c in brute(data)})
    assert [r.text for r in got.where(F.col("doc_id").isNull()).collect()] == [alone]  # the others have a row with an id


def test_one_of_each_keeps_different_texts_of_a_doc_id(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    data = [(7, t, "en", "s", None) for t in texts for _ in range(3)]  # a hot doc_id: unrelated texts, each with copies
    data += [(3, texts[0], "en", "s", None), (9, texts[1], "en", "s", None)]
    runs = [one_of_each(frame(spark, rows).repartition(n)) for n, rows in ((3, data), (5, data[::-1]))]
    got = [sorted((r.doc_id, r.text) for r in run.collect()) for run in runs]
    assert got[0] == got[1] == sorted([(3, texts[0])] + [(7, t) for t in texts[1:]])


def test_no_documents(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(frame(spark, [(None, None, None, None, None)])).count() == 1
