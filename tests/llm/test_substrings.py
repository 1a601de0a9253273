import hashlib
import random

import numpy as np

from cartomill.llm import substrings
from cartomill.llm.common import window_minima
from cartomill.llm.common import shared_dir
from cartomill.llm.substrings import FingerprintIndex, kept, keyed, long_stretches

from .cases import SCHEMA, crowded, rows, text


def brute(data, width=50):
    where = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in data]
    for d, w in words:
        for i in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[i : i + width])
                where[key] = min(where.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and where[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        rest = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    """Documents that share passages of lengths about the window, at random places."""
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (20, 49, 50, 51, 80, 200)]
    data = []
    for i in range(50):
        parts = [text(rng, rng.randrange(60)), rng.choice(shared), text(rng, rng.randrange(60)), rng.choice(shared) if rng.random() < 0.5 else ""]
        data.append((rng.randrange(60), " ".join(parts), None, None, None))
    return data + [(None, data[0][1], None, None, None), (7, "w " * 400, None, None, None), (3, "w " * 90, None, None, None)]


def test_window_minima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    values[rng.integers(0, 300, 100)] = values[5]
    for width in (1, 3, 50, 300, 301):
        got = window_minima(values, width)
        top = values & ~np.uint64(511)
        assert got.tolist() == [i + int(np.argmin(top[i : i + width])) for i in range(300 - width + 1)]


def test_against_brute_force(spark):
    for data in (rows(), passages(1), passages(2)):
        got = kept(crowded(spark, data))
        assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_index_is_reopened_and_compacted(spark):
    """Ten small batches, each by an index opened anew, lose what one run loses; a batch moves nothing of history."""
    data = [r for r in passages(3) if r[0] is not None]
    docs = keyed(crowded(spark, data))
    path = f"{shared_dir(spark)}/index-test"
    lost = {}
    for lo in range(0, 60, 6):
        index = FingerprintIndex(spark, path, most_runs=3)
        _, spans = index.insert(docs.where(f"doc_id >= {lo} AND doc_id < {lo + 6}"))
        assert len(index.runs) <= 3 and index.version > 0
        for r in spans.collect():
            lost.setdefault(r.doc_id, []).append(sorted({w for s in r.spans for w in range(s.a, s.b)}))
    again = FingerprintIndex(spark, path)
    assert again.runs == index.runs and again.buckets == index.buckets
    plan = again.history("run")[0].join(again.history("run")[1].select("hash").distinct(), "hash", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    want = {}
    for d, n, gone, _ in brute(data):
        if gone:
            want.setdefault(d, []).append(gone)
    assert {d: sorted(map(len, x)) for d, x in lost.items()} == {d: sorted(set(x)) if len(x) > len(lost[d]) else sorted(x) for d, x in want.items()}
    again.delete()


def test_batches_and_compaction_change_nothing(spark):
    data = passages(4)
    for batches, most in ((1, 4), (6, 2)):
        assert sorted(map(tuple, kept(crowded(spark, data), batches, most_runs=most).collect()), key=str) == brute(data)


def test_words_whose_polynomial_hashes_are_equal(spark):
    """A word and its complement of 2,048 letters by the parity of the bits of their places hash alike modulo 2**64."""
    a, b = ("".join("ab"[(i.bit_count() + x) % 2] for i in range(2048)) for x in (0, 1))
    rest = " ".join(f"word{i}" for i in range(49))
    data = [(1, f"{a} {rest}", None, None, None), (2, f"{b} {rest}", None, None, None), (3, f"{a} {rest} more", None, None, None)]
    assert sorted(map(tuple, kept(crowded(spark, data)).collect()), key=str) == brute(data)


def test_long_texts_are_hashed_in_blocks():
    rng = random.Random(5)
    words = [rng.choice("ab") + str(rng.randrange(200)) for _ in range(900)]
    body = " \n".join(words).encode()
    seen = []
    for _, _, _, _, first, n in long_stretches(body, block=100):
        seen += [i for f, k in zip(first.tolist(), n.tolist()) for i in range(f, f + k)]
    assert seen == list(range(900 - 49))


def test_no_documents(spark):
    assert kept(spark.createDataFrame([], SCHEMA)).count() == 0
    assert substrings.stretches([b"", b"a"])[0].size == 0
