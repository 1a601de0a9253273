import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from cartomill.llm.suffix_dedup import HotAnchor, deduplicated, long_stretches, repeated_windows, shard_spans

from .cases import SCHEMA, crowded, rows, text

WIDTH = 200


def brute(data):
    bodies = [(d, (t or "").encode()) for d, t, *_ in data]
    seen = Counter(b[i : i + WIDTH] for _, b in bodies for i in range(len(b) - WIDTH + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - WIDTH + 1):
            if seen[b[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = b"\1" * WIDTH
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out.append((d, len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    """Documents that share passages of about the window's length, with edits, at random places."""
    rng = random.Random(seed)
    shared = [text(rng, 200)[:n] for n in (150, 199, 200, 201, 260, 500)]
    data = []
    for i in range(60):
        part = rng.choice(shared)
        if rng.random() < 0.3:
            at = rng.randrange(len(part))
            part = part[:at] + "#" + part[at + 1 :]
        data.append((i, text(rng, rng.randrange(50)) + part + text(rng, rng.randrange(50)) + (rng.choice(shared) if rng.random() < 0.5 else ""), None, None, None))
    return data + [(None, data[1][1], None, None, None), (100, "ab" * 400, None, None, None), (101, "q" * 260, None, None, None), (102, "é" * 300, None, None, None)]


def test_repeated_windows():
    rng = random.Random(0)
    base = bytes(rng.randrange(97, 101) for _ in range(700))
    bodies = [base[:300], base[50:400], b"x" + base[100:310], base[500:], b"zz" * 180]
    seen = Counter(b[i : i + WIDTH] for b in bodies for i in range(len(b) - WIDTH + 1))
    for memory in (50, 1 << 20):
        got = repeated_windows(bodies, memory)
        assert [g.tolist() for g in got] == [[i for i in range(len(b) - WIDTH + 1) if seen[b[i : i + WIDTH]] > 1] for b in bodies]


def test_against_brute_force(spark):
    short = [r for r in rows() if len(r[1] or "") < 5000]
    for data in (short, passages(1), passages(2)):
        assert sorted(map(tuple, deduplicated(crowded(spark, data)).collect()), key=str) == brute(data)


def test_texts_of_a_doc_id_that_collide_in_32_bits(spark):
    rng = random.Random(11)
    long, short = "".join(rng.choices("abcdefghij ", k=500)), "".join(rng.choices("klmnopqrst ", k=230))
    data = [(None, long + "13169"), (None, short + "283582"), (1, "one " + long[150:]), (2, "two " + short)]
    data = [(d, t, None, None, None) for d, t in data]
    docs = crowded(spark, data)
    assert docs.where("doc_id IS NULL").selectExpr("hash(text) AS h").distinct().count() == 1
    assert sorted(map(tuple, deduplicated(docs).collect()), key=str) == brute(data)


def test_bytes_whose_polynomial_hashes_are_equal(spark):
    """Strings by the parity of the bits of their places, and their complements, hash alike modulo 2**64."""
    a, b = ("".join("ab"[(i.bit_count() + x) % 2] for i in range(2048)) for x in (0, 1))
    data = [(1, a[:1024] + "-" + a, None, None, None), (2, b[:1024] + "+" + b, None, None, None), (3, "x" * 60 + a, None, None, None)]
    assert sorted(map(tuple, deduplicated(crowded(spark, data)).collect()), key=str) == brute(data)


def test_long_texts_are_cut_into_blocks():
    body = bytes(random.Random(6).choices(range(97, 100), k=3000))
    seen = []
    for _, _, _, _, *places in long_stretches(body, block=700):
        seen += [i + m * step for f, k, step, times in zip(*(c.tolist() for c in places)) for m in range(times) for i in range(f, f + k)]
    assert sorted(seen) == list(range(3000 - WIDTH + 1))


def periodic_texts():
    rng = random.Random(3)
    unit = lambda p: "".join(rng.choices("abcdef", k=p))
    data = []
    for p in (1, 2, 3, 63, 64, 65, 136, 137, 138, 150, 199, 200, 201, 290):
        body = unit(p) * (2400 // p)
        at = rng.randrange(len(body))
        data += [unit(30) + body + unit(40), body[:at] + "#" + body[at + 1 :], body[:330], unit(5) + body[: 200 + p // 2], body[7 : 7 + 199]]
    data += ["x" * 330, "x" * 201, "x" * 200 + "y", "ab" * 120 + "ba" * 120, (unit(90) + "z" * 300) * 4]
    return [(i, t, None, None, None) for i, t in enumerate(data)]


def test_periodic_texts(spark):
    data = periodic_texts()
    assert sorted(map(tuple, deduplicated(crowded(spark, data)).collect()), key=str) == brute(data)


def test_periodic_texts_one_at_a_time():
    """The places of all windows are there, whatever is joined, and joined ones are equal."""
    for _, t, *_ in periodic_texts():
        body = t.encode()
        for block in (500, 1 << 20):
            places, texts = [], {}
            for who, h, s1, s2, *rest in long_stretches(body, block):
                for key, f, k, step, times in zip(zip(h.tolist(), s1.tolist(), s2.tolist()), *(c.tolist() for c in rest)):
                    for m in range(times):
                        places += range(f + m * step, f + m * step + k)
                        assert texts.setdefault(key, body[f + m * step : f + m * step + k + WIDTH - 1]) == body[f + m * step : f + m * step + k + WIDTH - 1]
            assert sorted(places) == list(range(len(body) - WIDTH + 1))


def test_long_repetitive_text_has_few_rows():
    for body in (b"a" * (8 << 20), bytes(random.Random(1).choices(range(97, 123), k=150)) * 55_000):
        assert sum(len(part[0]) for part in long_stretches(body)) < 200


def batches_of(rows):
    for i in range(0, len(rows), 500):
        part = rows[i : i + 500]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([-r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary())], names=["hash", "s1", "s2", "body"])


def spans_of(rows, **options):
    return sorted((r["hash"], r["s1"], str(r["spans"])) for b in shard_spans(batches_of(rows), **options) for r in b.to_pylist())


def test_hot_anchor_on_disk():
    rng = random.Random(9)
    rows = []
    for anchor in range(6):  # anchors share no windows
        base = bytes(rng.choices(range(97, 101), k=900))
        for i in range((3, 40, 2, 60, 1, 30)[anchor]):
            a = rng.randrange(600)
            rows.append((anchor, i, base[a : a + rng.randrange(200, 300)] + bytes(rng.choices(range(97, 123), k=rng.randrange(100)))))
    want = spans_of(rows)
    assert want and all(spans_of(rows, hot=hot) == want for hot in (100, 1000, 9000))
    # windows whose hashes collide are told apart
    data = np.frombuffer(base[:200] + b"x" * 200 + base[:200], dtype=np.uint8)
    hit = np.zeros(600, dtype=bool)
    HotAnchor._bucket(np.array([[5, 0], [5, 200], [5, 400]], dtype=np.uint64), data, hit)
    assert np.flatnonzero(hit).tolist() == [0, 400]


def test_hot_anchor_takes_bounded_memory():
    data = np.random.default_rng(1).integers(97, 101, (40_000, 300), dtype=np.uint8)  # 12 MB of one anchor
    data[-1] = data[0]
    data[-1, 250] = 120
    rows = [(1, i, body.tobytes()) for i, body in enumerate(data)]
    tracemalloc.start()
    found = spans_of(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[1] for f in found] == [0, 39_999] and peak < 300 << 20


def test_no_documents(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
