import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cartomill.llm.decontaminate import Automaton, contamination, decontaminated, words_of

from .cases import SCHEMA, crowded, rows, text


def slow_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(t, items, window=13):
    words, hit, names = slow_words(t), set(), set()
    for name, item in items:
        w = slow_words(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def test_words():
    for _, t, *_ in rows():
        assert [w.decode() for w in words_of((t or "").encode())] == slow_words(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc ", max_size=12), max_size=5), st.text("abcd ", max_size=40))
def test_automaton(items, document):
    spread = lambda s: " ".join(s.replace(" ", ""))  # noqa: E731  each letter is a word
    items = [(f"i{k}", spread(i)) for k, i in enumerate(items)]
    a = Automaton([(n, words_of(i.encode())) for n, i in items], window=4)
    words = words_of(spread(document).encode())
    spans, found = a.hits(words)
    covered = {i for x, y in spans for i in range(x, y)}
    want = brute(spread(document), items, 4)
    assert (len(words), len(covered), len({a.names[i] for i in found})) == want[:3]


def benchmark(rng):
    return [(i, text(rng, n)) for i, n in enumerate((1, 5, 12, 13, 14, 40, 60))] + [(7, ""), (8, "..."), (9, None), (3, "other text for a repeated id"), (10, None)]


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, t) for i, t in benchmark(rng) if i not in (0, 1)]
    data = [r for r in rows() if len(r[1] or "") < 5000]
    data += [(2000 + i, text(rng, 30) + " " + (rng.choice(items)[1] or "") + " " + text(rng, rng.choice([2, 500])), None, None, None) for i in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10, 1_000_000):
        got = contamination(crowded(spark, data), bench, block=block).drop("spans").collect()
        want = sorted(((d, *brute(t, [(n, i or "") for n, i in items])) for d, t, *_ in data), key=str)
        assert sorted(map(tuple, got), key=str) == want
    kept = decontaminated(crowded(spark, data), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5]) and len(kept.columns) == len(crowded(spark, data).columns)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(crowded(spark), none).where("n_hit > 0 OR contaminated").count() == 0
    assert contamination(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_long_spans_are_cut(spark):
    """Under the coverage limit, matched spans of LONG_SPAN words go and shorter ones stay, by one block or by many."""
    rng = random.Random(7)
    long, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 60), ("s", 30)))
    bench = spark.createDataFrame([(1, long), (2, short), (3, "and more items here to fill blocks")], "item_id long, text string")
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = filler(1500), filler(700), filler(20)
    data = [(1, f"{a}, {long}! {b}", "en", "s", 5), (2, f"{a} {short} {b}", "en", "s", 5), (3, f"{c} {long}", "en", "s", 5), (4, f"{c} é", "en", "s", 5), (5, None, None, None, None)]
    for block in (10, 1_000_000):
        got = {r.doc_id: r for r in decontaminated(crowded(spark, data), bench, block=block).collect()}
        assert {d: r.text for d, r in got.items()} == {1: f"{a}, ! {b}", 2: data[1][1], 4: f"{c} é", 5: None}
        assert got[1].n_chars == len(got[1].text) and got[5].n_chars is None


def test_automaton_is_flat():
    rng = random.Random(3)
    a = Automaton([(i, [f"w{rng.randrange(20_000)}".encode() for _ in range(100)]) for i in range(100)])
    arrays = sum(x.nbytes for x in a.__dict__.values() if hasattr(x, "nbytes"))
    assert arrays < 100 * 10_000 and not any(isinstance(x, list) and len(x) > 100 for x in a.__dict__.values())


def test_items_without_an_id_hit(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, item), (4, "some other item of few words")], "item_id long, text string")
    docs = crowded(spark, [(1, f"before {item} after", None, None, None), (2, "clean text", None, None, None), (3, f"{item} some other item of few words", None, None, None)])
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, bench).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (20, 0, digest(""), True), 2: (0, 0, digest(""), False), 3: (26, 1, digest("4"), True)}
    assert [r.doc_id for r in decontaminated(docs, bench).collect()] == [2]
