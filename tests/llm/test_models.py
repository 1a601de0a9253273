"""Trained operators: held-out accuracy on small planted corpora, and the edge cases."""

import random
import zlib

import numpy as np

from cartomill.llm import langid, toxicity

from .cases import SCHEMA, crowded

SYLLABLES = {"en": "the ing er st and on ly".split(), "de": "sch ung ein ich keit zu ä".split(), "fr": "eau é oi que ment la ç".split()}
NO_LETTER = ["²😀", "①😀", "½ 𝟏", "٣ ⅷ"]
INSULTS = ["grobnik", "zwulf", "plarkhead"]


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(2)
    data = [(i, words(rng, lang, rng.choice([6, 30, 120])), lang, "s", None) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]
    return data + [(5000, None, "en", "s", None), (5001, "", "en", "s", None), (5002, "12 !! 34", "en", "s", None), (5003, "日本語", None, "s", None), (5004, "x" * 50_000, None, None, None), *((6000 + i, t, None, None, None) for i, t in enumerate(NO_LETTER)), (5005, "𝔞𝔟", None, None, None), data[0]]


def test_languages(spark):
    data = corpus()
    got = langid.languages(crowded(spark, data)).collect()
    assert len(got) == len(data)
    truth = {d: lang for d, _, lang, *_ in data}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (5000, 5001, 5002, *range(6000, 6000 + len(NO_LETTER)))) and by[5003].lang_pred != "und" != by[5005].lang_pred


def test_mixture_proportions():
    rng = random.Random(3)
    counts = np.full((langid.BUCKETS, 2), langid.SMOOTHING)
    for k, lang in enumerate(("en", "fr")):
        counts[:, k] += np.bincount(langid.trigrams([words(rng, lang, 4000)])[0], minlength=langid.BUCKETS)
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    mixed = " ".join([words(rng, "en", 150), words(rng, "fr", 50)])
    codes, starts, owners = langid.trigrams(["", mixed, words(rng, "en", 80)])
    pi = langid.proportions(np.add.reduceat(table[codes], starts, axis=0), owners, 3)
    assert abs(pi[1, 0] - 0.75) < 0.06 and pi[2, 0] == 1 and pi[0].sum() == 0


def test_identified(spark):
    docs = crowded(spark, corpus())
    out = langid.identified(docs)
    assert out.columns == docs.columns and {5000, 5001, 5002, 6000}.isdisjoint(r.doc_id for r in out.collect()) and out.count() == docs.count() - 3 - len(NO_LETTER)


def test_untrained(spark):
    docs = crowded(spark, [(1, "some text", None, None, None)])
    assert langid.languages(docs).first().lang_pred == "und"
    assert langid.languages(spark.createDataFrame([], SCHEMA)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).first().score == 0.0
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0


def slow_kernel(s, t, n=toxicity.N, decay=toxicity.DECAY):
    from itertools import combinations

    def subsequences(x):
        out = {}
        for c in combinations(range(len(x)), n):
            if c[-1] - c[0] >= toxicity.SPAN:
                continue
            u = tuple(x[i] for i in c)
            out[u] = out.get(u, 0) + decay ** (c[-1] - c[0] + 1)
        return out

    a, b = subsequences(s), subsequences(t)
    return sum(w * b[u] for u, w in a.items() if u in b)


def test_kernel():
    strings = ["idiot", "id-iot", "abcabc", "xyz", "i", "日本語です", "idiotidiot"]
    got = toxicity.kernel(strings, strings)
    assert np.allclose(got, [[slow_kernel(a, b) for b in strings] for a in strings], rtol=1e-4)


def test_machine_is_a_nystroem_map():
    strings = ["idiot", "idiots", "abcabc", "xyzzy", "日本語です", "idiotidiot"]
    assert np.allclose(toxicity.own_kernel(strings), [slow_kernel(s, s) for s in strings], rtol=1e-5)
    m = toxicity.Machine(strings)
    k = np.array([[slow_kernel(a, b) for b in strings] for a in strings])
    assert np.allclose(m.similarities(strings), k / np.sqrt(np.diag(k)), rtol=1e-3)
    x = m.similarities(strings) @ m.whiten
    assert np.allclose(x @ x.T, k, rtol=1e-2, atol=1e-3)  # between landmarks the map gives back the kernel
    assert m.similarities(["", "q"]).tolist() == [[0] * 6] * 2


def test_toxicity(spark):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(700):
        own, bad = words(rng, "en", 40).split(), rng.random() < 0.3
        if bad:
            own.insert(rng.randrange(40), rng.choice(INSULTS) + rng.choice(["", "s", "!"]))
        data.append((i, " ".join(own), "en", "s", None))
        labels += [(i, int(bad))] * (1 + i % 2)
    data += [(9000, None, None, None, None), (9001, "", None, None, None), (9002, "g r o b n i k said they", None, None, None), (9003, "w " * 20_000, None, None, None), data[3]]
    got = toxicity.toxicity(crowded(spark, data), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9002].predicted == 1 and by[9000].predicted == by[9001].predicted == 0


def test_large_alphabets_take_little_memory():
    """Landmarks of a thousand different characters; the kernel by its definition."""
    import itertools
    import tracemalloc

    from cartomill.llm.toxicity import DECAY, SPAN, Landmarks

    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(1000)]
    strings = ["".join(letters[(13 * i + k) % 1000] for k in range(13)) for i in range(77)]
    tracemalloc.start()
    marks = Landmarks(strings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(marks.number) == 1000 and peak < 50 << 20

    def weights(s):
        out = {}
        for c in itertools.combinations(range(len(s)), 3):
            if c[-1] - c[0] < SPAN:
                key = "".join(s[i] for i in c)
                out[key] = out.get(key, 0.0) + DECAY ** (c[-1] - c[0] + 1)
        return out

    asked = [strings[5][2:9], "".join(rng.choices(letters, k=9)), strings[7][:4] + "x" + strings[7][4:8], "abc"]
    want = [[sum(w * b.get(k, 0.0) for k, w in weights(s).items()) for b in map(weights, strings)] for s in asked]
    assert np.allclose(marks.kernel(asked), want, rtol=1e-4) and marks.kernel(asked)[0, 5] > 0
