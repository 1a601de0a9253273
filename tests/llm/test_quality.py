import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from cartomill.llm import quality as Q

from .cases import SCHEMA, crowded, rows


def slow_base(text):
    text = text or ""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    words = [w for w in re.split(f"[{space}]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(f"[^{space}]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = [False] * len(words)
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            repeated[i : i + 3] = [True] * 3
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(repeated), n < 50 or 100 * sum(repeated) > 50 * n


def test_base_counts():
    for _, t, *_ in rows() + [(0, "a a a a a", *[None] * 3), (0, "x\nx\n\n \nx y\nx", *[None] * 3), (0, "# * a|b <é>", *[None] * 3), (0, "é\x1cö ü a", *[None] * 3)]:
        got = Q.base_counts((t or "").encode())
        assert got == slow_base(t)[:5]


def folded(text):
    out = ""
    for c in text or "":
        c = c.lower() if c.isalpha() and len(c.lower()) == 1 else "0" if c.isdecimal() else " " if c != "\n" and (ord(c) < 32 or ord(c) == 127) else c
        if not (out and out[-1] == c and not (c.isalpha() or c.isdecimal())):
            out += c
    return out


def slow_model(texts, order=Q.ORDER):
    """Modified Kneser-Ney by dictionaries: the log probability of an n-gram's last character after the others."""
    level = {order: Counter()}
    for t in texts:
        t = chr(Q.PAD) * (order - 1) + t
        level[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    p = {"": 1 / (len(level[1]) + 1)}
    for k in range(1, order + 1):
        n = [0] + [sum(c == i for c in level[k].values()) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        d = [0.0] + [max(0.05, min(i - 0.01, i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i)) for i in (1, 2, 3)]
        total, left = Counter(), defaultdict(float)
        for g, c in level[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        p = {g: (c - d[min(c, 3)] + left[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, c in level[k].items()}
    return {g: -round(-math.log(x) * Q.FINE) / Q.FINE for g, x in p.items()}


def slow_quality(data):
    """log perplexity and the verdict of each row."""
    by = defaultdict(list)
    for i, (_, t, lang, *_) in enumerate(data):
        by[lang].append((i, folded(t)))
    score, length = {}, {}
    for own in by.values():
        model = slow_model([t for _, t in own])
        for i, t in own:
            padded = chr(Q.PAD) * (Q.ORDER - 1) + t
            length[i] = len(t).bit_length()
            if t:
                score[i] = -sum(model[padded[k : k + Q.ORDER]] for k in range(len(t))) / len(t)
    failed = [slow_base(t)[5] for _, t, *_ in data]
    kept = []
    for i, (_, _, lang, *_) in enumerate(data):
        every = [j for j, _ in by[lang] if j in score and not failed[j]]
        near = [j for j in every if length[j] == length[i]]
        own = sorted(round(score[j] * Q.STEPS) for j in (near if len(near) >= Q.FEW else every))
        if failed[i] or i not in score:
            kept.append(False)
            continue
        q = [own[math.ceil(x * len(own)) - 1] / Q.STEPS for x in (0.1, 0.5, 0.9)]
        low, high = q[1] - max(Q.LEAST_HALF, Q.BAND * (q[1] - q[0])), q[1] + max(Q.LEAST_HALF, Q.BAND * (q[2] - q[1]))
        kept.append(low <= round(score[i] * Q.STEPS) / Q.STEPS <= high)
    return score, kept


def invented(seed, lang, n, stems):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(stems, k=rng.randrange(1, 4)))
    return [(seed * 10_000 + i, " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.choice([60, 120, 400]))), lang, "s", None) for i in range(n)]


STEMS = {"en": ["the", "ing", "er", "st", "and", "on", "ly", "re"], "fr": ["é", "que", "ou", "ai", "ment", "le", "tion"], "ру": ["при", "ста", "ть", "но", "ка", "го", "ел"], "日": list("日本語文字列学習山川")}


def test_scores_and_verdicts_by_brute_force(spark):
    """Of every language, also of letters outside ASCII; symbol-laced texts and tables of fragments are rejected."""
    data, junk = rows(), []
    for seed, (lang, stems) in enumerate(STEMS.items(), 1):
        good = invented(seed, lang, 80, stems)
        rng = random.Random(seed)
        laced = " ".join(w + rng.choice(["###", "&&&", "$$$", "%%%", "***"]) for w in good[0][1].split())
        table = " | ".join(good[1][1].split())
        junk += [(seed * 10_000 + 900 + i, t, lang, "s", None) for i, t in enumerate((laced, table))]
        data += good
    data += junk
    found = sorted(((r.doc_id, r.n_words, r.word_chars), r) for r in Q.quality(crowded(spark, data)).select("doc_id", "n_words", "word_chars", "log_perplexity", "kept").collect())
    score, kept = slow_quality(data)
    want = sorted(((d, *slow_base(t)[:2]), i) for i, (d, t, *_) in enumerate(data))
    assert [k for k, _ in found] == [k for k, _ in want]
    for (_, r), (_, i) in zip(found, want):
        assert (r.log_perplexity is None) == (i not in score) and (i not in score or abs(r.log_perplexity - score[i]) < 1e-4)
        assert r.kept == kept[i] or abs(score[i] * Q.STEPS % 1 - 0.5) < 0.1
    by_id = {r.doc_id: r.kept for _, r in found}
    assert not any(by_id[d] for d, *_ in junk)
    good = [by_id[d] for d, *_ in data if 10_000 <= d and d % 10_000 < 900]
    assert sum(good) >= 0.95 * len(good)


def test_ngrams_of_large_alphabets():
    """More characters than a code's bits hold: ranks instead of packed codes, with the same n-grams."""
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9000)), "", "abc", "𝔞𝔟" * 5]
    points, lengths = Q.points_of([t.encode() for t in texts])
    codes, different, counts, grams = Q.ngrams(points)
    want = Counter()
    for t in map(folded, texts):
        t = chr(Q.PAD) * (Q.ORDER - 1) + t
        want.update(t[i : i + Q.ORDER] for i in range(len(t) - Q.ORDER + 1))
    assert {"".join(map(chr, g)): n for g, n in zip(grams.tolist(), counts.tolist())} == want
    assert lengths.tolist() == [len(folded(t)) for t in texts] and len(codes) == lengths.sum() and (np.diff(different) > 0).all()


def test_ngrams_are_squeezed_without_loss():
    rng = np.random.default_rng(3)
    for size, top in ((1, 5), (70, 300), (5000, 0x10FFFF)):
        grams = rng.choice(rng.integers(0, top, size), (400, Q.ORDER)).astype(np.uint32)
        assert (Q.opened(Q.squeezed(grams), 400) == grams).all()
    for values in ([0], [0, 1 << 40, 7], [255, 256]):
        values = np.array(values, dtype=np.int64)
        assert (Q.from_planes(Q.planes(values), len(values)).astype(np.int64) == values).all()


def test_base_columns(spark):
    out = Q.quality(crowded(spark)).collect()
    want = sorted((d, *slow_base(t)) for d, t, *_ in rows())
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)


def test_no_documents(spark):
    assert Q.quality(spark.createDataFrame([], SCHEMA)).count() == 0
