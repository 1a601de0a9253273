"""Documents for the tests: random texts, copies, near copies and the edge cases that every operator defines."""

import random

WORDS = "the of and a wind river stone light über señal naïve 日本 walk green 42 x7 don't end. so, it's".split()


def text(rng: random.Random, n: int) -> str:
    return "".join(w + rng.choice([" ", " ", " ", " ", "\n", "  ", "\t"]) for w in rng.choices(WORDS, k=n)).strip()


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """doc_id, text, lang, source, n_chars."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            t = rng.choice(out)[1]
        elif kind < 0.35 and out:
            words = (rng.choice(out)[1] or "x").split()
            words[rng.randrange(len(words)) if words else 0 : 1] = ["changed"]
            t = " ".join(words)
        else:
            t = text(rng, rng.choice([1, 2, 3, 4, 30, 120, 300]))
        out.append((i * 3 + 1, t, rng.choice(["en", "de", None]), "s", len(t)))
    odd = [None, "", " ", "\n\n", "...", "a", "A b", " lead", "trail ", "a\n\nb", "a\n b", "a \nb", "x\ty", "x y z", "a b", "Ünï CÖDE", "́x y", "y" * 30_000, "w " * 20_000]
    out += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    out += out[:3]  # repeated rows
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def crowded(spark, data=None):
    """frame() with further columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    return frame(spark, data).withColumns({c: F.lit("clash") for c in ("fp", "comp", "fingerprint", "component_id", "ids", "part", "score", "spans", "start", "length", "n_words", "kept", "hash", "bucket", "windows", "__h", "__g", "__keep0", "Row", "tie", "None", "ID", "digest", "first", "a.b")})
