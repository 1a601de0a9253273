import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cartomill.llm.pii import base_spans, contexts, personal_data, sanitised, words_before

from .cases import SCHEMA, crowded, frame, rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow(text):
    out = []
    for k, (kind, rx) in enumerate(PATTERNS.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and slow_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PARTS = st.sampled_from([*"ab@@..0123456789 -+()é\n", "a.b@c.de", "10.0.0.1", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (202) 555-0101", "00000000000000", "x@y.", "1.2.3.4.5.6.7.8"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert base_spans(text) == [(a, k, b) for a, k, b, _ in slow(text)]


def test_long_runs_are_quick():
    for text in ("y" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "1 " * 100_000):
        base_spans(text)


def digest(text):
    s = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in slow(text))
    return hashlib.sha256(s.encode()).hexdigest(), s


def test_against_patterns(spark):
    rng = random.Random(3)
    data = rows() + [(5000 + i, f"é mail {rng.choice('abc')}{i}@ex.org call +44 20 7946 {1000 + i} or 10.0.{i}.{i * 9}", None, None, None) for i in range(30)]
    got = personal_data(crowded(spark, data)).collect()
    want = []
    for d, t, *_ in data:
        found = slow(t)
        want.append((d, *(sum(x[3] == k for x in found) for k in PATTERNS), *digest(t)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def planted():
    """One address is always near one rare name, in different contexts; common words are near it too."""
    rng = random.Random(1)
    common = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    words = lambda n: " ".join(rng.choices(common, k=n))
    data = [(i, f"{words(12)} Zebedee {words(2)} joan@home.example {words(12)}", "en", "s", None) for i in range(6)]
    data += [(100 + i, words(60), "en", "s", None) for i in range(300)]
    # copies of one context are no evidence
    data += [(900 + i, "unusual passage beside carol@work.example stays", "en", "s", None) for i in range(20)]
    return data


def test_disclosing_terms(spark):
    data = planted()
    got = {r.doc_id: r for r in personal_data(frame(spark, data)).collect()}
    for d, t, *_ in data[:6]:
        a = t.index("Zebedee")
        assert f"removed:{a}:{a + 7}" in got[d].spans.split(",") and got[d].n_email == 1
        assert len(got[d].spans.split(",")) == 2
    assert all(got[d].spans == digest(t)[1] for d, t, *_ in data[6:])


def test_copies_and_rare_terms_disclose(spark):
    rng = random.Random(4)
    common = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    words = lambda n: " ".join(rng.choices(common, k=n))
    beside = lambda name, mail: f"{words(12)} {name} {words(2)} {mail} {words(12)}"
    hot = [beside("Zebedee", "joan@home.example") for _ in range(3)]
    data = [(i, t, "en", "s", None) for i, t in enumerate(hot + hot[:1] * 200)]  # three contexts, one with many copies
    data += [(1000 + i, beside("Ozymandias", "tom@home.example"), "en", "s", None) for i in range(2)]
    data += [(2000 + i, beside("Lancelot" if i < 2 else "", f"kay{min(i, 2)}@home.example"), "en", "s", None) for i in range(3)]  # one context for each value
    data += [(3000 + i, words(60), "en", "s", None) for i in range(1000)]
    got = {r.doc_id: r for r in personal_data(frame(spark, data)).collect()}
    for d, t, *_ in data:
        want = [digest(t)[1]] if digest(t)[1] else []
        for name in ("Zebedee", "Ozymandias"):
            if name in t:
                want = [f"removed:{t.index(name)}:{t.index(name) + len(name)}", *want]
        assert got[d].spans == ",".join(want)


def test_contexts_are_whole_words():
    long = [c * 40 for c in "abcdefgh"]
    text_ = " ".join(["x" * 500, *long, "joan@home.example", *long[::-1], "y" * 500])
    a = text_.index("joan")
    [(_, _, terms)] = contexts(text_, [(a, 0, a + len("joan@home.example"))])
    assert terms == sorted(long)
    assert words_before("a" * 9000 + " b c", 9004, 8) == ["a" * 9000, "b", "c"]


def test_clashing_names(spark):
    docs = frame(spark, planted()).withColumns({c: F.lit("clash") for c in ("__key", "__k", "__terms", "row", "t", "kt", "terms", "term", "c")})
    out = sanitised(docs)
    assert out.columns == docs.columns and out.where("terms = 'clash' AND t = 'clash'").count() == docs.count()


def test_sanitised(spark):
    docs = crowded(spark, planted() + rows())
    out = sanitised(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert "Zebedee" not in got[0].text and "joan" not in got[0].text and "[email]" in got[0].text
    assert got[900].text == "unusual passage beside [email] stays" and got[900].n_chars == len(got[900].text)
    assert planted()[6][1] in {r.text for r in out.collect()} and out.count() == docs.count()


def test_no_documents(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sanitised(spark.createDataFrame([], SCHEMA)).count() == 0
