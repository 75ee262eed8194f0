"""Quality rules, toxicity, personal data, secrets against brute force, and their edge cases."""

import collections
import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import pii, quality_rules, secrets, toxicity
from gatewarden.llm.common import free, table

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"
LONG = "abc def ghi jkl mno pqr stu vwx yz1 " * 3000


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(frame):
    random.seed(4)
    texts = [None, "", " \n\t", "a\n\na\n b\n b", "x y z " * 9, LONG, "é\u2003ü # *|<>", "\x1c a\x85b"]
    texts += ["".join(random.choice(["a", "b", " ", "\n", "c d e f g h i j "]) for _ in range(80)) for _ in range(40)]
    got = frame(list(enumerate(texts)), DOCS).select("doc_id", quality_rules.statistics(F.col("text")).alias("s")).collect()
    for r in got:
        s = r.s
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id]


def _labelled(frame, n=400):
    random.seed(6)
    rows = []
    for k in range(n):
        w = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(60)]
        bad = k % 4 == 0
        rows.append((k, " ".join(x + "$$$" if bad else x for x in w), int(bad)))
    return frame(rows, "doc_id bigint, text string, reject int")


def test_rules_are_learned(frame):
    rows = _labelled(frame)
    rules = quality_rules.fit(rows)
    assert rules.rules and all(len(r.literals) <= quality_rules.MAX_LITERALS for r in rules.rules)
    got = quality_rules.judge(rows, rules).select("reject", "quality.kept", "quality.rule").collect()
    assert sum(r.kept == (r.reject == 0) for r in got) >= 0.98 * len(got)
    assert all((r.rule is None) == r.kept for r in got)


def test_rules_edge_cases(frame):
    assert quality_rules.fit(frame([], "text string, reject int")).rules == ()
    assert quality_rules.fit(frame([("a b", 1), (None, 1), ("x", None)], "text string, reject int")).rules == ()
    docs = frame([(1, None, "q"), (1, None, "q"), (2, LONG, "r")], "doc_id bigint, text string, quality string")
    got = quality_rules.judge(docs, quality_rules.DecisionList(), to=free(docs, "quality"))
    assert got.count() == 3 and "quality" in got.columns
    assert quality_rules.judge(docs.filter("doc_id > 9"), quality_rules.DecisionList()).count() == 0


@data
def test_op1(spark):
    rows = quality_rules.op1(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept <= (not r.base_failed)


def _index(rows, documents=None):
    """The index over (id, label, counts), as the operator builds it."""
    terms = sorted({t for _, _, c in rows for t in c})
    number = {t: i for i, t in enumerate(terms)}
    counts = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, _, c in rows]
    df = collections.Counter(t for c in (documents or [c for _, _, c in rows]) for t in c)
    ids, labels = np.array([r[0] for r in rows]), np.array([int(r[1]) for r in rows], np.int8)
    return toxicity.built(ids, labels, counts, terms, np.array([df[t] for t in terms]), len(documents or rows), np.ones(len(rows), bool))


def _brute_weights(rows):
    """Weight of each term, and the unit vector of each (id, label, counts), from the definitions."""
    n, share = len(rows), sum(bool(r[1]) for r in rows) / len(rows)
    weight = {}
    for t in {t for _, _, c in rows for t in c}:
        held, yes = sum(t in c for _, _, c in rows), sum(t in c for _, y, c in rows if y)
        z = (yes - held * share) / math.sqrt(held * share * (1 - share) + 1)
        weight[t] = math.log((n + 2) / (held + 1)) * (1 + (z / 2) ** 2)

    def unit(counts):
        raw = {t: (1 + math.log(k)) * weight.get(t, math.log(n + 2)) for t, k in counts.items()}
        length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / length for t, x in raw.items()}

    return unit, {i: unit(c) for i, _, c in rows}


@pytest.mark.parametrize("share", [2, 25, 1000])
def test_nearest_is_exact(monkeypatch, share):
    monkeypatch.setattr(toxicity, "SHARE", share)
    rng = random.Random(8)
    terms = [f"t{k}" for k in range(12)] + [f"rare{k}" for k in range(300)]
    draw = lambda k: collections.Counter(rng.choices(terms, weights=[20] * 12 + [1] * 300, k=k))
    rows = [(k, k % 3 == 0, draw(rng.randint(0, 9))) for k in range(700)]
    index = _index(rows)
    unit, vectors = _brute_weights(rows)
    queries = [draw(5) + collections.Counter(["other"]) for _ in range(50)] + [collections.Counter(["other"]), collections.Counter()]
    got = index.nearest([index.vector(" ".join(q.elements())) for q in queries])
    for q, (cosines, numbers) in zip(queries, got, strict=True):
        v = unit(q)
        want = {i: sum(v.get(t, 0) * x for t, x in vectors[i].items()) for i in vectors}
        best = sorted([x for x in want.values() if x > 1e-12], reverse=True)[: toxicity.K]
        assert cosines.tolist() == pytest.approx(best, abs=1e-9)
        assert [want[int(index.ids[i])] for i in numbers] == pytest.approx(best, abs=1e-9)
        assert list(zip(-cosines, numbers, strict=True)) == sorted(zip(-cosines, numbers, strict=True))


def test_every_word_counts():
    """A copy of an example finds it, whatever its words; none is left out for its label or frequency."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows = [(k, k % 5 == 0, collections.Counter(word() for _ in range(20))) for k in range(200)]
    index = _index(rows)
    assert set(index.numbers) == {t for _, _, c in rows for t in c} and (index.weight > 0).all()
    for cosines, numbers in index.nearest([index.example(i) for i in range(200)]):
        assert cosines[0] == pytest.approx(1.0)
    for i, (_, numbers) in enumerate(index.nearest([index.example(i) for i in range(200)], but=list(range(200)))):
        assert i not in numbers


def test_long_texts_are_looked_up_in_small_runs(monkeypatch):
    monkeypatch.setattr(toxicity, "LONG", 10)
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    texts = ["a" * 4, None, "b" * 4, "c" * 4, "d" * 25, "", "e" * 9, "f"]
    runs = list(toxicity._together(iter(texts)))
    assert [x for r in runs for x in r] == texts
    assert [len(r) for r in runs] == [3, 1, 1, 3]


def test_toxicity_learns_and_calibrates(frame):
    random.seed(9)
    word = lambda: "".join(random.choice("abcde") for _ in range(5))
    rows = [(k, int(k % 6 == 0), " ".join([word() for _ in range(30)] + (["beastly", "vilexyz"] if k % 6 == 0 else []))) for k in range(600)]
    rows += [(600, 0, None), (601, 0, "")]
    index = toxicity.fit(frame(rows, "id bigint, y int, text string"))
    docs = frame([(1, "abcde BEASTLY day", "x"), (2, "abcde quiet day", "x"), (3, "", "x"), (4, None, "x"), (4, None, "x"), (5, LONG * 5, "x")], "doc_id bigint, text string, toxicity string")
    got = [(r.doc_id, r.t.predicted, r.t.score, r.toxicity) for r in toxicity.score(docs, index, to="t").orderBy("doc_id").collect()]
    assert [g[1] for g in got] == [1, 0, 0, 0, 0, 0] and all(0 <= g[2] <= 1 and g[3] == "x" for g in got)
    assert toxicity.score(docs.filter("doc_id > 9"), index).count() == 0


def test_examples_are_bounded(frame):
    """Repeated labels, and many documents of one labelled id, stay within the bound."""
    docs = frame([(k % 40, f"text {k}") for k in range(400)], DOCS)
    labels = frame([(k % 50, k % 2) for k in range(500)], "doc_id bigint, toxic int")
    got = [toxicity.examples(docs, labels, most=10).collect() for _ in range(2)]
    assert len(got[0]) == 10 and sorted(got[0]) == sorted(got[1])
    assert toxicity.examples(docs, labels).count() <= toxicity.MAX_EXAMPLES


def test_toxicity_without_labels(frame):
    docs = frame([(1, "a")], DOCS)
    assert toxicity.score(docs, toxicity.fit(frame([], "id bigint, y int, text string"))).first().toxicity.score == 0.0
    assert toxicity.score(docs, toxicity.fit(frame([(1, 1, "a")], "id bigint, y int, text string"))).first().toxicity.predicted == 1
    assert toxicity.score(docs, toxicity.fit(frame([(1, 1, ""), (2, 0, None)], "id bigint, y int, text string"))).first().toxicity.score == 0.5


@data
def test_op2_holds_out(spark):
    import zlib

    got = toxicity.op2(spark, SF).collect()
    assert len(got) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert all(zlib.crc32(str(r.id).encode()) % 5 for r in toxicity.examples(docs, labels).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    rows = toxicity.op2(spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught >= 0.9 * sum(r.toxic for r in rows) and caught >= 0.95 * sum(r.predicted for r in rows)


VALUES = [("card", "4008562658712669"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (586) 555-8430"), ("ip", "49.242.246.194"), ("ip", "1.2.3.4"), ("ip", "223.0.10.255"), ("email", "eai.84@mail7.example.com"), ("date", "2024-02-29"), ("date", "1/2/1999"), ("date", "31.12.1999"), ("date", "12/31/1999"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32")]


@pytest.mark.parametrize(("kind", "value"), VALUES)
def test_pseudonyms(kind, value):
    new = pii.pseudonym(kind, value, pii.KEY)
    assert new != value and len(new) == len(value)
    assert pii.pseudonym(kind, new, pii.KEY, True) == value
    assert [f[2] for f in pii.findings(f"x {new}, y", pii.KEY)] == [kind]
    assert pii.pseudonym(kind, value, b"another key") != new


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 4097])
def test_permutation(size):
    out = [pii.permute(x, size, b"k", "t") for x in range(size)]
    assert sorted(out) == list(range(size))
    assert [pii.permute(y, size, b"k", "t", True) for y in out] == list(range(size))


@pytest.mark.parametrize("text", ["4008562658712660", "300.1.2.3", "version 1.2.3.4.5", "2023-02-29", "000-12-3456", "call 123-456-7890123", "3.", "GB00 WEST 1234 5698 7654 32", "a@b", "568081089e370ecd730e803638840f97073fd319"])
def test_invalid_values_stay(text):
    assert pii.findings(text, pii.KEY) == []


def test_equal_values_stay_linked(frame):
    docs = frame([(1, "card 4008562658712669 27 end", "p"), (2, "é 4008562658712669.", "p"), (2, "é 4008562658712669.", "p"), (3, None, "p"), (4, "", "p"), (5, LONG + "x@y.example.com", "p")], "doc_id bigint, text string, pii string")
    got = [r for r in pii.pseudonymised(docs, pii.KEY, to="found").orderBy("doc_id").collect()]
    new = pii.pseudonym("card", "4008562658712669", pii.KEY)
    assert [r.text for r in got[:5]] == [f"card {new} 27 end", f"é {new}.", f"é {new}.", None, ""]
    assert (got[1].found[0].start, got[1].found[0].end, got[1].pii) == (2, 18, "p")
    assert len(got[5].text) == len(LONG) + 15 and got[5].found[0].kind == "email"
    assert pii.pseudonymised(docs.filter("doc_id > 9"), pii.KEY).count() == 0


@pytest.mark.parametrize("letters", [1, 20, 28, 31, 64, 230, 5000])
def test_long_addresses(letters):
    random.seed(letters)
    value = "".join(random.choice("abcXYZ019") for _ in range(letters)) + "@a1.example.org"
    began = time.time()
    new = pii.pseudonym("email", value, pii.KEY)
    assert pii.pseudonym("email", new, pii.KEY, True) == value and time.time() - began < 1
    assert len(new) == len(value) and new.endswith(".example.org") and new != value
    assert [(a, b) for a, b, _, _ in pii.findings(f"to {value}, ok", pii.KEY)] == [(3, 3 + len(value))]


def test_digits_are_permuted():
    radixes = [3, 2, 4]
    every = [[a, b, c] for a in range(3) for b in range(2) for c in range(4)]
    out = [pii.permute_digits(d, radixes, b"k", "t") for d in every]
    assert sorted(out) == every and [pii.permute_digits(d, radixes, b"k", "t", True) for d in out] == every


#: Values of each kind as brute force finds them: plainer patterns, tried at every place of the text.
PLAIN = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


@data
def test_op4(spark):
    """Outside what is reported nothing changes; inside, the format stays, equal values get equal pseudonyms, different ones
    different ones, and the inverse restores the text; every address and number that plainer patterns find is gone."""
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    seen = {}
    rows = pii.op4(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        old, at, whole = texts[r.doc_id], 0, ""
        for f in r.pii:
            a, b = old[f.start : f.end], r.text[f.start : f.end]
            assert seen.setdefault((f.kind, a), b) == b and a != b
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", a))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", b)))
            whole += r.text[at : f.start] + pii.pseudonym(f.kind, b, pii.KEY, True)
            at = f.end
        assert whole + r.text[at:] == old and len(r.text) == len(old)
        assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(f.kind == k for f in r.pii) for k in pii.KINDS]
        covered = {i for f in r.pii for i in range(f.start, f.end)}
        for m in re.finditer(PLAIN["email"], old):
            assert m.start() in covered
    assert len({(k, b) for (k, _), b in seen.items()}) == len(seen) > 0


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(found)), [sum(f[2] == k for f in found) for k, _, _ in BASE]


def test_base_spans(frame):
    random.seed(10)
    texts = [None, "", "token=secret:longvalue123", 'API_KEY = "abcdefgh1"', "é password:12345678 passwd=short", "AKIAAKIA" + "A" * 10, "AKIA" + "Z" * 11, "x" + "a" * 31, "F" + "0" * 40 + "g", "secret==abcdefgh", "apikey='" + "a" * 64 + "'"]
    texts += ["".join(random.choice(["token", "=", ": ", "'", "secret", "AKIA", "ABCD1234EFGH", "deadbeef" * 4, " ", "é", "\n", "xyz12345"]) for _ in range(25)) for _ in range(60)]
    got = frame(list(enumerate(texts)), DOCS).select("doc_id", secrets.listed(secrets.base_spans(F.col("text"))).alias("s")).collect()
    for r in got:
        assert r.s == base(texts[r.doc_id])[0], texts[r.doc_id]


def test_models_tell_random_from_ordinary(spark, frame):
    words = "the quick report number user account session window buffer handle python spark driver cluster value".split()
    ordinary = frame([(f"{a}_{b}_{c}",) for a in words for b in words for c in words[:6]], "value string").withColumn("label", F.lit(0))
    models = secrets.fit(secrets.random_samples(spark, 400).union(ordinary))
    docs = frame([(1, "key q9Zx7Lm3Np5RtY2Kd8Wb here", "s"), (2, "call report_number_handler now", "s"), (3, None, "s"), (4, 'token="q9Zx7Lm3Np5RtY2Kd8Wb"', "s"), (4, "", "s")], "doc_id bigint, text string, secrets string")
    out = secrets.scanned(docs, models, to="found")
    got = [(r.doc_id, [(x.kind, x.value) for x in r.found]) for r in out.orderBy("doc_id", F.desc("text")).collect()]
    assert got == [(1, [("markov", "q9Zx7Lm3Np5RtY2Kd8Wb")]), (2, []), (3, []), (4, [("assign", 'token="q9Zx7Lm3Np5RtY2Kd8Wb')]), (4, [])]
    assert out.filter("doc_id = 1").select(secrets.redacted(F.col("text"), F.col("found")).alias("r")).first().r == "key [markov] here"
    assert secrets.fit(frame([], "value string, label int")).ratio == ()
    assert secrets.scanned(docs, secrets.Models()).count() == 5


def test_many_matches(spark, frame):
    """Cost and places of tens of thousands of matches in one text."""
    unit = "token=abcdefgh1 q9Zx7Lm3Np5RtY2Kd8Wb é "
    ordinary = frame([("the_quick_report",), ("user_account_number",), ("window_buffer_handle",)] * 20, "value string").withColumn("label", F.lit(0))
    models = secrets.fit(secrets.random_samples(spark, 200).union(ordinary))
    began = time.time()
    got = secrets.scanned(frame([(1, unit * 25_000)], DOCS), models).select(F.expr("transform(secrets, x -> struct(x.start, x.kind))").alias("s")).first().s
    assert time.time() - began < 60
    assert [tuple(x) for x in got if x.kind == "assign"] == [(k * len(unit), "assign") for k in range(25_000)]
    assert [x.start for x in got if x.kind == "markov"] == [k * len(unit) + 16 for k in range(25_000)]


def _brute_models(samples):
    """Log-likelihood ratios by the definition: counts of neighbours, smoothed by characters' own frequencies."""
    kind = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    n = secrets.SYMBOLS
    logs = {}
    for y in (0, 1):
        c = np.zeros((n, n))
        for value, label in samples:
            if label == y:
                for a, b in zip(value, value[1:], strict=False):
                    c[kind.get(a, 0), kind.get(b, 0)] += 1
        own = c + secrets.PRIOR * (c.sum(0) + secrets.SMOOTHING) / (c.sum() + n * secrets.SMOOTHING)
        logs[y] = np.log(own / own.sum(1, keepdims=True))
    ratio = logs[1] - logs[0]
    return lambda v: sum(ratio[kind.get(a, 0), kind.get(b, 0)] for a, b in zip(v, v[1:], strict=False)) / max(1, len(v) - 1)


def test_markov_spans_against_brute_force(frame):
    rng = random.Random(12)
    samples = [("".join(rng.choice(secrets.ALPHABET) for _ in range(30)), 1) for _ in range(200)]
    samples += [("_".join(rng.choice(["user", "name", "report", "file", "index"]) for _ in range(4)), 0) for _ in range(200)]
    rows = frame(samples, "value string, label int")
    train = {r.value for r in rows.filter(F.pmod(F.xxhash64("value"), F.lit(3)) != 0).collect()}
    models, score = secrets.fit(rows), _brute_models([s for s in samples if s[0] in train])
    texts = [" ".join(rng.choice([rng.choice(samples)[0], "plain words", "secret=abcdefgh99", "x" * 20, "é" * 20]) for _ in range(12)) for _ in range(30)]
    got = {r.doc_id: [(x.start, x.end) for x in r.secrets if x.kind == "markov"] for r in secrets.scanned(frame(list(enumerate(texts)), DOCS), models).collect()}
    for i, t in enumerate(texts):
        taken = [tuple(map(int, s.split(":")[1:])) for s in base(t)[0].split(",") if s]
        want = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}", t) if score(m[0]) > models.threshold]
        assert got[i] == [(a, b) for a, b in want if not any(a < d and c < b for c, d in taken)]


def test_ordinary_samples_cover_all_documents(frame):
    docs = frame([(k, f"word{chr(97 + k % 26)}x alpha, (beta) q9Zx7Lm3Np5R") for k in range(60)] + [(99, None), (100, "")], DOCS)
    got = {r.value for r in secrets.ordinary_samples(docs).collect()}
    assert {"alpha", "beta"} <= got and not any("Zx" in v or "Np" in v for v in got)
    assert secrets.ordinary_samples(docs.filter("doc_id > 98")).count() == 0


@data
def test_op5(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    df = secrets.op5(spark, SF)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want, n = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == n and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("markov")) == want
