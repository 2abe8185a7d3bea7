"""Quality, toxicity and language model: brute force where there is a right answer, held-out accuracy where there is none."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, quality, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_ordinal_model_recovers_grades():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    value = rng.normal(size=40)
    texts, z = [], []
    for _ in range(600):
        own = rng.choice(40, 12)
        texts.append(" ".join(words[i] for i in own))
        z.append(value[own].sum())
    z = np.array(z)
    grade = np.digitize(z, [-3, 0, 3]).astype(float)
    rows = quality.features(pa.array(texts))
    model = quality.fit_ordinal(rows[:450], grade[:450])
    p = model.proba(rows[450:])
    assert np.allclose(p.sum(axis=1), 1) and (p >= -1e-12).all() and (np.diff(model.cuts) > 0).all() and len(model.cuts) == 3
    assert np.corrcoef(p @ np.array(model.grades), grade[450:])[0, 1] > 0.8


def test_gradient_by_differences():
    """A step of the fit lowers the loss the model itself implies."""
    rows = quality.features(pa.array(["a b c", "a a a", "c d", "b d e", "e f g", "g g h"]))
    grade = np.array([0.0, 0, 1, 1, 2, 2])
    loss = lambda m: -np.log(np.maximum(m.proba(rows)[np.arange(6), grade.astype(int)], 1e-12)).mean()
    losses = [loss(quality.fit_ordinal(rows, grade, steps=n)) for n in (1, 10, 50, 150)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = quality.fit_quality(docs.where(half), quality.grades(labels).where(half))
    out = quality.score_quality(docs.where(~half), model).join(labels, "doc_id").collect()
    good = [r.tail >= quality.KEEP_TAIL for r in out if r.quality]
    bad = [r.tail >= quality.KEEP_TAIL for r in out if not r.quality]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) <= 0.1


def test_lowest_ratings_are_split_by_their_parts():
    """Junk with a good quarter is graded above junk throughout, and neither counts as good."""
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 300, n))
    junk = lambda n: " ".join(["buy!!"] * n)
    texts = [prose(60) for _ in range(60)] + [junk(60) for _ in range(30)] + [f"{prose(30)} {junk(30)}" for _ in range(30)]
    ratings = np.array([1.0] * 60 + [0.0] * 60)
    parts = [quality.features(pa.array([" ".join(t.split()[15 * k : 15 * k + 15]) for k in range(4)])) for t in texts[60:]]
    rows = quality.features(pa.array(texts))
    mixed = np.random.default_rng(0).permutation(120)
    where = [i for i in mixed if i >= 60]
    out = quality.split_lowest([rows[i] for i in mixed], ratings[mixed], [parts[i - 60] for i in where])
    got = dict(zip(mixed.tolist(), out.tolist()))
    assert all(got[i] == 1 for i in range(60)) and np.mean([got[i] == 0 for i in range(60, 90)]) > 0.9 and np.mean([got[i] == 0.5 for i in range(90, 120)]) > 0.9


def test_quality_scores_equal_brute_force(spark, tiny):
    """The query's scores from its model, feature by feature in plain Python."""
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = quality.fit_quality(docs, quality.grades(labels))
    assert len(model.grades) - 1 == len(model.cuts) and model.grades[model.good :] == [1.0] and list(model.cuts) == sorted(model.cuts)
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    for r in docs.collect():
        ((index, value),) = quality.features(pa.array([r.text]))
        z = sum(model.weights[i] * v for i, v in zip(index, value))
        below = [1 / (1 + math.exp(-(c - z))) for c in model.cuts] + [1.0]
        p = [b - a for a, b in zip([0.0, *below], below)]
        assert got[r.doc_id].tail == pytest.approx(sum(p[model.good :]), abs=1e-9) and got[r.doc_id].keep == (got[r.doc_id].tail >= quality.KEEP_TAIL)
        assert got[r.doc_id].expected_grade == pytest.approx(sum(g * x for g, x in zip(model.grades, p)), abs=1e-9)


def test_fold_and_match():
    assert toxicity.fold("ID1OT, m0r0n! сlоwn $tupid") == " idiot moron clown stupid "
    assert toxicity.fold("") == "  " and toxicity.fold("10 + 20 = 30") == "  "
    for spelling in ("id\u200biot", "𝐢𝐝𝐢𝐨𝐭", "𝕚𝕕𝕚𝕠𝕥", "ｉｄｉｏｔ", "ɪᴅɪᴏᴛ", "ıdıøt", "i d i o t", "I.D.I.O.T", "idⅰot", "ідіоt", "\ufeffid\u00adiot", "ⓘⓓⓘⓞⓣ"):
        assert toxicity.fold(f"you {spelling}!").split() == ["you", "idiot"], spelling
    own = toxicity.Lexicon((("idiot", 2.0), ("réeux", 4.0)))
    for spelling in ("ídiot", "i\u0308d\u0301iot", "ÎDIÕT"):
        assert toxicity.matches(toxicity.fold(f"you {spelling}!"), own) == [(4, "idiot", 2.0)], spelling
    assert [t for _, t, _ in toxicity.matches(toxicity.fold("réeux reeux rèeux"), own)] == ["réeux"]
    lexicon = toxicity.Lexicon((("idiot", 2.0), ("trash", 1.0), ("trashy", 3.0), ("clown", 1.0)))
    found = lambda t: [(term, w) for _, term, w in toxicity.matches(toxicity.fold(t), lexicon)]
    assert found("An IDIOTIC trashy trash can, a clown fish; clown") == [("idiot", 2.0), ("trashy", 3.0), ("clown", 1.0)]
    assert found("antitrash") == []


def test_look_alikes_are_single_letters():
    assert all(len(k) == 1 and v.isascii() and v.isalpha() and len(v) == 1 for k, v in toxicity._LOOKALIKES.items())


def test_matches_equal_brute_force(small):
    lexicon = toxicity.Lexicon(tuple((t, float(len(t))) for t in ("the", "ther", "on", "onth", "en", "idiot", "réeux")))
    for r in small.collect()[:80]:
        folded = toxicity.fold(r.text)
        want = []
        for i in (m.start() for m in re.finditer(" ", folded)):
            hits = [(w, t) for t, w in lexicon.terms if folded.startswith(t, i + 1)]
            if hits:
                want.append((i, max(hits)[1]))
        assert [(s, t) for s, t, _ in toxicity.matches(folded, lexicon)] == want


def brute_lexicon(rows, labels):
    """The lexicon from every labelled text, start by start, and the calibration of its scores."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    y = {r.doc_id: r.toxic for r in labels if not held(r.doc_id)}
    texts = [(y[r.doc_id], toxicity.fold(r.text)) for r in rows if r.doc_id in y]
    seen = [Counter(), Counter()]
    for toxic, folded in texts:
        seen[toxic].update({w[:k] for w in folded.split() for k in range(4, min(9, len(w)) + 1)})
    n = [sum(t == k for t, _ in texts) for k in (0, 1)]
    ratio = {t: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][t] + 0.5) / (n[0] + 1)) for t, c in seen[1].items() if c >= 6}
    kept = {}
    for t in sorted((t for t in ratio if ratio[t] >= 3), key=lambda t: (len(t), t)):
        shorter = [kept[t[:k]] for k in range(4, len(t)) if t[:k] in kept]
        if not shorter or ratio[t] > max(shorter) + 1.5:
            kept[t] = ratio[t]
    kept |= {t: max(3.0, kept.get(t, 0)) for t in toxicity.SEED}
    found = [(toxic, brute_matches(folded, kept)) for toxic, folded in texts]
    x = np.array([measure(folded, m) for (_, folded), (_, m) in zip(texts, found)])
    coefs, bias = toxicity.fit_calibration(x, np.array([float(t) for t, _ in texts]))
    return kept, coefs, bias


def brute_matches(folded, terms):
    """For each word outside the exception phrases the heaviest term that starts it, general insults also under accents."""
    plain = "".join(unicodedata.normalize("NFD", c)[0] if unicodedata.normalize("NFD", c)[0].isascii() else c for c in folded)
    excused = set()
    for phrase in toxicity.EXCEPTIONS:
        at = folded.find(" " + phrase)
        while at >= 0:
            excused |= set(range(at, at + len(phrase) + 1))
            at = folded.find(" " + phrase, at + 1)
    found = []
    for m in re.finditer(" (?=[^ ])", folded):
        hits = [w for t, w in terms.items() if folded.startswith(t, m.start() + 1) or t in toxicity.SEED and plain.startswith(t, m.start() + 1)]
        if hits and m.start() not in excused:
            found.append(max(hits))
    return found


def measure(folded, found):
    n = max(len(folded.split()), 1)
    mass = sum(found)
    return (math.log1p(mass), math.log1p(10 * mass / math.sqrt(n)), math.log1p(n) / 10) if found else (0.0, 0.0, 0.0)


def test_toxicity_report_equals_brute_force(spark):
    """Terms, exceptions, calibration and scores of the query."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    extra = spark.createDataFrame([(10**9, "an idiot proof trash can for the idiot and the clown fish"), (10**9 + 1, None), (10**9 + 2, "pathetic fallacy " * 50), (10**9 + 3, "pathetic " * 9)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    terms, coefs, bias = brute_lexicon(docs.collect(), labels.collect())
    got = {r.doc_id: r for r in toxicity.toxicity_report(both, labels).collect()}
    for r in both.collect():
        folded = toxicity.fold(r.text or "")
        found = brute_matches(folded, terms)
        z = bias + float(np.dot(coefs, measure(folded, found)))
        x = got[r.doc_id]
        assert x.n_matches == len(found) and x.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and x.predicted == (x.score >= 0.7), r.doc_id
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_report(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.95 and hit / sum(r.toxic for r in rows) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def test_lm_equals_brute_force(small):
    rows = small.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words, pairs = Counter(), Counter()
    texts = 0
    for r in rows:
        if not held(r.doc_id):
            t = tokens(r.text)
            words.update(t)
            pairs.update(zip(["start", *t], t))
            texts += 1
    n, v = sum(words.values()), len(words)

    # the weights, from every training token with its own count deleted
    contexts, p2, p1 = [], [], []
    for r in rows:
        if not held(r.doc_id):
            before = "start"
            for w in tokens(r.text):
                c = texts if before == "start" else words[before]
                contexts.append(c)
                p2.append((pairs[before, w] - 1) / max(c - 1, 1))
                p1.append((words[w] - 1) / (n - 1))
                before = w
    weights = lm.fit_mixture(lm.context_bucket(np.array(contexts)), np.ones(len(contexts)), np.array(p2), np.array(p1), 1 / (v + 1))

    got = {r.doc_id: r for r in lm.lm_report(small).collect()}
    model, base, size = 0.0, 0.0, 0
    for r in rows:
        t, x = tokens(r.text), got[r.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(r.doc_id), len(t), sum(words[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        want, before = 0.0, "start"
        for w in t:
            c = texts if before == "start" else words[before]
            a, b, u = weights[lm.context_bucket(np.array([c]))[0]]
            want += math.log10(a * pairs[before, w] / max(c, 1) + b * words[w] / n + u / (v + 1))
            before = w
        assert x.score == pytest.approx(want, rel=0.002)  # like estimates are gathered in cells
        if x.held_out:
            model, base, size = model + x.score, base + x.base_score, size + len(t)
    assert model / size > base / size
