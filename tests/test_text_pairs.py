"""Text similarity by vectors of positions against cutting the texts and counting their words."""

import math
import random
import re
from collections import Counter

from hearthgraph.operators import joins as J

WORD = re.compile(r"[^\W_]+")


def words(text):
    return [w for w in WORD.findall(text.lower()) if len(w) > 1]


def grams(text):
    w = words(text)
    return w + [" ".join(x) for x in zip(w, w[1:])]


def model(docs, pairs, terms, shortest=20):
    texts = dict(docs)
    counts, df = Counter(), Counter()
    for _, t in docs:
        counts.update(grams(t or ""))
        df.update(set(grams(t or "")))
    top = sorted(counts, key=lambda t: (-counts[t], t))[:terms]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in top}
    for a, b in pairs:
        x, y = texts.get(a) or "", texts.get(b) or ""
        n = min(len(x), len(y))
        x, y = x[:n], y[:n]
        if n < shortest:
            yield a, b, 0.0
        elif x.lower() == y.lower():
            yield a, b, 1.0
        else:
            v, w = ({t: c * idf[t] for t, c in Counter(grams(z)).items() if t in idf} for z in (x, y))
            size = math.sqrt(sum(p * p for p in v.values()) * sum(p * p for p in w.values()))
            yield a, b, sum(p * w.get(t, 0) for t, p in v.items()) / size if size else 0.0


def test_cut_texts(spark):
    """Cuts inside words and pairs of words, texts that begin with another, missing and short ones."""
    rnd = random.Random(2)
    vocab = ["a", "bright", "bri", "flat", "flats", "fl", "ÉCOLE", "éco", "Ωσ", "garden", "gard", "2", "22", "İst", "x_y"]
    docs = [(i, "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(rnd.randint(3, 25)))) for i in range(60)]
    docs += [(60, docs[3][1] + "and more of it"), (61, docs[3][1].upper()[:-2]), (62, None), (63, "short"), (64, "")]
    docs = [(i, t[: rnd.randint(len(t) // 2, len(t))] if t and i < 60 and i != 3 else t) for i, t in docs]
    pairs = [(a, b) for a in range(65) for b in range(a + 1, min(a + 6, 65))] + [(3, 60), (3, 61), (3, 62), (4, 99)]
    for terms in (8, 500):
        found = J.tfidf_cosine(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(pairs, "id_a long, id_b long"), terms)
        got = {(r.id_a, r.id_b): r.similarity for r in found.collect()}
        want = {(a, b): s for a, b, s in model(docs, pairs, terms)}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and 1.0 in want.values()


def test_a_word_without_end(spark):
    """One word of a hundred thousand characters costs no square of them."""
    docs = [(1, "flat " * 3 + "w" * 100_000), (2, "flat " * 4 + "v" * 100_000)]
    found = J.tfidf_cosine(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(1, 2)], "id_a long, id_b long"), 2)
    assert found.first().similarity > 0.9


def test_top_terms_with_ties(spark, monkeypatch):
    """Pairs of frequent words alone are counted, but where ties would decide all are."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(vocab[min(int(rnd.expovariate(0.3)), 29)] for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "once only")]
    counts, df = Counter(), Counter()
    for _, t in docs:
        counts.update(grams(t or ""))
        df.update(set(grams(t or "")))
    frame = spark.createDataFrame(docs, "id long, text string")
    kept = []
    real = J._count_terms
    monkeypatch.setattr(J, "_count_terms", lambda *x: kept.append(1) or real(*x))
    ties = 0
    for terms in (1, 5, 20, 32, 2000):
        kept.clear()
        assert J.top_terms(frame, terms) == [(t, df[t]) for t in sorted(counts, key=lambda t: (-counts[t], t))[:terms]]
        ties += len(kept) > 1
    assert 0 < ties < 5
    assert J.top_terms(frame.where("id = 60"), 5) == []


def test_texts_are_cut_before_they_meet(spark, monkeypatch):
    """What is kept of a long text for a pair with a short one is no longer than that of the short one."""
    kept = {}
    real = J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    docs = [(1, " ".join(f"w{i}" for i in range(3000))), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    found = J.tfidf_cosine(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(1, 2)], "id_a long, id_b long"))
    assert 0 < found.first().similarity < 1
    assert kept["text-vectors"].selectExpr("max(size(term))").first()[0] < 20
