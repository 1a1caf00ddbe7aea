import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgraph.llm import quality, toxicity
from hearthgraph.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label,held,least", [(quality.op2_quality, "quality", (3, 1), 0.97), (toxicity.op7_toxicity, "toxic", (4, 2), 0.93)])
def test_held_out_accuracy(spark, query, label, held, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = query(spark, SF).cache()
    assert got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where(F.col("held_out") != (fold(F.col("doc_id"), held[0]) == held[1])).count() == 0
    hits = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert hits >= least
    if label == "quality":  # clean documents stay
        rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1")
        assert rows.where("predicted = 0").count() <= 0.01 * rows.count()
    got.unpersist()


def labels(spark, rows=()):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_keep_their_columns(spark, odd, odd_rows, module):
    never = F.lit(False)
    for marks in (labels(spark), labels(spark, [(1, 1, 0), (2, 0, 1), (3, 0, 1), (5, 0, 1), (None, 1, 1), (7, None, None), (1, 1, 0)])):
        got = module.scored(odd, marks, never)
        assert got.columns == [*odd.columns, "predicted"]
        rows = got.collect()
        assert len(rows) == len(odd_rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if module is quality else 0.3)) for r in rows)
    assert module.scored(odd.limit(0), marks, never).count() == 0


def test_terms_do_not_depend_on_the_slices(monkeypatch):
    text = "Some WORDS, again and again é! " * 50
    want = quality.terms(text)
    monkeypatch.setattr(quality, "SLICE", 37)
    assert np.array_equal(quality.terms(text), want)


def test_votes_are_weighted_cosines(monkeypatch):
    rnd = np.random.RandomState(0)
    texts = ["aaa bbb " * 5, "CCC!! DDD!! " * 5, "aaa ccc bbb", "DDD!! CCC!!", "eee aaa"]
    v = quality.fit_voters(np.stack([quality.terms(t) for t in texts]), np.array([1.0, 0, 1, 0, 1]))
    want = []
    for t in texts:
        x = v.latent(quality.terms(t)[None])[0].astype(float)
        cos = np.maximum(v.vectors.astype(float) @ x, 0)
        near = np.argsort(-cos)[: quality.NEAR]
        want.append((cos[near] ** 4 * v.labels[near]).sum() / (cos[near] ** 4).sum())
    assert np.allclose(v.score(texts), want, atol=1e-5)
    assert (v.score(texts) > 0.5).tolist() == [True, False, True, False, True]
    assert rnd is not None


GRAMMAR = [
    ("what an idiot", {"i"}),
    ("you are an idiot", {"it"}),
    ("you are such a total idiot", {"it"}),
    ("you blue idiot", {"jt"}),
    ("the word idiot", {"j"}),
    ("the word idiot. my word idiot. some word idiot. one word idiot", {"j"}),
    ("this is not an idiot", {"in"}),
    ("not a b c d idiot", {"j"}),
    ("he said idiot", {"jrt"}),
    ("the paper quoted an idiot", {"ir"}),
    ("kill the process", set()),
    ("i will kill you", {"kt"}),
    ("you will burn", {"kt"}),
    ("a fine day. idiot! nothing else", {"i"}),
    ("idiots everywhere", {"i"}),
    ("", set()),
]


@pytest.mark.parametrize("text,ways", GRAMMAR)
def test_the_grammar_by_clause(text, ways):
    m = toxicity.Model({"idiot": 0.9, "idiot*": 0.8})
    assert {w for w, _ in m.matches(text)} == ways
    assert (m.score(text) >= toxicity.THRESHOLD) == bool(ways & {"i", "it", "jt", "kt"})


def test_composition_is_running_the_machines_in_turn():
    rnd = np.random.RandomState(3)
    machines = [toxicity.insult, toxicity.negation, toxicity.reported, toxicity.target, toxicity.threat]
    for _ in range(300):
        state, own = toxicity.START, [0] * len(machines)
        for symbol in rnd.choice(list(toxicity.SYMBOLS), 12):
            state, got = toxicity.GRAMMAR[state, symbol]
            out = symbol
            for k, m in enumerate(machines):
                own[k], out = m.step(own[k], out)
            assert got == out and state == tuple(own)


def test_words_are_learned_from_labels(spark):
    """Insults by label, a threat word by the targets after it, a weakening word by clean texts."""
    rows = []
    for i in range(60):
        rows += [(1, f"text{i} where zorg{i % 7} x{i} is a glorp indeed"), (1, f"and i{i} will frobnicate you at w{i} today, the glorp"), (0, f"plain{i} words and nothing but w{i} for you here")]
        rows += [(0, f"it is hardly{'' if i % 3 else ' ever'} a glorp in v{i} nor in u{i}")] if i % 4 == 0 else [(0, f"more plain text {i} and {i + 1}")]
    df = spark.createDataFrame(rows, "y int, text string")
    n = {0: 120, 1: 120}
    lexicon = toxicity.learn_lexicon(df, n)
    assert "glorp" in lexicon
    model = toxicity.learn_ways(df, toxicity.learn_contexts(df, {"glorp": lexicon["glorp"]}, n), n)
    assert "frobnicate" in model.threats and "hardly" in model.weakeners and "glorp" not in model.threats
    assert model.score("they will frobnicate you") >= 0.3 > model.score("hardly a glorp")
    assert model.score("you are a glorp") >= 0.3


@pytest.mark.parametrize("query,module,label,held", [(quality.op2_quality, quality, "quality", (3, 1)), (toxicity.op7_toxicity, toxicity, "toxic", (4, 2))])
def test_scores_of_the_query_one_by_one(spark, sf, query, module, label, held):
    """The registered query on a whole table against scoring each text on its own: for quality by
    cosines with every voter, sorted in full."""
    docs, labels_ = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    out = fold(F.col("doc_id"), held[0]) == held[1]
    if module is toxicity:
        model = toxicity.train(docs, labels_, out)
        want = {r.doc_id: model.score(r.text) for r in docs.collect()}
    else:
        v, want = quality.train(docs, labels_, label, out), {}
        assert len(v.labels) > 2 * quality.NEAR
        for r in docs.collect():
            cos = v.vectors.astype(float) @ v.latent(quality.terms(r.text)[None])[0].astype(float)
            near = np.argsort(-cos)[: quality.NEAR]
            w = np.maximum(cos[near], 0) ** 4
            want[r.doc_id] = (w * v.labels[near]).sum() / w.sum() if w.sum() > 0 else v.labels.mean()
    assert got.keys() == want.keys()
    assert all(abs(got[i].score - want[i]) < 1e-4 for i in want)
    assert all(r.predicted == (r.score >= (0.5 if module is quality else 0.3)) for r in got.values())
