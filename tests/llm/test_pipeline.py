import corpus_pipeline
from hearthgraph.llm import quality, toxicity
from hearthgraph.llm.common import fold
from pyspark.sql import functions as F
from test_secrets import brute
from test_simhash import brute_components, brute_fingerprint
from test_tokens import whole


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    voters = quality.train(docs, labels, "quality", fold(F.col("doc_id"), 3) == 1)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, sf).cache()
        rows = after.collect()
        if k < 4:
            assert after.columns == docs.columns
            kept = {r.doc_id: r for r in rows}
            assert len(kept) == len(rows) and kept.keys() <= before.keys()
        if k == 0:
            assert kept.keys() == {i for i, r in before.items() if voters.score([r.text])[0] >= 0.5}
        elif k == 1:
            model = toxicity.train(docs, labels, fold(F.col("doc_id"), 4) == 2)
            assert kept.keys() == {i for i, r in before.items() if model.score(r.text) < toxicity.THRESHOLD}
        elif k == 2:
            found = brute_components([(i, brute_fingerprint(r.text)) for i, r in before.items()])
            assert kept.keys() == {i for i, _, c in found if i == c}
        elif k == 3:
            assert kept.keys() == before.keys()
            for r, (_, spans) in zip(before.values(), brute([r.text for r in before.values()])):
                text, at, out = r.text, 0, ""
                for s, _, e in spans:
                    if s >= at:
                        out += text[at:s] + "[secret]"
                    at = max(at, e)
                assert kept[r.doc_id].text == out + text[at:]
        else:
            assert whole(rows).keys() == before.keys()
        docs = after


def test_run_is_the_stages_in_turn(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns[:3] == ["doc_id", "start", "length"]
    whole(got.collect())


def test_stages_on_odd_rows(spark, odd, odd_rows, tmp_path):
    """Nulls, repeated ids with one and with several texts, columns of clashing names, no rows."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    more = [(3, t) for t in ("a b c d e f", "g h i j k l")] + [(5, "a b c d e f")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    for docs, n in ((odd.unionByName(extra, allowMissingColumns=True), len(odd_rows) + 3), (odd.limit(0), 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, str(tmp_path))
            rows = got.collect()
            if k in (0, 1, 3):
                assert got.columns == docs.columns and len(rows) <= n and (n == 0 or rows)
            elif k == 2:
                assert got.columns == docs.columns
                if n:  # whole repeated rows and copies under other ids go, other texts of an id stay
                    assert sorted((r.doc_id, r.text) for r in rows if r.doc_id == 3 and r.text) == sorted(more[:2])
                    assert len(rows) == 8
            else:
                assert "sequence_id" in got.columns and sum(r.length for r in rows if r.doc_id == 2) == (1 if n else 0)
