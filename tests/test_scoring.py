"""Pinned cases of the scorers, the breaker and snapshots."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import scoring as S
from hearthgraph.operators import tables as U
from hearthgraph.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def fit(spark, doc, beds=1, tolerance=None):
    df = spark.createDataFrame([(json.dumps(doc), beds, tolerance)], "doc string, bedrooms int, tolerance string")
    return S.fit_score(S.unpack(df)).first()


def test_fit_of_a_workspace(spark):
    r = fit(spark, {"bedroom": {"can_fit_desk": "yes", "office_separation": "dedicated_room"}}, 2)
    assert (r.workspace_score, r.workspace_conf, r.fit, r.tier) == (100.0, 1.0, 100, "excellent")


def test_fit_needs_a_signal(spark):
    r = fit(spark, {"kitchen": {"hob_type": "unknown"}})
    assert r.fit is None and r.tier is None


def test_fit_weighs_by_confidence(spark):
    r = fit(spark, {"kitchen": {"hob_type": "gas"}, "overall_rating": 1})
    assert (r.kitchen_fit_score, r.kitchen_fit_conf, r.condition_score, r.condition_conf) == (35.0, 0.4, 0.0, 0.5)
    assert r.fit == round(15 * 35 * 0.4 / (15 * 0.4 + 10 * 0.5))


def test_unreadable_documents_score_nothing(spark):
    df = spark.createDataFrame([("{broken", 1, None), (None, 1, None)], "doc string, bedrooms int, tolerance string")
    assert all(r.fit is None for r in S.fit_score(S.unpack(df)).collect())


def test_full_cost(spark):
    row = [(1500, 1, "hackney", "C", None, "fttp", None, None, "victorian"), (1500, 1, "hackney", "C", "G", "fttp", "yes", "100", "victorian")]
    df = spark.createDataFrame(row, "price_pcm int, bedrooms int, borough string, band string, epc string, broadband string, bills string, service string, kind string")
    make = spark.createDataFrame
    out = S.true_cost(df, make([("hackney", "C", 146)], "borough string, band string, amount int"), make([("D", 1, 106)], "epc string, beds int, amount int"), make([(1, 40)], "beds int, amount int"), make([("fttp", 25)], "type string, amount int"), make([("new_build", 1, 2)], "kind string, low int, high int"))
    assert sorted(r.total for r in out.collect()) == [1746, 1500 + 146 + 106 + 40 + 25]


@pytest.mark.parametrize("days,drops,total,strength", [(30, 2, -200, "strong"), (3, 0, 0, "balanced")])
def test_negotiation(spark, days, drops, total, strength):
    df = spark.createDataFrame([(days, drops, total, 1500, 1500, "stable", 1.0)], "days int, n_drops int, sum_drops int, price_pcm int, median int, direction string, yoy double")
    r = S.negotiation(df, F.to_date(F.lit("2025-01-10"))).first()
    assert r.strength == strength


def test_snapshots_skip_unfinished_versions(spark, tmp_path):
    root = f"{tmp_path}/t"
    U.publish(spark.range(2), root, 1)
    U.publish(spark.range(3), root, 2)
    (Path(root) / "version=0000000003").mkdir()
    assert U.current(spark, root).count() == 3


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    from hearthgraph.streaming.streams import upsert_into

    merge = upsert_into(f"{tmp_path}/t", ["k"], {"n": "max"}, ["ts"])
    rows = lambda *x: spark.createDataFrame(x, "k int, n int, ts int")
    merge(rows((1, 5, 1), (2, 1, 1)), 0)
    for _ in range(2):
        merge(rows((1, 3, 2), (3, 9, 2)), 1)
    got = {(r.k, r.n) for r in U.current(spark, f"{tmp_path}/t").collect()}
    assert got == {(1, 5), (2, 1), (3, 9)}


def test_breaker_against_a_model(spark, sf):
    events = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect():
        events.setdefault(r.user_id, []).append(r)
    want = {}
    for rows in events.values():
        streak, opened = 0, None
        for r in rows:
            t = int((r.ts - rows[0].ts.__class__(1970, 1, 1)).total_seconds())
            if opened is not None and t - opened < 86_400:
                want[r.event_id] = "open"
                continue
            want[r.event_id] = "closed" if opened is None else "half_open"
            if r.event_type == "error":
                streak += 1
                opened = t if opened is not None or streak >= 2 else None
            else:
                streak, opened = 0, None
    assert {r.event_id: r.state for r in registry.QUERIES["stream_breaker"](spark, sf).collect()} == want


@pytest.mark.parametrize("left", ["nothing", "pipeline", "cache"])
def test_entry_works_without_the_llm_subpackage(tmp_path, left):
    for p in ("hearthgraph", "__spark_entry__.py", *(["corpus_pipeline.py"] if left != "nothing" else [])):
        if (ROOT / p).exists():
            (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "hearthgraph" / "llm", ignore_errors=True)
    if left == "cache":
        (tmp_path / "hearthgraph" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
