"""Every registered query of the main package against its DuckDB SQL at sf0.01; those without SQL give
rows on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from hearthgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(f"{v:.6g}") if abs(v) < 1e6 else v
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, LARGER if name in registry.ORACLES else sf)
    got = df.collect()
    assert got, "no rows"
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert bag(df.columns, got) == bag(names, cur.fetchall())


def test_only_order_dependent_queries_lack_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) <= {"gallery_match_count", "embedding_match_count", "token_ratios", "resolve_entities", "perceptual_dedup", "resolve_against_anchors", "resolve_existing", "stream_breaker", "pipeline_events"}
