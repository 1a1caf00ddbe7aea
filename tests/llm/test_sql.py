from collections import Counter

import duckdb

from hearthgraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got, cur = QUERIES[name](spark, SF), con.execute(sql)
        names = [d[0] for d in cur.description]
        want = Counter(cur.fetchall())
        assert sorted(names) == sorted(got.columns) and want
        assert Counter(map(tuple, got.select(names).collect())) == want
