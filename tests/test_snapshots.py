"""Snapshots are written by as many tasks as the listings have."""

from hearthgraph.plans import registry
from hearthgraph.sources import snapshots
from hearthgraph.sources import testdata as T


def test_snapshots_are_folders_of_many_files(spark, sf, monkeypatch, tmp_path):
    rows = T.listings(spark, sf).repartition(4).cache()
    want = {}
    for r in rows.orderBy("item", "k").collect():
        want.setdefault(r.item, r.price_pcm)
    monkeypatch.setattr(snapshots, "scratch_dir", lambda _: f"{tmp_path}/s")
    monkeypatch.setattr(T, "listings", lambda *_: rows)
    assert {r.id: r.price for r in registry.QUERIES["load_snapshots"](spark, sf).collect()} == want
    assert all(len(list((tmp_path / "s" / str(k)).glob("part-*"))) > 1 for k in range(4))
