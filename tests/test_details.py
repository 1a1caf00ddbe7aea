"""A record's page: all its columns, its analysis, all its photos and floor plans."""

from pyspark.sql import functions as F

from hearthgraph.operators import search as Q
from hearthgraph.plans import registry
from hearthgraph.sources import testdata as T


def test_every_part_of_a_record_is_there(spark):
    records = spark.createDataFrame([("a", 900), ("b", 950), ("c", 990)], "unique_id string, price_pcm int")
    analyses = spark.createDataFrame([("a", 4, "{}"), ("x", 1, "")], "unique_id string, quality_rating int, analysis string")
    images = [("a", 3, "floorplan", "p3"), ("a", 10, "gallery", "g10"), ("a", 2, "gallery", "g2"), ("a", 1, "floorplan", "p9"), ("b", 5, "floorplan", "p5")]
    got = Q.detail_rows(records, analyses, spark.createDataFrame(images, "unique_id string, image_id long, image_type string, url string"))
    assert sorted(map(tuple, got.collect())) == [("a", 900, 4, "{}", ["g2", "g10"], ["p9", "p3"]), ("b", 950, None, None, [], ["p5"]), ("c", 990, None, None, [], [])]


def test_the_query_shows_analyses_and_records(spark, sf):
    got = {r.unique_id: r for r in registry.QUERIES["detail_rows"](spark, sf).collect()}
    want = {r.unique_id: r.doc for r in T.analyses(spark, sf).select("unique_id", "doc").collect()}
    assert {u: r.analysis for u, r in got.items() if r.analysis is not None} == want
    assert {(u, r.price_pcm, r.description) for u, r in got.items()} == {tuple(r) for r in T.listings(spark, sf).select("unique_id", "price_pcm", "description").collect()}
    plans = T.images(spark, sf).where("image_type = 'floorplan'").groupBy("unique_id").agg(F.count("*").alias("n")).collect()
    assert {u: len(r.floorplans.split(" ")) for u, r in got.items() if r.floorplans} == {r.unique_id: r.n for r in plans}
