"""Nearest reference points against brute force, also far off, at the date line and the pole."""

import math
import random

from hearthgraph.operators import joins as J

SCHEMA = "unique_id string, postcode string, latitude double, longitude double"


def metres(a, b):
    (p, x), (q, y) = (tuple(map(math.radians, v)) for v in (a, b))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_every_place_finds_its_nearest(spark):
    rnd = random.Random(3)
    near = lambda n: [(51.5 + rnd.random() / 5, rnd.random() / 5) for _ in range(n)]
    ref = [(f"r{i}", *p) for i, p in enumerate([*near(40), (0.0, 179.99), (0.1, 10.0), (88.0, 0.0)])]
    rows = [*near(40), (0.0, -179.99), (0.0, 10.04), (0.05, 10.0), (89.9, 180.0), (48.8, 2.3), (-33.9, 151.2), (-90.0, 0.0), *((rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(40))]
    df = spark.createDataFrame([(str(i), None, *p) for i, p in enumerate(rows)], SCHEMA)
    refs = spark.createDataFrame([(*r, None) for r in ref], "label string, latitude double, longitude double, postcode string")
    got = {r.unique_id: r.label for r in J.nearest_reference(df, refs, 500.0).collect()}
    where = {n: (la, lo) for n, la, lo in ref}
    assert len(got) == len(rows)
    for i, p in enumerate(rows):
        assert math.isclose(metres(p, where[got[str(i)]]), min(metres(p, q) for q in where.values()), rel_tol=1e-9)


def test_postcodes_name_what_has_no_place(spark):
    df = spark.createDataFrame([("a", "e8 3rh", None, None), ("b", "E8", None, None), ("c", None, None, None), ("d", "E8 3RH", -33.9, 151.2), ("e", "N1 1AA", None, 1.0)], SCHEMA)
    refs = spark.createDataFrame([("x", None, None, "E8 3RH"), ("w", None, None, "E8 3RH"), ("far", 51.5, 0.0, "N1 1AA")], "label string, latitude double, longitude double, postcode string")
    got = {r.unique_id: r.label for r in J.nearest_reference(df, refs, 500.0).collect()}
    assert got == {"a": "w", "b": None, "c": None, "d": "far", "e": "far"}
