"""Polygons by their covering against a ray cast at all edges."""

import json
import math
import random

import pytest

from pyspark.sql import functions as F

from geoblend.operators import covering
from geoblend.sources import tables


def plain_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def blob(rng, x, y, r, n):
    """A wild ring around a point."""
    return [(x + r * (0.3 + 0.7 * rng.random()) * math.cos(2 * math.pi * k / n), y + r * (0.3 + 0.7 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.fixture(scope="module")
def districts():
    rng = random.Random(2)
    out = {}
    for k in range(25):
        x, y, r = rng.uniform(-7, -5), rng.uniform(52, 54), 10 ** rng.uniform(-3, 0.5)
        out[k] = [blob(rng, x, y, r, rng.choice([3, 7, 60, 400])), blob(rng, x, y, r / 8, 9)] + [blob(rng, x + 2.5 * r, y, r / 2, 5)] * (k % 2)
    out[90] = [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)], blob(rng, -6, 53, 1.5, 40)]  # nearly everything
    out[50] = [[(-6.5, 53.0), (-6.25, 53.0), (-6.25, 53.25), (-6.5, 53.25)]]  # two boxes that share an edge
    out[51] = [[(-6.25, 53.0), (-6.0, 53.0), (-6.0, 53.25), (-6.25, 53.25)]]
    return out


@pytest.mark.parametrize("detail,edges", [(2, 16), (0, 4), (3, 2)])
def test_covering_equals_ray_cast(spark, districts, detail, edges):
    rng = random.Random(3)
    points = [(rng.uniform(-8, -4), rng.uniform(51, 55)) for _ in range(1500)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)]
    points += [p for k in (0, 1, 50, 51) for p in districts[k][0][:20]] + [(-6.25, 53.0 + 0.01 * i) for i in range(30)] + [(None, 53.0), (5.0, None)]
    df = spark.createDataFrame([(i, *p, "clash") for i, p in enumerate(points)], "k int, longitude double, latitude double, level string").repartition(3)
    shapes = spark.createDataFrame([(k, [[list(p) for p in r] for r in rings]) for k, rings in districts.items()] + [(-1, None), (-2, []), (-3, [[[0.0, 0.0]]])], "polygon_id int, rings array<array<array<double>>>")
    got = {r["k"]: r["polygon_id"] for r in covering.points_in_polygons(df, shapes, detail=detail, most_edges=edges).collect()}
    for i, (x, y) in enumerate(points):
        inside = [k for k, rings in districts.items() if x is not None and y is not None and plain_inside(x, y, rings)]
        assert got[i] == (min(inside) if inside else None), (i, x, y)


def test_large_polygons_are_few_rows_and_inner_cells_have_no_edges():
    rng = random.Random(4)
    for r in (0.001, 1.0, 60.0):
        cells = covering.covering_cells([blob(rng, 3, 4, r, 50)])
        assert len(cells) < 400 and any(inside and not len(own) for *_, inside, own in cells)
        assert max(len(own) for *_, own in cells) <= covering.EDGES + 8
    assert covering.covering_cells([]) == [] and covering.covering_cells([[(0, 0), (1, 0), (2, 0)]]) == []


def test_parts_and_holes_of_geojson(spark, tmp_path):
    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = [
        {"properties": {"grid_id": "a"}, "geometry": {"type": "Polygon", "coordinates": [box(0, 0, 4), box(1, 1, 2)]}},
        {"properties": {"grid_id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[box(10, 0, 1)], [box(12, 0, 4), box(13, 1, 1)]]}},
        {"properties": {"grid_id": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"features": features}))
    shapes = tables.read_geojson_cells(spark, str(tmp_path / "g.json"))
    points = {(0.5, 0.5): "a", (2.0, 2.0): None, (10.5, 0.5): "b", (11.5, 0.5): None, (12.5, 0.5): "b", (13.5, 1.5): None}
    df = spark.createDataFrame(list(points), "longitude double, latitude double")
    got = covering.points_in_polygons(df, shapes.withColumnRenamed("grid_id", "polygon_id").drop("ring"))
    assert {(r["longitude"], r["latitude"]): r["polygon_id"] for r in got.collect()} == points
    none = covering.points_in_polygons(df, shapes.withColumnRenamed("grid_id", "polygon_id").limit(0))
    assert [r["polygon_id"] for r in none.collect()] == [None] * 6


def test_many_polygons_go_down_the_tree_like_each_alone(districts):
    shapes = [None, [], [[(0.0, 0.0)]], *districts.values(), None]
    found = covering.coverings(shapes)
    ends = found["n"].cumsum()
    together = {}
    for s, k, i, j, inside, end, n in zip(*(found[c].tolist() for c in ("shape", "level", "i", "j", "inside")), ends.tolist(), found["n"].tolist()):
        together.setdefault(s, []).append((k, i, j, inside, sorted(map(tuple, found["edges"][end - n : end].tolist()))))
    for s, rings in enumerate(shapes):
        alone = [(*cell, sorted(map(tuple, own.tolist()))) for *cell, own in (covering.covering_cells(rings) if rings else [])]
        assert sorted(together.get(s, [])) == sorted(alone), s


def test_what_points_meet_does_not_grow_with_overlapping_polygons(spark, monkeypatch):
    rng = random.Random(5)
    stars = {k: [blob(rng, rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), 1.0, 12)] for k in range(120)}
    twice = {**stars, **{k + 500: rings for k, rings in stars.items()}}  # the same rings under larger ids
    shapes = spark.createDataFrame([(k, [[list(p) for p in r] for r in rings]) for k, rings in twice.items()], "polygon_id int, rings array<array<array<double>>>").coalesce(1)
    tables_seen, plain = {}, covering.written

    def seen(df, name):
        out = plain(df, name)
        tables_seen[name] = (df.rdd.getNumPartitions() if name == "polygon-cells" and name not in tables_seen else tables_seen.get(name, (0,))[0], out.count())
        return out

    monkeypatch.setattr(covering, "TASK", 20)
    monkeypatch.setattr(covering, "written", seen)
    points = [(rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2)) for _ in range(400)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k int, longitude double, latitude double")
    got = {r["k"]: r["polygon_id"] for r in covering.points_in_polygons(df, shapes).collect()}
    for i, (x, y) in enumerate(points):
        assert got[i] == min((k for k, rings in stars.items() if plain_inside(x, y, rings)), default=None)
    whole = covering.covering(shapes).filter(F.col("polygon_id") < 500).count()
    assert tables_seen["polygon-shapes"][1] == 120 and tables_seen["polygon-cells"][0] == 6  # distinct rings, in tasks of 20
    assert tables_seen["polygon-cells"][1] < whole / 2
