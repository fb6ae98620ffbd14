import math
import random

import pytest
from pyspark.sql import functions as F

from almagest.functions import coords, geometry as geo
from almagest.functions.cells import PlaneGrid, SphereGrid
from almagest.functions.geohash import ALPHABET, with_geohash
from almagest.functions.s2 import QUADRANT_AT, ORIENTATION_CHANGE, S2Cells, explode_s2_cover, s2_parent, with_s2_cell
from conftest import plan_text, sphere_distance


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_angles(spark):
    assert coords.radius_degrees(1, 30) == pytest.approx(0.025)
    row = one(
        spark,
        column=coords.radius_degrees(F.lit(1.0), F.lit(30.0)),
        ordinate=coords.mercator_ordinate(F.lit(3.0)),
        x=coords.mercator_x(F.lit(180.0)),
        y=coords.mercator_y(F.lit(85.06)),
        band=coords.mercator_band(F.lit(85.07)),
        parsed=coords.parse_lon_lat(F.lit("(10.5, -3.25, 0.) (deg, deg, m)")),
    )
    assert row["column"] == pytest.approx(0.025)
    assert row["ordinate"] == pytest.approx(0.05238381856676326, abs=1e-15)
    assert row["x"] == pytest.approx(math.pi * 6378137)
    assert row["y"] == pytest.approx(6378137 * math.log(math.tan(math.pi / 4 + math.radians(85.06) / 2)))
    assert row["band"] is False
    assert (row["parsed"]["lon"], row["parsed"]["lat"]) == (10.5, -3.25)


def test_text_positions_are_cast_before_arithmetic(spark):
    frame = coords.with_lon_lat(spark.createDataFrame([("10.5", "-3")], "ra string, dec string"))
    assert frame.select("lon", "lat").first()[:] == (-169.5, -3.0)


def test_point_text_both_ways(spark):
    lon, lat = F.lit(-29.5), F.lit(1e-7)
    row = one(spark, text=geo.point_wkt(lon, lat), back=geo.parse_point_wkt(geo.point_wkt(lon, lat)), bad=geo.parse_point_wkt(F.lit("POLYGON EMPTY")))
    assert row["text"].startswith("POINT (-29.5 ")
    assert (row["back"]["lon"], row["back"]["lat"]) == (-29.5, 1e-7)
    assert row["bad"]["lon"] is None


def test_buffer_ring(spark):
    ring = geo.buffer_ring(F.lit(10.0), F.lit(5.0), 0.5)
    row = one(spark, ring=ring, area=geo.ring_area(ring), closed=geo.buffer_area(0.5), text=geo.ring_wkt(ring))
    assert len(row["ring"]) == 33 and row["ring"][0] == row["ring"][-1]
    assert row["area"] == pytest.approx(row["closed"], rel=1e-12)
    assert row["closed"] == pytest.approx(16 * 0.25 * math.sin(math.pi / 16))
    assert row["text"].startswith("POLYGON ((10.5 5.0, ") and row["text"].endswith("10.5 5.0))")


@pytest.mark.parametrize(
    "turn, share, disc, polygon",
    [(0.0, 1.0, True, True), (math.pi / 32, 0.998, True, False), (math.pi / 32, 0.995, True, True), (1.0, 1.01, False, False)],
)
def test_disc_and_polygon_membership(spark, turn, share, disc, polygon):
    dx, dy = F.lit(0.25 * share * math.cos(turn)), F.lit(0.25 * share * math.sin(turn))
    row = one(spark, disc=geo.in_disc(dx, dy, 0.25), polygon=geo.in_polygon(dx, dy, 0.25))
    assert (row["disc"], row["polygon"]) == (disc, polygon)


def test_rim_belongs_to_intersects_not_to_contains(spark):
    dx, dy, zero = F.lit(0.25), F.lit(0.0), F.lit(0.0)
    row = one(
        spark,
        a=geo.in_disc(dx, dy, 0.25),
        b=geo.in_disc(dx, dy, 0.25, boundary=False),
        c=geo.in_polygon(dx, dy, 0.25, boundary=False),
        d=geo.in_disc(zero, zero, 0.0),
    )
    assert row[:] == (True, False, False, True)


def geohash_of(lon, lat, length):
    """Halving intervals bit by bit."""
    x, y, text, digit = [-180.0, 180.0], [-90.0, 90.0], "", 0
    for n in range(5 * length):
        box, value = (x, lon) if n % 2 == 0 else (y, lat)
        middle = sum(box) / 2
        digit = digit * 2 + (value >= middle)
        box[0 if value >= middle else 1] = middle
        if n % 5 == 4:
            text, digit = text + ALPHABET[digit], 0
    return text


def test_geohash(spark):
    rng = random.Random(3)
    rows = [(-5.6, 42.6), (0.0, 0.0), (-180.0, -90.0)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    for length in (1, 5, 8, 9):
        for row in with_geohash(frame, length).collect():
            assert row["geohash"] == geohash_of(row["lon"], row["lat"], length)
    edge = spark.createDataFrame([(180.0, 90.0)], "lon double, lat double")
    assert with_geohash(edge, 5).first()["geohash"] == "zzzzz"


def s2_of(lon, lat, level):
    """The published numbering, one level at a time."""
    t, p = math.radians(lon), math.radians(lat)
    v = [math.cos(p) * math.cos(t), math.cos(p) * math.sin(t), math.sin(p)]
    axis = max(range(3), key=lambda k: abs(v[k]))
    face = axis + (3 if v[axis] < 0 else 0)
    x, y, z = v
    u, w = [(y / x, z / x), (-x / y, z / y), (-x / z, -y / z), (z / x, y / x), (z / y, -x / y), (-y / z, -x / z)][face]
    def index(c):
        s = 0.5 * math.sqrt(1 + 3 * c) if c >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * c)
        return min(max(int(math.floor(s * (1 << 30))), 0), (1 << 30) - 1)
    i, j, turn, number = index(u), index(w), face & 1, face
    for k in range(29, 29 - level, -1):
        step = QUADRANT_AT[turn].index(2 * (i >> k & 1) + (j >> k & 1))
        number, turn = number * 4 + step, turn ^ ORIENTATION_CHANGE[step]
    number = number << (61 - 2 * level) | 1 << (60 - 2 * level)
    return number - (1 << 64) if number >= 1 << 63 else number


@pytest.mark.parametrize(
    "lon, lat, level, cell",
    [(1.0, 3.0, 6, 1161084278931456000), (5.0, 6.0, 6, 1170654428139618304), (0.0, 0.0, 30, 1152921504606846977)],
)
def test_s2_known_cells(spark, lon, lat, level, cell):
    frame = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    assert with_s2_cell(frame, level).first()["cell_id"] == cell


def s2_sample(spark):
    rng = random.Random(5)
    rows = [(math.degrees(2 * math.pi * rng.random()) - 180, math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(800)]
    return spark.createDataFrame(rows + [(0.0, 90.0), (0.0, -90.0), (-180.0, 0.0)], "lon double, lat double")


def avoid_poles(row):
    return abs(row["lat"]) < 90 and row["lon"] > -180


@pytest.mark.parametrize("level", [1, 4, 9, 16])
def test_s2_all_faces(spark, level):
    frame = with_s2_cell(s2_sample(spark), level)
    for row in filter(avoid_poles, frame.collect()):
        assert row["cell_id"] == s2_of(row["lon"], row["lat"], level)


def test_s2_parent(spark):
    fine = with_s2_cell(with_s2_cell(s2_sample(spark), 4, "coarse"), 9, "fine")
    assert fine.where(s2_parent(F.col("fine"), 4) != F.col("coarse")).count() == 0


def test_rows_without_position_have_no_s2_cell(spark):
    frame = spark.createDataFrame([(None, 1.0)], "lon double, lat double")
    assert with_s2_cell(frame, 9).first()["cell_id"] == 0
    assert with_geohash(frame).first()["geohash"] is None


def around(lon, lat, distance, bearing):
    """Destination on the sphere."""
    t, p, d = math.radians(lon), math.radians(lat), math.radians(distance)
    q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(bearing))
    s = t + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
    return (math.degrees(s) + 540) % 360 - 180, math.degrees(q)


CORNER = math.degrees(math.asin(1 / math.sqrt(3)))
CENTRES = (
    [(lon, lat) for lon in (-135.0, -45.0, 45.003, 135.0, 0.0) for lat in (CORNER, -CORNER + 0.004, 0.0, 20.0)]
    + [(0.0, 90.0), (5.0, -89.999), (179.9999, 0.0), (-180.0, 10.0), (33.3, 71.0)]
)


def neighbourhood(radius, seed):
    rng = random.Random(seed)
    return [
        (n, *around(lon, lat, radius * (1.0 if k % 3 == 0 else math.sqrt(rng.random())), rng.uniform(0, 2 * math.pi)))
        for n, (lon, lat) in enumerate(CENTRES)
        for k in range(60)
    ]


@pytest.mark.parametrize(
    "index, radius",
    [
        (S2Cells(9), 60 / 3600),
        (S2Cells(9), 0.5),
        (S2Cells(12), 60 / 3600),
        (S2Cells(4), 12.0),
        (SphereGrid(0.05), 60 / 3600),
        (SphereGrid(2.0), 1.0),
        (SphereGrid(1.0), 3.0),
    ],
)
def test_cover_holds_every_place_within_the_radius(spark, index, radius):
    centres = spark.createDataFrame([(n, *c) for n, c in enumerate(CENTRES)], "n int, lon double, lat double")
    cover = index.explode_cover(centres, F.lit(radius), "cell").select("n", "cell")
    assert cover.count() == cover.distinct().count()
    assert cover.groupBy("n").count().agg(F.max("count")).first()[0] <= index.cover_bound(radius)
    places = spark.createDataFrame(neighbourhood(radius, 11), "n int, lon double, lat double")
    lost = index.with_cell(places, "cell").join(cover, ["n", "cell"], "left_anti")
    assert lost.count() == 0


def test_s2_cover_has_no_idle_cell(spark):
    """Each cell of the cover is really met: some place of a dense sample of the circle falls in it."""
    radius, level = 2.0, 4
    centres = spark.createDataFrame([(0, -135.0, CORNER), (1, 12.0, 33.0)], "n int, lon double, lat double")
    cover = {(r["n"], r["cell_id"]) for r in explode_s2_cover(centres, F.lit(radius), level).collect()}
    hit = set()
    for n, lon, lat in ((0, -135.0, CORNER), (1, 12.0, 33.0)):
        for k in range(720):
            for share in (0.0, 0.3, 0.6, 0.9, 0.9999):
                hit.add((n, s2_of(*around(lon, lat, radius * share, k * math.pi / 360), level)))
    assert cover == hit


def test_plane_grid_takes_at_most_four_cells(spark):
    grid, radius = PlaneGrid(0.05), 0.024
    points = spark.range(500).select(F.rand(1).alias("lon"), (F.rand(2) - 0.5).alias("lat"), "id")
    cover = grid.explode_cover(points, F.lit(radius), "cell")
    assert cover.groupBy("id").count().agg(F.max("count")).first()[0] == 4
    for dx, dy in ((radius, 0), (-radius, 0), (0, radius), (0, -radius), (0, 0)):
        moved = points.select("id", (F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
        assert grid.with_cell(moved, "cell").join(cover.select("id", "cell"), ["id", "cell"], "left_anti").count() == 0


def test_sphere_distance_helper():
    assert sphere_distance(359.5, 0, 0.5, 0) == pytest.approx(1.0)


def test_wkt_of_any_form_parses_alike(spark):
    texts = ["POINT (1.5 -2)", "POINT (1 5 2)", "point(1 2)", " POINT ( 1   2 ) ", "POINT (1 2)x)", "POINT (1 abc)", "POINT (5)", "POINT ()", "POINT (1  2)", "POINT (1\t2)", "POINT (1e3 NaN)", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.inline(F.array(geo.parse_point_wkt(F.col("t"))))).collect()
    got = [(r["lon"], "nan" if r["lat"] != r["lat"] else r["lat"]) for r in rows]
    none = (None, None)
    assert got == [(1.5, -2.0), none, (1.0, 2.0), (1.0, 2.0), none, (1.0, None), none, none, (1.0, 2.0), (1.0, 2.0), (1000.0, "nan"), none]


def test_points_of_many_texts_are_parsed_as_one_by_one(spark):
    texts = ["POINT (1.5 -2.0)", "POINT (1 2) ", "point(1 2)", "POINT (1  2)", "POINT (1 2))", "POINT ((1 2)", "POINT (1 x)", "POINT (1)", "POINT ( )", "", None, "POINT (NaN 1e3)", "POINT (1 2 3)", "POINT (1\t2)"]
    frame = spark.createDataFrame([(n, t, t and t[::-1][::-1]) for n, t in enumerate(texts)], "n int, `a.b` string, c string")
    got = geo.with_parsed_points(frame, {"a.b": "p", "c": "q"})
    assert got.columns == ["n", "a.b", "c", "p", "q"]
    want = frame.select("n", geo.parse_point_wkt(F.col("`a.b`")).alias("p")).orderBy("n").collect()
    rows = got.orderBy("n").collect()
    assert [str(r["p"]) for r in rows] == [str(r["q"]) for r in rows] == [str(r["p"]) for r in want]
    assert [tuple(r["p"]) for r in rows[:7]] == [(1.5, -2.0), (1.0, 2.0), (1.0, 2.0), (1.0, 2.0), (None, None), (None, 2.0), (1.0, None)]
    # A text is cut, and a piece made a number, once; the pattern's two numbers a text are for other forms only.
    plan = plan_text(got.select("p.lon", "p.lat", "q.lon", "q.lat")).split("== Physical Plan ==")[1]
    assert plan.count("try_cast(") - plan.count("try_cast(regexp_extract") == 4


def test_nearly_all_points_of_a_polygon_need_no_angle(spark):
    """The circle inside decides for itself what the polygon's own test says."""
    grid = spark.range(201 * 201).select(((F.col("id") % 201) / 100 - 1).alias("dx"), (F.floor(F.col("id") / 201) / 100 - 1).alias("dy"))
    got = geo.polygon_measure(F.col("dx"), F.col("dy")) < geo.polygon_limit(F.lit(1.0))
    inside = geo.well_inside(F.col("dx"), F.col("dy"), 1.0)
    row = grid.agg(F.count(F.when(got, 1)).alias("all"), F.count(F.when(inside & got, 1)).alias("both"), F.count(F.when(inside, 1)).alias("inner")).first()
    assert row["both"] == row["inner"] and row["inner"] > 0.98 * row["all"]
    for boundary in (True, False):
        assert grid.where("dx = 0 AND dy = 0").where(geo.in_polygon(F.col("dx"), F.col("dy"), 0.0, boundary)).count() == boundary
