import math
import random

import pytest
from pyspark.sql import functions as F

from almagest.functions.cells import PlaneGrid, RadiusClasses
from almagest.functions.s2 import S2Cells
from almagest.operators import match
from almagest.operators.occurring import bitmap_bits, with_occurring_keys
from almagest.operators.skew import REPEATS, hot_buckets, hot_of, join_partitions, lookup_join, row_spread, salted_join
from almagest.queries import search
from almagest.sources.points import points_from_rows, read_points_wkt
from almagest.functions.coords import with_lon_lat
from conftest import executed, metric as metric_of, pair_ids, plan_text, plane_pairs, sphere_distance


def patch(n, seed, ra=(150.0, 151.0), dec=(-0.5, 0.5)):
    rng = random.Random(seed)
    return [(k, rng.uniform(*ra), rng.uniform(*dec)) for k in range(n)]


@pytest.fixture
def scene(sky_points):
    sources, points = patch(400, 1), patch(60, 2)
    return sources, points, sky_points(sources), sky_points(points, "point_id")


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"index": PlaneGrid(0.3)},
        {"index": PlaneGrid(0.01)},
        {"index": S2Cells(9)},
        {"index": S2Cells(11)},
        {"strategy": "shuffle"},
        {"strategy": "shuffle", "pair_target": 3},
        {"strategy": "shuffle", "pair_target": 1, "index": S2Cells(9)},
    ],
)
def test_every_plan_gives_the_brute_force_pairs(scene, options):
    sources, points, catalog, query = scene
    assert pair_ids(match.cone_pairs(catalog, query, 0.04, **options)) == plane_pairs(sources, points, 0.04)


def test_no_plan_compares_all_with_all(scene):
    *_, catalog, query = scene
    for options in ({}, {"strategy": "shuffle", "pair_target": 2}, {"index": S2Cells(9)}):
        text = plan_text(match.cone_pairs(catalog, query, 0.04, **options))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_rim_and_polygon(sky_points):
    catalog = sky_points([(1, 10.25, 0.0), (2, 10 + 0.2495 * math.cos(math.pi / 32), 0.2495 * math.sin(math.pi / 32)), (3, 10.0, 0.0)])
    query = sky_points([(0, 10.0, 0.0)], "point_id")

    def found(**options):
        return [i for i, _ in pair_ids(match.cone_pairs(catalog, query, 0.25, **options))]

    assert found() == [1, 2, 3]
    assert found(shape="polygon") == [1, 3]
    assert found(boundary=False) == [2, 3]
    assert found(shape="polygon", boundary=False) == [3]


def test_zero_radius_and_no_points(spark, sky_points):
    catalog = sky_points([(1, 10.0, 5.0), (2, 10.0, 5.0001)])
    query = sky_points([(0, 10.0, 5.0)], "point_id")
    assert pair_ids(match.cone_pairs(catalog, query, 0.0)) == [(1, 0)]
    none = query.where("point_id < 0")
    for strategy in ("auto", "shuffle"):
        assert match.cone_pairs(catalog, none, 0.1, strategy=strategy).count() == 0
    assert match.count_matches(catalog, none, [0.1, 1.0]).collect() == [(0.1, 0), (1.0, 0)]
    empty = with_lon_lat(points_from_rows(spark, []))
    assert match.cone_match(catalog, empty, 0.1).count() == 0


def test_rows_without_position_match_nothing(spark, sky_points):
    catalog = sky_points([(1, 10.0, 5.0)]).unionByName(
        with_lon_lat(spark.createDataFrame([(2, None, 5.0)], "source_id bigint, ra double, dec double"))
    )
    query = sky_points([(0, 10.0, 5.0)], "point_id")
    for options in ({}, {"strategy": "shuffle"}, {"index": S2Cells(9)}):
        assert pair_ids(match.cone_pairs(catalog, query, 0.1, **options)) == [(1, 0)]


def test_bad_arguments(scene):
    *_, catalog, query = scene
    for bad in ({"radius": -1.0}, {"strategy": "x"}, {"metric": "x"}, {"metric": "great_circle", "shape": "polygon"}):
        with pytest.raises(ValueError):
            match.cone_pairs(catalog, query, **{"radius": 0.1, **bad})
    with pytest.raises(ValueError):
        match.hybrid_match(catalog, query, 0.1)


def test_repeated_points_and_sources(sky_points):
    catalog = sky_points([(1, 10.0, 5.0), (1, 10.0, 5.0), (2, 10.01, 5.0)])
    query = sky_points([(7, 10.0, 5.0), (7, 10.0, 5.0)], "point_id")
    assert match.cone_match(catalog, query, 0.02).count() == 6
    named = catalog.withColumn("source_id", F.col("source_id").cast("string"))
    assert match.cell_match(named, query, 0.02).count() == 3
    assert match.count_matches(catalog, query, [0.02]).first()["matches"] == 6
    assert match.count_matches(catalog, query, [0.02], distinct_points=True).first()["matches"] == 3


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
def test_hot_cell_and_copies(spark, sky_points, strategy):
    """A third of all rows at one place, on both sides, split down to single rows."""
    sources = patch(200, 4) + [(1000 + k, 150.5, 0.0) for k in range(100)]
    points = patch(30, 5) + [(500 + k, 150.5, 0.001) for k in range(15)]
    catalog, query = sky_points(sources), sky_points(points, "point_id")
    options = {"strategy": strategy, "pair_target": 2}
    want = plane_pairs(sources, points, 0.03)
    assert pair_ids(match.cone_pairs(catalog, query, 0.03, **options)) == want
    counted = match.count_matches(catalog, query, [0.0005, 0.03], **options).collect()
    assert [r["matches"] for r in counted] == [len(plane_pairs(sources, points, 0.0005)), len(want)]


def test_equal_rows_of_a_file_are_dealt_apart(spark, tmp_path):
    spark.range(4000).select(F.lit(7).alias("k"), F.lit("same").alias("v")).coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    pieces = stored.select(F.pmod(row_spread(stored), F.lit(8)).alias("piece")).groupBy("piece").count().collect()
    assert len(pieces) == 8 and max(r["count"] for r in pieces) < 700
    moved = stored.where("k = 7").withColumn("z", F.col("k") + 1).select("z", "v")
    assert moved.select(row_spread(moved).alias("h")).distinct().count() == 4000
    other = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "k int, w string")
    assert salted_join(stored, other, ["k"], pair_target=10).count() == 8000
    assert lookup_join(stored, other, ["k"]).count() == 8000


def test_radius_per_point(sky_points):
    sources, points = patch(300, 8), patch(40, 9)
    radius = {i: 0.002 * (i % 20) for i, _, _ in points}
    query = sky_points(points, "point_id").withColumn("r", 0.002 * (F.col("point_id") % 20))
    want = sorted(p for point in points for p in plane_pairs(sources, [point], radius[point[0]]))
    assert pair_ids(match.cone_pairs(sky_points(sources), query, "r")) == want


POLE_AND_WRAP = [
    (0, 359.9999, 0.0), (1, 0.0001, 0.0), (2, 0.0, 90.0), (3, 123.0, -90.0), (4, 10.0, 89.7), (5, 190.0, 89.8),
    (6, 45.0, 60.0), (7, 45.9, 60.0), (8, 47.1, 60.0), (9, 200.0, -89.4), (10, 300.0, 89.1),
]


@pytest.mark.parametrize("options", [{}, {"strategy": "shuffle", "pair_target": 1}, {"index": S2Cells(6)}])
def test_great_circle(sky_points, options):
    rng = random.Random(6)
    sources = POLE_AND_WRAP + [(100 + k, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(1500)]
    points = POLE_AND_WRAP + [(100 + k, rng.uniform(0, 360), rng.uniform(-90, 90)) for k in range(80)]
    want = sorted((i, j) for i, a, d in sources for j, b, e in points if sphere_distance(a, d, b, e) <= 1.0)
    got = pair_ids(match.cone_pairs(sky_points(sources), sky_points(points, "point_id"), 1.0, metric="great_circle", **options))
    assert got == want
    assert {(0, 1), (2, 4), (4, 5), (3, 9), (6, 7)} <= set(got) and (6, 8) not in got


def test_planar_and_great_circle_differ_at_high_declination(sky_points):
    catalog, query = sky_points([(1, 11.9, 60.0)]), sky_points([(0, 10.0, 60.0)], "point_id")
    assert match.cone_pairs(catalog, query, 1.0).count() == 0
    assert match.cone_pairs(catalog, query, 1.0, metric="great_circle").count() == 1


@pytest.mark.parametrize("height", [None, 0.01, 5.0])
def test_grouped_lists(scene, spark, tmp_path, height):
    sources, points, catalog, query = scene

    def rows(layer):
        groups = match.grouped_match(layer, query, 0.08, center=["point_id", "lon", "lat"], attributes=["source_id", "ra"], part_height=height)
        return sorted((g["point_id"], g["part"], [tuple(m) for m in g["matches"]]) for g in groups.collect())

    got = rows(catalog)
    assert sorted((m[0], point) for point, _, matches in got for m in matches) == plane_pairs(sources, points, 0.08)
    assert all(matches == sorted(matches) for _, _, matches in got)
    assert len({(point, part) for point, part, _ in got}) == len(got)
    for n in (1, 5):
        catalog.repartition(n).write.parquet(str(tmp_path / f"layout{n}"))
        assert rows(spark.read.parquet(str(tmp_path / f"layout{n}"))) == got


def test_lists_are_bounded(spark, sky_points, tmp_path):
    """A dense field, and many sources on one spot: no list is long, and the rows are the same whatever the files."""
    sources = patch(6000, 44) + [(k, 150.5, 0.25) for k in range(10_000, 10_300)]
    points = [(0, 150.5, 0.25), (1, 151.0, -0.5), (2, 10.0, 0.0)]
    catalog, query = sky_points(sources), sky_points(points, "point_id")

    def rows(layer, **options):
        groups = match.grouped_match(layer, query, 0.3, center=["point_id"], attributes=["source_id"], list_rows=50, **options)
        return sorted((g["point_id"], g["part"], g["square"], g["run"], [m[0] for m in g["matches"]]) for g in groups.collect())

    got = rows(catalog)
    assert sorted((m, point) for point, *_, matches in got for m in matches) == plane_pairs(sources, points, 0.3)
    assert max(len(matches) for *_, matches in got) == 50
    assert all(matches == sorted(matches) for *_, matches in got) and len({g[:4] for g in got}) == len(got)
    # Runs go on only on the crowded spot; a full part is cut so that squares hold fewer.
    runs = [g for g in got if g[3] > 0]
    assert 5 <= len(runs) < 12 and len({g[2] for g in got if g[1] == runs[0][1]}) > 16
    for n in (1, 6):
        catalog.repartition(n).write.parquet(str(tmp_path / f"layout{n}"))
        assert rows(spark.read.parquet(str(tmp_path / f"layout{n}"))) == got
    assert rows(catalog, strategy="shuffle") == got
    sphere = rows(catalog, metric="great_circle")
    assert {m for point, *_, matches in sphere for m in matches if point == 0} >= {k for k in range(10_000, 10_300)}


def test_cells_follow_the_radius(sky_points):
    sources, points = patch(3000, 21), patch(400, 22)
    catalog, query = sky_points(sources), sky_points(points, "point_id")
    for radius in (1e-4, 1e-3, 1e-2):
        profile = match.measure(match.query_side(query, radius, "lon", "lat"), F.lit(radius), "lon", "lat")
        grid = RadiusClasses(profile.classes)
        cover = grid.explode_cover(match.query_side(query, radius, "lon", "lat"), F.lit(radius), "c", "query_lon", "query_lat")
        candidates = grid.with_cell(catalog, "c").join(cover, [*grid.keys, "c"]).count()
        # Up to four cells, each at most four radii wide.
        assert candidates <= 3000 * 400 * 64 * radius * radius + 40 and cover.count() <= 4 * 400


def test_one_wide_circle_leaves_the_others_alone(sky_points):
    sources, points = patch(2000, 23), patch(300, 24)
    query = sky_points(points, "point_id").withColumn("r", F.when(F.col("point_id") == 0, 0.4).otherwise(F.lit(0.0003)))
    catalog = sky_points(sources)
    profile = match.measure(match.query_side(query, "r", "lon", "lat"), F.col("query_r"), "lon", "lat")
    assert len(profile.classes) == 2
    grid = RadiusClasses(profile.classes)
    cover = grid.explode_cover(match.query_side(query, "r", "lon", "lat"), F.col("query_r"), "c", "query_lon", "query_lat")
    assert grid.with_cell(catalog, "c").join(cover, ["__class", "c"]).count() < 2200
    want = sorted(p for point in points for p in plane_pairs(sources, [point], 0.4 if point[0] == 0 else 0.0003))
    for strategy in ("auto", "shuffle"):
        assert pair_ids(match.cone_pairs(catalog, query, "r", strategy=strategy)) == want


def test_negative_and_missing_radii_match_nothing(sky_points):
    catalog = sky_points([(1, 10.0, 5.0), (2, 10.5, 5.0)])
    query = sky_points([(0, 10.0, 5.0), (1, 10.0, 5.0), (2, 10.0, 5.0)], "point_id").withColumn("r", F.element_at(F.array(F.lit(-1.0), F.lit(2.0), F.lit(None)), (F.col("point_id") + 1).cast("int")))
    assert pair_ids(match.cone_pairs(catalog, query, "r")) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("radius", [90.0, 100.0, 150.0, 180.0, 200.0])
def test_circles_of_half_the_sky(sky_points, radius):
    rng = random.Random(31)
    sources = [(k, rng.uniform(0, 360), rng.uniform(-90, 90)) for k in range(200)]
    points = [(k, rng.uniform(0, 360), rng.uniform(-90, 90)) for k in range(12)]
    catalog, query = sky_points(sources), sky_points(points, "point_id")
    far = sorted((i, j) for i, a, d in sources for j, b, e in points if sphere_distance(a, d, b, e) <= radius)
    for index in (None, S2Cells(3)):
        assert pair_ids(match.cone_pairs(catalog, query, radius, index=index, metric="great_circle")) == far
        assert pair_ids(match.cone_pairs(catalog, query, radius, index=index)) == plane_pairs(sources, points, radius)


def test_counts_on_the_rim(sky_points):
    catalog, query = sky_points([(1, 10.5, 0.0), (2, 11.0, 0.0)]), sky_points([(0, 10.0, 0.0)], "point_id")
    for strategy in ("auto", "shuffle"):
        count = lambda **o: [r["matches"] for r in match.count_matches(catalog, query, [0.5, 1.0], strategy=strategy, **o).sort("radius").collect()]
        assert count() == [1, 2] and count(boundary=False) == [0, 1]


def test_groups_without_matches_count_zero(sky_points):
    catalog = sky_points([(1, 10.0, 0.0)])
    query = sky_points([(0, 10.0, 0.0), (1, 50.0, 50.0)], "point_id").withColumn("name", F.when(F.col("point_id") == 0, "near"))
    rows = {(r["name"], r["radius"]): r["matches"] for r in match.count_matches(catalog, query, [0.1, 0.2], by=["name"]).collect()}
    assert rows == {("near", 0.1): 1, ("near", 0.2): 1, (None, 0.1): 0, (None, 0.2): 0}


def test_merged_positions_keep_rows_whole(spark):
    points = spark.createDataFrame([(1.0, 1.0, 2, "a"), (1.0, 1.0, 1, "b"), (2.0, 1.0, None, "c")], "lon double, lat double, n int, s string")
    assert sorted(match.distinct_positions(points).collect()) == [(1.0, 1.0, 1, "b"), (2.0, 1.0, None, "c")]


def test_a_product_of_sides_is_split(spark, tmp_path):
    """Each side below any row limit, the product above it; equal rows of frames and of files."""
    left = spark.range(3000).select(F.lit(7).alias("k"), F.lit("same").alias("a"))
    right = spark.range(2000).select(F.lit(7).alias("k"), (F.col("id") % 500).alias("b"))
    hot = hot_buckets(left, right, ["k"], 100_000)
    assert len(hot) == 1 and 60 <= hot[0][1] * hot[0][2] <= 140
    left.write.parquet(str(tmp_path / "l"))
    for side in (left, spark.read.parquet(str(tmp_path / "l"))):
        joined = salted_join(side, right, ["k"], 100_000)
        assert joined.count() == 3000 * 2000
        assert joined.groupBy("b").count().where("count != 12000").count() == 0
    # Dealt out to 64 partitions, the fullest task makes a small part of the pairs.
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = salted_join(spark.read.parquet(str(tmp_path / "l")), right, ["k"], 100_000)
        fullest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert fullest < 3000 * 2000 / 4


def test_one_shuffle_of_the_catalog_in_counts(scene, spark, tmp_path):
    *_, catalog, query = scene
    catalog.write.parquet(str(tmp_path / "c"))
    text = plan_text(match.count_matches(spark.read.parquet(str(tmp_path / "c")), query, [0.04], strategy="shuffle"))
    physical = text[text.index("== Physical Plan ==") :]
    # The catalog, the points' circles and the cells they touch, each of the two from points merged by position.
    assert physical.count("FileScan parquet") == 1 and physical.count("Exchange hashpartitioning") == 5
    assert physical.count("BroadcastExchange") == 1 and physical.index("LeftSemi") > physical.index("Exchange hashpartitioning")


def shuffled_rows(df):
    """Rows that each exchange of an executed plan has written."""
    return [metric_of(node, "shuffleRecordsWritten") for name, node in executed(df) if name == "ShuffleExchangeExec"]


@pytest.mark.parametrize("metric", ["planar", "great_circle"])
def test_only_rows_in_cells_that_occur_are_shuffled(sky_points, spark, tmp_path, metric):
    sources, points = patch(5000, 41), patch(12, 42)
    sky_points(sources).write.parquet(str(tmp_path / "c"))
    catalog, query = spark.read.parquet(str(tmp_path / "c")), sky_points(points, "point_id")
    pairs = match.cone_pairs(catalog, query, 0.02, metric=metric, strategy="shuffle")
    profile = match.measure(match.query_side(query, 0.02, "lon", "lat"), F.lit(0.02), "lon", "lat")
    grid = RadiusClasses(profile.classes, metric)
    cells = {r["c"] for r in grid.explode_cover(match.query_side(query, 0.02, "lon", "lat"), F.lit(0.02), "c", "query_lon", "query_lat").collect()}
    held = grid.with_cell(catalog, "c").where(F.col("c").isin(cells)).count()
    rows = shuffled_rows(pairs)
    # The box of the points holds back a few more.
    assert held * 0.8 < max(rows) <= held < 500
    assert pair_ids(pairs) == pair_ids(match.cone_pairs(catalog, query, 0.02, metric=metric))


def test_a_bitmap_of_cells_loses_nothing(spark):
    rng = random.Random(43)
    wanted = {rng.randrange(10**12) for _ in range(3000)}
    keys = spark.createDataFrame([(k, 1) for k in wanted] * 2, "__cell bigint, other int")
    rows = spark.createDataFrame([(k,) for k in wanted] + [(rng.randrange(10**12, 10**13),) for _ in range(30_000)], "__cell bigint").withColumn("__place", F.lit(1))
    assert with_occurring_keys(rows, keys, ["__cell"]).count() == len(wanted)
    # With no room for the cells themselves: hashed, eight bits or more to a cell.
    hashed = with_occurring_keys(rows, keys, ["__cell"], limit=16_000)
    assert hashed.columns == rows.columns and "BroadcastExchange" in plan_text(hashed)
    got = {r["__cell"] for r in hashed.collect()}
    assert wanted <= got and len(got) < len(wanted) + 30_000 / 8
    assert bitmap_bits(9000, 16_000) == 65_536 and bitmap_bits(1, 16_000) == 32_768 and bitmap_bits(10**9) == 2**29
    # More cells than bits: nothing is held back.
    many = spark.range(40_000).select(F.col("id").alias("__cell"))
    assert with_occurring_keys(rows, many, ["__cell"], limit=100).count() == rows.count()
    assert with_occurring_keys(rows, keys.limit(0), ["__cell"]).count() == 0


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
def test_radii_that_are_no_finite_number(sky_points, strategy):
    catalog = sky_points([(1, 10.0, 5.0), (2, 10.5, 5.0)])
    query = sky_points([(0, 10.0, 5.0), (1, 10.0, 5.0), (2, 10.0, 5.0)], "point_id")
    radii = lambda *r: query.withColumn("r", F.element_at(F.array(*[F.lit(x) for x in r]), (F.col("point_id") + 1).cast("int")))
    assert pair_ids(match.cone_pairs(catalog, radii(math.nan, 0.1, -1.0), "r", strategy=strategy)) == [(1, 1)]
    assert match.cone_pairs(catalog, radii(math.nan, math.nan, math.nan), "r", strategy=strategy).count() == 0
    for options in ({}, {"metric": "great_circle"}):
        with pytest.raises(ValueError, match="no bound"):
            match.cone_pairs(catalog, radii(0.1, math.inf, 0.1), "r", strategy=strategy, **options)
    for radius in (math.nan, math.inf, -math.inf, -1.0):
        with pytest.raises(ValueError, match="finite"):
            match.cone_pairs(catalog, query, radius, strategy=strategy)
    nowhere = sky_points([(0, math.nan, 5.0), (1, 10.0, math.nan)], "point_id").union(query.where("point_id = 2"))
    assert pair_ids(match.cone_pairs(catalog, nowhere, 0.1, strategy=strategy)) == [(1, 2)]


def test_counts_by_set_and_shape(scene):
    sources, points, catalog, query = scene
    named = query.withColumn("set_name", F.when(F.col("point_id") < 20, "a").otherwise("b"))
    rows = match.count_matches(catalog, named, [0.01, 0.05], by=["set_name"]).collect()
    for row in rows:
        part = [p for p in points if (p[0] < 20) == (row["set_name"] == "a")]
        assert row["matches"] == len(plane_pairs(sources, part, row["radius"]))
    polygon = match.count_matches(catalog, query, [0.05], shape="polygon").first()["matches"]
    assert polygon == match.cone_pairs(catalog, query, 0.05, shape="polygon").count()


def test_text_match(scene):
    sources, points, catalog, query = scene
    text = catalog.select(match.geo.point_wkt(F.col("lon"), F.col("lat")).alias("geom"))
    assert match.wkt_match(text, query, 0.04).count() == len(plane_pairs(sources, points, 0.04))
    assert match.first_pair(match.cone_match(catalog, query, 0.04)).count() == 1


@pytest.mark.parametrize("index", [None, PlaneGrid(0.5)])
@pytest.mark.parametrize("metric", ["planar", "great_circle"])
def test_cells_are_finer_where_many_circles_meet_a_dense_catalog(sky_points, monkeypatch, index, metric):
    sources, points = patch(3000, 51), patch(200, 52)
    catalog, query = sky_points(sources), sky_points(points, "point_id")
    want = pair_ids(match.cone_pairs(catalog, query, 0.1, metric=metric))
    profile = match.measure(match.query_side(query, 0.1, "lon", "lat"), F.lit(0.1), "lon", "lat")
    monkeypatch.setattr(match, "MANY_CIRCLES", 100)
    fitted = match._fitted(index, catalog, profile, metric, "lon", "lat")
    finer = fitted if index is None else fitted.inner
    assert finer.halvings >= 1
    cover = fitted.explode_cover(match.query_side(query, 0.1, "lon", "lat"), F.lit(0.1), "c", "query_lon", "query_lat")
    coarse = index or RadiusClasses(profile.classes, metric)
    wide = coarse.explode_cover(match.query_side(query, 0.1, "lon", "lat"), F.lit(0.1), "c", "query_lon", "query_lat")
    met = [cells.with_cell(catalog, "c").join(side, [*getattr(cells, "keys", ()), "c"]).count() for cells, side in ((fitted, cover), (coarse, wide))]
    assert met[0] < 0.7 * met[1]
    for strategy in ("auto", "shuffle"):
        assert pair_ids(match.cone_pairs(catalog, query, 0.1, metric=metric, index=index, strategy=strategy, pair_target=50)) == want


def test_hot_pieces_add_a_bounded_number_of_rows():
    counts = {n: [1000, 100] if n else [600_000, 90_000] for n in range(50)}
    hot = hot_of(counts, 2)
    rows = sum(a + b for a, b in counts.values())
    assert hot and sum(counts[n][0] * (b - 1) + counts[n][1] * (a - 1) for n, a, b in hot) <= REPEATS * rows
    assert join_partitions(counts, 10**9) == 55 and join_partitions({0: [10, 10]}) is None


@pytest.mark.parametrize("shape", ["disc", "polygon"])
@pytest.mark.parametrize("boundary", [True, False])
def test_lists_without_pairs_are_those_of_pairs(sky_points, monkeypatch, shape, boundary):
    """Centers that several points share, null ones, spots too full for a row, rims; lists longer than a run."""
    snap = lambda rows: [(k, round(a * 8) / 8, round(d * 8) / 8) for k, a, d in rows]
    sources = snap(patch(900, 61)) + [(k, 150.5, 0.25) for k in range(10_000, 10_080)]
    catalog, query = sky_points(sources), sky_points(snap(patch(60, 62)), "point_id")
    query = query.withColumn("name", F.when(F.col("point_id") % 5 > 0, F.col("point_id") % 40))
    monkeypatch.setattr(match, "HELD_ROWS", 40)

    def rows(**options):
        groups = match.grouped_match(catalog, query, 0.25, center=["name"], attributes=["source_id"], list_rows=7, shape=shape, boundary=boundary, **options)
        return sorted((str(g["name"]), g["part"], g["square"], g["run"], [m[0] for m in g["matches"]]) for g in groups.collect())

    assert rows() == rows(strategy="shuffle")


def test_lists_shuffle_no_pairs(sky_points):
    groups = match.grouped_match(sky_points(patch(4000, 63)), sky_points(patch(300, 64), "point_id"), 0.2, center=["point_id"], attributes=["source_id"])
    pairs = groups.agg(F.sum(F.size("matches"))).first()[0]
    assert pairs > 20_000 and max(shuffled_rows(groups)) <= 4000


def test_text_is_made_before_the_join(scene):
    *_, catalog, query = scene
    text = plan_text(match.cone_match(catalog, query, 0.04))
    physical = text[text.index("== Physical Plan ==") :]
    assert physical.index("POINT (") > physical.index("Join")


def test_cells_of_many_circles_are_listed_by_several_tasks(sky_points, monkeypatch):
    sources, points = patch(300, 71), patch(200, 72)
    catalog, query = sky_points(sources), sky_points(points, "point_id").coalesce(1)
    monkeypatch.setattr(match, "COVER_ROWS", 100)
    pairs = match.cone_pairs(catalog, query, 0.1, strategy="shuffle")
    assert "RepartitionByExpression" in plan_text(pairs) or "REPARTITION_BY_NUM" in plan_text(pairs)
    assert pair_ids(pairs) == plane_pairs(sources, points, 0.1)


def test_hot_keys_are_dealt_once(spark):
    """With one side cut in pieces the other's salt is 0 throughout; the join keeps the number of tasks it was given."""
    left, right = (spark.range(n).select(F.floor(F.col("id") / 10_000).alias("k"), F.col("id").alias(name)) for n, name in ((2000, "a"), (20, "b")))
    for sides in ((left, right), (right, left)):
        hot = hot_buckets(*sides, ["k"], 10_000)
        assert sorted(h > 1 for h in hot[0][1:]) == [False, True]
        joined = salted_join(*sides, ["k"], 10_000, hot, 11)
        assert joined.columns == ["k", sides[0].columns[1], sides[1].columns[1]]
        assert joined.distinct().count() == joined.count() == 40_000
        assert joined.rdd.getNumPartitions() == 11


def test_runs_do_not_carry_the_list_they_are_cut_from(sky_points):
    sources, points = [(k, 150.5, 0.25) for k in range(9)], [(0, 150.5, 0.25)]
    groups = match.grouped_match(sky_points(sources), sky_points(points, "point_id"), 0.1, center=["point_id"], attributes=["source_id"], list_rows=2)
    made = next(node for name, node in executed(groups) if name == "GenerateExec")
    assert "__matches" not in made.output().mkString(",")
    assert sorted((g["run"], [m[0] for m in g["matches"]]) for g in groups.collect()) == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5]), (3, [6, 7]), (4, [8])]


def test_fields_of_points_in_files_become_numbers_before_the_join(spark, tmp_path):
    for table, key, rows in (("orders", "o_orderkey", 300), ("customer", "c_custkey", 200)):
        spark.range(rows).select(F.col("id").alias(key)).write.parquet(str(tmp_path / f"{table}.parquet"))
    for query in (search.wkt_file_match, search.xy_file_match):
        text = plan_text(query(spark, str(tmp_path)))
        text = text[text.index("== Optimized Logical Plan ==") : text.index("== Physical Plan ==")]
        assert "cast" in text and "cast" not in text[: text.index("Join")]


def test_points_as_text_are_parsed_once(spark, tmp_path):
    lines = ["POINT (1.5 2.5),7", "point ( 3 4 ),8", "POINT (x 1),9", ",10"]
    (tmp_path / "points.csv").write_text("\n".join(lines))
    points = read_points_wkt(spark, str(tmp_path / "points.csv"))
    assert sorted((r["_c1"], r["lon"], r["lat"]) for r in points.collect()) == [("10", None, None), ("7", 1.5, 2.5), ("8", 3.0, 4.0), ("9", None, 1.0)]
    text = plan_text(points.where("lon IS NOT NULL AND lat > 0 AND NOT isnan(lon)"))
    text = text[text.index("== Optimized Logical Plan ==") : text.index("== Physical Plan ==")]
    assert text.count("regexp_extract") == 2


def test_hot_pieces_are_no_more_than_the_work_asks_for():
    """Few wide rows met by many narrow ones: the wide ones are not repeated a hundred times to make sixteen pieces."""
    ((_, left, right),) = hot_of({0: [9400, 9]}, 5333)
    assert 16 <= left * right <= 18 and left <= 16
    ((_, left, right),) = hot_of({0: [9400, 33_000]}, 10_000_000, (1, 2))
    assert left * right >= 32 and right > left


@pytest.mark.parametrize("shape", ["disc", "polygon"])
def test_crowded_spots_are_held_in_chunks(sky_points, monkeypatch, shape):
    """A spot with more sources than a row holds: its lists are cut from chunks, and pairs are not shuffled."""
    sources = [(k, 150.5 + k % 3 / 8, 0.25) for k in range(300)]
    points = [(k, 150.5 + k / 400, 0.25) for k in range(200)]
    catalog, query = sky_points(sources), sky_points(points, "point_id")
    monkeypatch.setattr(match, "HELD_ROWS", 40)
    monkeypatch.setattr(match, "PAIR_TARGET", 2000)
    lists = lambda **options: match.grouped_match(catalog, query, 0.2, center=["point_id"], attributes=["source_id"], part_height=0.1, list_rows=7, shape=shape, **options)
    rows = lambda groups: sorted((g["point_id"], g["part"], g["square"], g["run"], [m[0] for m in g["matches"]]) for g in groups.collect())
    got = rows(lists())
    assert got == rows(lists(strategy="shuffle")) and max(g[3] for g in got) == 14
    assert sum(len(g[4]) for g in got) > 30_000 and max(shuffled_rows(lists())) < 6000
    # No join makes a row a pair, as it would to number the pairs of a spot.
    assert max(metric_of(node, "numOutputRows") for name, node in executed(lists()) if "Join" in name) < 6000


def test_lists_of_two_are_the_same_however_many_parts_are_full(sky_points, monkeypatch):
    """The table of full parts may be too long to send; the squares are those of each part's own rows all the same."""
    sources = patch(600, 81) + patch(300, 82, (150.1, 150.2), (0.1, 0.2))
    catalog, query = sky_points(sources), sky_points(patch(40, 83), "point_id")

    def rows():
        groups = match.grouped_match(catalog, query, 0.1, center=["point_id"], attributes=["source_id"], list_rows=4)
        return sorted((g["point_id"], g["part"], g["square"], g["run"], [m[0] for m in g["matches"]]) for g in groups.collect())

    got = rows()
    monkeypatch.setattr(match, "BROADCAST_BYTES", 0)
    assert rows() == got


def test_whole_lists_are_one_row_however_long(spark, tmp_path):
    """More sources in a part than a row holds while lists are made, on one spot and beside it: one list a point and part."""
    spark.range(12_000).select((F.col("id") * 2000003).alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    ids = ",".join(str(k * 2000003) for k in range(12_000))
    for query in (search.cone_grouped, search.cone_grouped_parts):
        (row,) = query(spark, str(tmp_path)).collect()
        assert (row["point_id"], row["n"], row["ids"]) == (0, 12_000, ids)
