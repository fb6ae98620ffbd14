import gzip
import math
import random
import re
from decimal import Decimal

import pytest
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from almagest import schema
from almagest.functions.coords import with_lon_lat, with_point_columns
from almagest.operators import calibrate, match, ranges, stats
from almagest.plans import experiments, ingest, layouts
from almagest.functions.cells import PlaneGrid
from almagest.functions.s2 import S2Covering, covering_bound, explode_s2_cover, explode_s2_covering, with_s2_cell
from almagest.operators.ranges import united
from almagest.session import work_folder
from almagest.sources import points as point_sources
from almagest.sources import tables, tiles
from conftest import executed, metric, pair_ids, plan_text

COLUMNS = schema.CATALOG_COLUMNS


def catalog_row(n, ra, dec, **changes):
    values = {c: "1.25" for c in COLUMNS} | {
        "source_name": f"J{n}", "source_id": f"id{n}", "ra": repr(ra), "dec": repr(dec), "w1flg": "1", "w2flg": "0",
    } | changes
    return [values[c] for c in COLUMNS]


def tile_text(rows, header=None):
    head = header or "|" + "|".join(f" {c.upper()} " for c in COLUMNS) + "|"
    return "\n".join(["\\ a comment", head, "\\ more", *["   " + "  ".join(r) for r in rows], ""])


def write_tile(folder, name, text):
    data = text.encode()
    (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)


@pytest.fixture
def tile_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write_tile(folder, "0001p000_opt1.tbl.gz", tile_text([catalog_row(1, 10.0, 5.0), catalog_row(2, 10.01, 5.0, w1mag="null", w1flg="null")]))
    write_tile(folder, "0002m015_opt1.tbl", tile_text([catalog_row(3, 20.0, -5.0)]))
    write_tile(folder, "0003p000_opt1.tbl.gz", tile_text([catalog_row(4, 30.0, 1.0)]))
    write_tile(folder, "0003p000_rej_opt1.tbl.gz", tile_text([catalog_row(5, 31.0, 1.0)]))
    (folder / "notes.txt").write_text("not a tile")
    return folder


OFFSETS = """\\ offsets
| Tile | OffsetRA_TA | OffsetRA | OffsetDec | OffsetPMRA | OffsetPMDec |
 0001p000  0.1  0.001  -0.002  0.00010  -0.00020
 0002m015  0.2  null   0.5     1.5      2.5
"""


def test_tiles_are_read_typed(spark, tile_folder):
    frame = tiles.read_catalog_tiles(spark, str(tile_folder))
    assert frame.columns == [*COLUMNS, "tile"]
    assert [f.dataType.simpleString() for f in frame.schema.fields[:-1]] == list(schema.CATALOG_TYPES.values())
    rows = {r["source_id"]: r for r in frame.collect()}
    assert set(rows) == {"id1", "id2", "id3", "id4"}
    assert (rows["id1"]["ra"], rows["id1"]["w1mag"], rows["id1"]["w1flg"]) == (10.0, Decimal("1.25"), 1)
    assert rows["id2"]["w1mag"] is None and rows["id2"]["w1flg"] is None
    assert {r["tile"] for r in rows.values()} == {"0001p000", "0002m015", "0003p000"}


def test_headers_of_several_lines_in_any_order(spark, tile_folder):
    values = [str(v) for v in catalog_row(9, 1.0, 2.0)]
    kinds = "| " + " | ".join("char" for _ in COLUMNS) + " |"
    names = "|" + "|".join(f" {c.upper()} " for c in reversed(COLUMNS)) + "|"
    write_tile(tile_folder, "0009p000_x.tbl", "\n".join(["\\ c", kinds, names, kinds.replace("char", "null"), " ".join(reversed(values))]) + "\n")
    rows = {r["source_id"]: r for r in tiles.read_catalog_tiles(spark, str(tile_folder)).collect()}
    assert (rows["id9"]["ra"], rows["id9"]["dec"], rows["id9"]["tile"]) == (1.0, 2.0, "0009p000") and len(rows) == 5


def test_a_file_without_names_stops_the_read(spark, tile_folder):
    write_tile(tile_folder, "0008p000_x.tbl", "| dec | ra |\n 1 2\n")
    with pytest.raises(Exception, match="no names line in tile file"):
        tiles.read_catalog_tiles(spark, str(tile_folder)).collect()


def test_no_header(spark, tmp_path):
    (tmp_path / "0001_x.tbl").write_text("1 2 3\n")
    with pytest.raises(ValueError, match="no header"):
        tiles.read_tiles(spark, str(tmp_path))


def test_names_from_files(spark):
    row = spark.range(1).select(
        tiles.tile_of(F.lit("file:/a_b/0001p000_opt1.tbl.gz")).alias("tile"),
        tiles.renamed_file(F.lit("file:/a/0001p000_opt1.tbl.gz"), "csv").alias("name"),
    ).first()
    assert row[:] == ("0001p000", "0001p000_opt1.csv")


def test_ingest(spark, tile_folder, tmp_path):
    (tmp_path / "offsets.tbl").write_text(OFFSETS)
    csv, out = str(tmp_path / "offsets_csv"), str(tmp_path / "primary")
    ingest.prepare_offsets(spark, str(tmp_path / "offsets.tbl"), csv)
    offsets = tables.read_offsets_csv(spark, csv)
    assert offsets.columns == schema.OFFSET_COLUMNS and offsets.where("offsetra IS NULL").count() == 1
    ingest.write_primary(spark, str(tile_folder), csv, out)
    rows = {r["source_id"]: r for r in tables.attach_catalog(spark, out).collect()}
    assert set(rows) == {"id1", "id2", "id3"}
    first = rows["id1"]
    assert (first["ra_point"], first["dec_point"]) == (first["ra"], first["dec"]) == (10.0 + 0.001, 5.0 - 0.002)
    assert (first["pmra"], first["pmdec"]) == (Decimal("1.25010"), Decimal("1.24980"))
    assert first["tile"] == "0001p000"
    catalog = tiles.read_catalog_tiles(spark, str(tile_folder))
    assert calibrate.dropped_tiles(catalog, offsets).collect() == [("0003p000", 1)]
    assert (tile_folder / "0001p000_opt1.tbl.gz").exists()


def test_union_keeps_each_row_once(spark):
    frames = [spark.range(k, k + 3).select(F.col("id").cast("double").alias("ra"), F.lit(0.0).alias("dec")) for k in range(4)]
    united = calibrate.union_tiles(frames)
    assert united.columns == ["ra_point", "dec_point", "ra", "dec"] and united.count() == 12


def test_csv(spark, tmp_path):
    frame = spark.createDataFrame([(1.5, None, "a,b")], "x double, n int, s string")
    path = str(tmp_path / "t")
    tables.write_csv(frame, path)
    with pytest.raises(AnalysisException):
        tables.write_csv(frame, path)
    tables.write_text_csv(frame, path)
    assert tables.read_csv(spark, path).columns == ["_c0", "_c1", "_c2"]
    assert tables.read_csv(spark, path, {"x": "double", "n": "int", "s": "string"}).collect() == [(1.5, None, "a,b")]
    tables.write_small_csv(frame.repartition(3), path, files=1)
    assert len(list((tmp_path / "t").glob("part-*"))) == 1
    assert tables.read_csv(spark, path, header=True).columns == ["x", "n", "s"]


def test_point_sources(spark, tmp_path):
    rows = point_sources.points_from_rows(spark, [{"dec": 2.0, "ra": 1.0}, {"ra": 3.0, "dec": 4.0}])
    assert rows.collect() == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    (tmp_path / "head.csv").write_text("dec,ra\n2.0,1.0\n")
    (tmp_path / "plain.txt").write_text("1.0,2.0\n")
    (tmp_path / "wkt.csv").write_text("POINT (1.0 2.0),1.0,2.0,x\n")
    (tmp_path / "xy.csv").write_text("a,1.0,2.0,b\n")
    assert point_sources.read_points(spark, str(tmp_path / "head.csv"), header=True).collect() == [(1.0, 2.0)]
    assert point_sources.read_points(spark, str(tmp_path / "plain.txt")).collect() == [(1.0, 2.0)]
    assert point_sources.read_points_wkt(spark, str(tmp_path / "wkt.csv")).collect() == [(1.0, 2.0, "1.0", "2.0", "x")]
    assert point_sources.read_points_xy(spark, str(tmp_path / "xy.csv"), offset=1).collect() == [(1.0, 2.0, "a", "b")]


@pytest.fixture(scope="module")
def primary(spark):
    """Sources every 1.5 degrees around the equator band, in five rows."""
    rows = [catalog_row(n, (n % 240) * 1.5, (n // 240) * 2.0 - 4.0) for n in range(1200)]
    frame = spark.createDataFrame(rows, schema.string_struct(COLUMNS))
    return with_point_columns(schema.typed_catalog(frame))


@pytest.fixture(scope="module")
def few_points(spark):
    rows = [{"ra": 15.0 * k, "dec": 0.0} for k in range(4)]
    return with_lon_lat(point_sources.points_from_rows(spark, rows))


def test_plain_layout(primary):
    frame = layouts.plain_layout(primary.toDF(*[f"_c{n}" for n in range(22)]))
    assert frame.columns == [*COLUMNS, "lon", "lat"]
    assert frame.where("lon != ra - 180 OR lat != `dec`").count() == 0


def test_hybrid_layout_prunes_folders(spark, primary, few_points, tmp_path):
    path = str(tmp_path / "h")
    layouts.write_hybrid(layouts.hybrid_layout(primary.unionByName(primary)), path)
    catalog = tables.attach_catalog(spark, path)
    assert catalog.count() == 1200
    assert catalog.schema["cell_id"].metadata == {"s2_level": 9, "s2_parent": 4, "x": "lon", "y": "lat", "stored": True}
    matches = match.hybrid_match(catalog, few_points, 0.01)
    assert matches.count() == 4
    assert "BroadcastHashJoin" in plan_text(matches) and 1 <= scanned(matches)["numPartitions"] <= 16 < len(list((tmp_path / "h").glob("partition_id=*")))
    shuffled = match.cone_pairs(catalog, few_points, 0.01, strategy="shuffle", pair_target=1)
    assert shuffled.count() == 4


def test_cell_layout_filters_reach_the_scan(spark, primary, few_points, tmp_path):
    path = str(tmp_path / "c")
    layouts.write_cells(layouts.cell_layout(primary, 9), path, 4)
    catalog = tables.attach_catalog(spark, path, view="sky", storage=None)
    assert spark.table("sky").count() == 1200
    pairs = match.cone_pairs(catalog, few_points, 0.01)
    assert pairs.count() == 4
    scan = plan_text(pairs.select("source_id"))
    assert "GreaterThanOrEqual(lat" in scan and re.search(r"cell_id#\d+L >= -?\d", scan)
    assert scanned(pairs)["numOutputRows"] < 1200
    assert "w1mag" not in scan.split("ReadSchema")[-1]
    ranges = [
        spark.read.parquet(str(f)).agg(F.min("cell_id"), F.max("cell_id")).first()
        for f in (tmp_path / "c").glob("part-*")
    ]
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_one_key_may_fill_several_files(spark, tmp_path):
    frame = spark.range(5000).select("id", F.lit("same").alias("geohash"))
    tables.write_clustered(frame, str(tmp_path / "g"), "geohash", 4)
    files = list((tmp_path / "g").glob("part-*"))
    assert len(files) == 4
    read = spark.read.parquet(str(tmp_path / "g"))
    assert read.columns == ["id", "geohash"] and read.distinct().count() == 5000


def test_geohash_layout_and_storage(spark, primary, tmp_path):
    frame = layouts.geohash_layout(primary, fraction=0.5, seed=3)
    assert 450 < frame.count() < 750 and {"geom", "geohash"} <= set(frame.columns)
    layouts.write_geohash(frame, str(tmp_path / "g"))
    kept = tables.attach_catalog(spark, str(tmp_path / "g"), storage=StorageLevel.DISK_ONLY)
    assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    kept.unpersist()


def test_projected_layout(sky_points):
    frame = layouts.projected_layout(sky_points([(1, 180.0, 0.0), (2, 190.0, 85.06), (3, 190.0, 85.07)]))
    rows = {r["source_id"]: r for r in frame.collect()}
    assert set(rows) == {1, 2} and abs(rows[1]["x"]) < 1e-9 and abs(rows[1]["y"]) < 1e-6


def test_statistics(spark, sky_points):
    points = sky_points([(1, 10.0, 5.0), (2, 10.0, 5.0), (3, 20.0, 5.024)], "point_id")
    stats_row = stats.cover_expansion(points, 0.01, PlaneGrid(0.05)).first()
    assert stats_row["original_count"] == 3 and stats_row["relative_diff"] == stats_row["new_count"] / 3
    none = stats.cover_expansion(points.where("point_id > 9"), 0.01, PlaneGrid(0.05)).first()
    assert none[:] == (0, 0, None)
    assert stats.layer_extent(points).first()[:] == (-170.0, -160.0, 5.0, 5.024, 3)
    assert stats.geohash_density(points, 3).first()["count"] == 2
    assert stats.geometry_report(points, 60.0).count() == 2
    summary = {r["column"]: r for r in stats.describe_points(points, ["ra", "dec"]).collect()}
    assert summary["ra"]["count"] == 3 and summary["dec"]["max"] == 5.024
    assert stats.distinct_sources(points.select("lon", "lat")).count() == 2
    assert stats.distinct_sources(points, ["lon"]).count() == 2


def test_samples(spark):
    frame = spark.range(20_000)
    half = stats.hash_sample(frame, "id", 0.5)
    assert 9_700 < half.count() < 10_300
    assert half.repartition(7).exceptAll(half).count() == 0
    assert stats.hash_sample(frame, "id", 0.0).count() == 0 and stats.hash_sample(frame, "id", 1.0).count() == 20_000
    assert stats.sample_one(frame, "id").collect() == stats.sample_one(frame.repartition(5), "id").collect()
    assert stats.bernoulli_sample(frame, 0.5, 1).count() == stats.bernoulli_sample(frame, 0.5, 1).count()
    assert stats.respread(frame, 3).rdd.getNumPartitions() == 3 and stats.respread(frame).count() == 20_000
    with pytest.raises(ValueError):
        stats.hash_sample(frame, "id", 1.5)


def test_experiments(spark, sky_points):
    points = experiments.random_points(spark, 500, seed=2)
    assert points.count() == 500 and points.where("ra < 0 OR ra >= 1 OR abs(`dec`) > 90").count() == 0
    catalog = sky_points([(1, 10.0, 0.0), (2, 10.0, 0.0101), (3, 10.0, 0.001)])
    query = sky_points([(0, 10.0, 0.0)], "point_id")
    swept = {r["arcseconds"]: r["matches"] for r in experiments.radius_sweep(catalog, query).collect()}
    assert swept == {1.0: 1, 2.0: 1, 4.0: 2, 8.0: 2, 16.0: 2, 32.0: 2, 60.0: 3}
    sets = experiments.point_set_sweep(catalog, {"one": query, "two": query.unionByName(query)}, [60]).collect()
    assert {r["set_name"]: r["matches"] for r in sets} == {"one": 3, "two": 6}


def test_work_folder_is_in_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert work_folder(spark, "a") == work_folder(spark, "a") != work_folder(spark, "b")
    assert work_folder(spark, "a").startswith(named.rstrip("/"))


def test_projected_search_leaves_stored_cells_alone(spark, primary, few_points, tmp_path):
    layouts.write_cells(layouts.cell_layout(primary), str(tmp_path / "c"))
    layer = layouts.projected_layout(tables.attach_catalog(spark, str(tmp_path / "c")))
    points = layouts.projected_layout(few_points)
    assert match.cone_pairs(layer, points, 1500.0, x="x", y="y").count() == match.cone_pairs(layouts.plain_layout(primary).transform(layouts.projected_layout), points, 1500.0, x="x", y="y").count() > 0


@pytest.mark.parametrize("deepest", [None, 6])
def test_one_shuffle_of_the_sources_in_the_hybrid_layout(primary, deepest):
    text = plan_text(layouts.hybrid_layout(primary, deepest=deepest))
    physical = text[text.index("== Physical Plan ==") :]
    # The others are of counts per cell.
    assert physical.count("Exchange hashpartitioning(partition_id") == 1 and physical.count("w1mag") > 0
    assert all("w1mag" not in part.split("Exchange")[0] for part in physical.split("BroadcastExchange")[1:])


def scanned(df):
    """Folders, files and rows that the scan of a written catalog has read."""
    scans = [node for name, node in executed(df) if name == "FileSourceScanExec"]
    assert len(scans) == 1
    return {n: metric(scans[0], n) for n in ("numPartitions", "numFiles", "numOutputRows") if scans[0].metrics().contains(n)}


@pytest.fixture(scope="module")
def skewed(spark, primary):
    """The band, and a hundred times as many sources in one patch of it."""
    rng = random.Random(51)
    rows = [catalog_row(5000 + n, 30 + rng.uniform(0, 1.5), rng.uniform(0, 1.5)) for n in range(6000)]
    rows += [catalog_row(20_000 + n, 33.0, 0.5) for n in range(500)]
    frame = spark.createDataFrame(rows, schema.string_struct(COLUMNS))
    return primary.unionByName(with_point_columns(schema.typed_catalog(frame)))


def test_folders_follow_density(spark, skewed, tmp_path):
    target = 200
    sizes = {}
    for name, deepest in (("even", None), ("dense", 9)):
        layouts.write_hybrid(layouts.hybrid_layout(skewed, coarse=4, deepest=deepest, folder_rows=target), str(tmp_path / name))
        catalog = tables.attach_catalog(spark, str(tmp_path / name))
        assert catalog.count() == 7700
        sizes[name] = {r["partition_id"]: r["count"] for r in catalog.groupBy("partition_id").count().collect()}
    assert catalog.schema["cell_id"].metadata["s2_deepest"] == 9
    level = lambda cell: 30 - ((cell & -cell).bit_length() - 1) // 2
    levels = {level(c) for c in sizes["dense"]}
    assert min(levels) == 4 and max(levels) >= 7
    # A full folder can only be one of the deepest level; a parent of several would have been too full.
    assert all(n <= target or level(c) == 9 for c, n in sizes["dense"].items())
    assert max(sizes["even"].values()) > 2000 and sorted(sizes["dense"].values())[-2] <= target
    for mark, parent in {((c & -c) << 2, (c & -((c & -c) << 3)) | (c & -c) << 2) for c in sizes["dense"] if level(c) > 4}:
        assert sum(n for c, n in sizes["dense"].items() if abs(c - parent) < mark) > target
    # A folder is written by as many tasks as its count asks for.
    table = layouts.folder_table(layouts.cell_layout(skewed).select("cell_id"), 4, 9, target).select("partition_id", F.col("__pieces")).distinct().collect()
    assert {r[0]: r[1] for r in table} == {c: -(-n // target) for c, n in sizes["dense"].items()}


@pytest.mark.parametrize("metric_name", ["planar", "great_circle"])
def test_search_over_folders_of_several_levels(spark, skewed, tmp_path, metric_name):
    layouts.write_hybrid(layouts.hybrid_layout(skewed, coarse=3, deepest=8, folder_rows=200), str(tmp_path / "d"))
    catalog, plain = tables.attach_catalog(spark, str(tmp_path / "d")), layouts.plain_layout(skewed)
    rows = [(0, 30.5, 0.5, 0.05), (1, 33.0, 0.5, 0.0), (2, 0.2, 0.0, 2.0), (3, 100.0, 0.0, 12.0), (4, 31.0, 0.7, 40.0)]
    points = with_lon_lat(spark.createDataFrame(rows, "point_id int, ra double, dec double, r double"))
    for wanted, strategy in (([0], "auto"), ([1, 2], "shuffle"), ([3], "auto"), ([0, 1, 2, 3, 4], "auto")):
        some = points.where(F.col("point_id").isin(wanted))
        got = match.cone_pairs(catalog, some, "r", metric=metric_name, strategy=strategy).select("source_id", "query_point_id")
        want = match.cone_pairs(plain, some, "r", metric=metric_name).select("source_id", "query_point_id")
        assert sorted(got.collect()) == sorted(want.collect())
    folders = len(list((tmp_path / "d").glob("partition_id=*")))
    assert scanned(match.cone_pairs(catalog, points.where("point_id = 0"), 0.05, metric=metric_name))["numPartitions"] <= 6 < folders / 5


def test_row_groups_of_far_fields_are_passed_over(spark, tmp_path):
    """Two fields far apart, also across 0/360, and many points: what lies between is not read."""
    rng = random.Random(52)
    rows = [catalog_row(n, rng.uniform(0, 360), rng.uniform(-5, 5)) for n in range(8_000)]
    frame = with_point_columns(schema.typed_catalog(spark.createDataFrame(rows, schema.string_struct(COLUMNS))))
    layouts.write_cells(layouts.cell_layout(frame, 9), str(tmp_path / "c"), 16)
    catalog, plain = tables.attach_catalog(spark, str(tmp_path / "c")), layouts.plain_layout(frame)
    fields = {"far": (20.0, 200.0), "around": (359.5, 90.0)}
    for name, middles in fields.items():
        spots = [(n, (middles[n % 2] + rng.uniform(0, 1.0)) % 360, rng.uniform(-0.5, 0.5)) for n in range(300)]
        points = with_lon_lat(spark.createDataFrame(spots, "point_id int, ra double, dec double"))
        for metric_name in ("planar", "great_circle"):
            pairs = match.cone_pairs(catalog, points, 0.1, metric=metric_name).select("source_id", "query_point_id")
            assert sorted(pairs.collect()) == sorted(match.cone_pairs(plain, points, 0.1, metric=metric_name).select("source_id", "query_point_id").collect())
            assert scanned(pairs)["numOutputRows"] < 8_000 / 2.5, name


def test_ranges_of_cells():
    face = lambda n: (2 * n + 1) << 60
    four = [(face(0) & -(1 << 61)) + (2 * k + 1) * (1 << 58) for k in range(4)]
    whole = [(face(0) - ((1 << 60) - 1), face(0) + ((1 << 60) - 1))]
    assert united(four) == whole == united([face(0)]) == united([face(0), four[2]])
    assert united([]) == [] and len(united(four[::2])) == 2
    apart = [2 * k * 1000 + 1 for k in range(10)] + [2_000_001]
    assert len(united(apart, 3)) == 3 and united(apart, 1) == [(1, 2_000_001)]
    assert united(apart, 2) == [(1, 18_001), (2_000_001, 2_000_001)]


def test_coverings_of_several_levels(spark):
    rng = random.Random(53)
    rows = [(k, rng.uniform(0, 360), rng.choice([rng.uniform(-90, 90), 90.0, -90.0, 45.0, 35.26]), 10 ** rng.uniform(-4, 1.7)) for k in range(80)]
    rows += [(200, 10.0, 10.0, 95.0), (201, 45.0, 35.26, 0.0)]
    circles = with_lon_lat(spark.createDataFrame(rows, "id int, ra double, dec double, r double"))
    cells = {}
    for r in explode_s2_covering(circles, F.col("r"), 9, "cell").collect():
        cells.setdefault(r["id"], []).append(r["cell"])
    assert set(cells) == {r[0] for r in rows} and max(map(len, cells.values())) <= covering_bound()
    reach = lambda c: (c - ((c & -c) - 1), c + ((c & -c) - 1))
    for own in cells.values():
        spans = sorted(map(reach, own))
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    for r in explode_s2_cover(circles.where("r < 2"), F.col("r"), 9, "cell").collect():
        assert any(low <= r["cell"] <= high for low, high in map(reach, cells[r["id"]]))
    # As an index of a search.
    sources = with_lon_lat(spark.createDataFrame([(k, rng.uniform(0, 30), rng.uniform(-10, 10)) for k in range(600)], "source_id int, ra double, dec double"))
    points = with_lon_lat(spark.createDataFrame([(k, rng.uniform(0, 30), rng.uniform(-10, 10)) for k in range(40)], "point_id int, ra double, dec double"))
    index = S2Covering.for_radii(2.0, 2.0, 9)
    for metric_name in ("planar", "great_circle"):
        assert pair_ids(match.cone_pairs(sources, points, 2.0, metric=metric_name, index=index)) == pair_ids(match.cone_pairs(sources, points, 2.0, metric=metric_name))


def test_ragged_rows(spark, tile_folder, tmp_path):
    folder = tmp_path / "ragged"
    folder.mkdir()
    (folder / "0001p000_a.tbl").write_text("\\ made\n| a | b | c |\n1 2 3\n4 6\n\n7 8 9 10\n11 x null\n  12 13 14  \n")
    (folder / "0002p000_a.tbl").write_text("| a | b |\n1 2\n")
    (folder / "0003p000_rej.tbl").write_text("| a | b | c |\n1\n")
    types = {"a": "int", "b": "int", "c": "double"}
    rows = tiles.rejected_rows(spark, str(folder), types)
    got = sorted((r["file_path"].rsplit("/", 1)[1][:8], r["line"], r["reason"], r["value"]) for r in rows.collect())
    assert got == [
        ("0001p000", 4, "too few fields", "4 6"), ("0001p000", 6, "too many fields", "7 8 9 10"), ("0001p000", 7, "b does not parse", "11 x null"),
        ("0002p000", 2, "no names line", "1 2"),
    ]
    one = str(folder / "0001p000_a.tbl")
    with pytest.raises(Exception, match="too few or too many fields"):
        tiles.read_tiles(spark, one).collect()
    assert sorted(tuple(r) for r in tiles.read_tiles(spark, one, ragged="reject").collect()) == [("1", "2", "3", "0001p000"), ("11", "x", "null", "0001p000"), ("12", "13", "14", "0001p000")]
    with pytest.raises(ValueError, match="ragged"):
        tiles.read_tiles(spark, one, ragged="guess")
    # Lines are counted right when several tasks read parts of one file.
    lines = ["| a | b | c |"] + [f"{n} {n} {n}" if n % 1000 else f"{n} {n}" for n in range(1, 20_000)]
    (tmp_path / "0009p000_long.tbl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        long = tiles.rejected_rows(spark, str(tmp_path / "0009p000_long.tbl"), types)
        assert long.select(F.spark_partition_id()).distinct().count() >= 1 and sorted(r["line"] for r in long.collect()) == [1000 * k + 1 for k in range(1, 20)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_batches_of_tiles(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = lambda ids, add=0: spark.createDataFrame([(n, f"{n % 7:03d}", n + add) for n in ids], "id int, tile string, v int")
    read = lambda: sorted((r["id"], r["tile"], r["v"]) for r in tables.read_tile_folders(spark, path).collect())
    first, second = rows(n for n in range(100) if n % 7 < 4), rows(n for n in range(100) if n % 7 >= 4)
    for batch in (first, second, second, first):
        tables.add_tiles(batch, path)
    assert read() == [(n, f"{n % 7:03d}", n) for n in range(100)]
    manifest = {r["tile"]: r["sources"] for r in tables.tile_manifest(spark, path).collect()}
    assert manifest == {f"{t:03d}": len(range(t, 100, 7)) for t in range(7)} and tables.unfinished_tiles(spark, path).count() == 0
    # A batch that broke off between its rows and its line in the manifest.
    spark.createDataFrame([(5, 1)], "id int, v int").write.mode("append").parquet(f"{path}/tile=005")
    spark.createDataFrame([(9, 1)], "id int, v int").write.parquet(f"{path}/tile=009")
    assert sorted(r["tile"] for r in tables.unfinished_tiles(spark, path).collect()) == ["005", "009"]
    tables.add_tiles(second, path)
    assert [r["tile"] for r in tables.unfinished_tiles(spark, path).collect()] == ["009"]
    with pytest.raises(ValueError, match="without a tile"):
        tables.add_tiles(rows([1]).withColumn("tile", F.lit(None).cast("string")), path)
    # In batches of three, going on where a run broke off.
    again = str(tmp_path / "c")
    every = rows(range(100))
    assert tables.write_in_batches(every.where("tile < '002'"), again, 3) == [["000", "001"]]
    assert tables.write_in_batches(every, again, 3) == [["002", "003", "004"], ["005", "006"]]
    assert tables.write_in_batches(every, again, 3) == [] and tables.read_tile_folders(spark, again).count() == 100
    assert len(tables.write_in_batches(rows(range(50), 5), again, 50, again=True)) == 1
    assert tables.read_tile_folders(spark, again).agg(F.sum("v")).first()[0] == sum(range(50)) + 250


def test_offsets_are_one_per_tile(spark):
    kinds = "tile string, offsetra_ta double, offsetra double, offsetdec double, offsetpmra decimal(15,5), offsetpmdec decimal(15,5)"
    catalog = schema.typed_catalog(spark.createDataFrame([(*catalog_row(n, 10.0 + n, 1.0), "ab"[n % 2]) for n in range(6)], schema.string_struct([*COLUMNS, "tile"])), keep=["tile"])
    once = [("a", 0.0, 0.5, 0.0, None, None), ("b", 0.0, 0.25, 0.0, None, None)]
    table = lambda rows: spark.createDataFrame(rows, kinds)
    ra = lambda rows, **o: sorted(r["ra"] for r in calibrate.apply_offsets(catalog, table(rows), **o).collect())
    want = ra(once)
    assert len(want) == 6 and ra(once + once) == want
    doubled = [*once, ("a", 0.0, 9.0, 0.0, None, None)]
    with pytest.raises(Exception, match="different rows for one tile: a"):
        ra(doubled)
    assert ra(doubled, repeated="least") == want
    with pytest.raises(ValueError, match="unknown rule"):
        ra(once, repeated="any")


def test_types_and_names(spark):
    frame = spark.createDataFrame([("1.5", "null")], "a string, b string")
    assert schema.typed(frame, {"a": "double", "b": "int"}).collect() == [(1.5, None)]
    assert schema.named_by_position(frame, ["x", "y"]).columns == ["x", "y"]
    assert len(schema.struct_of(schema.CATALOG_TYPES)) == 20
    assert schema.without_point_columns(frame.withColumn("ra_point", F.lit(1))).columns == ["a", "b"]
    assert pair_ids(spark.createDataFrame([(1, 2)], "source_id int, query_point_id int")) == [(1, 2)]


def test_tasks_of_the_hybrid_layout_hold_few_rows(skewed, monkeypatch):
    monkeypatch.setattr(layouts, "TASK_ROWS", 200)
    held = layouts.hybrid_layout(skewed).groupBy(F.spark_partition_id()).count()
    assert held.agg(F.max("count"), F.sum("count")).first()[1] == 7700 and held.agg(F.max("count")).first()[0] < 1500


def test_packed_csv_reads_back(spark, tmp_path):
    tables.write_csv(spark.range(5), str(tmp_path / "packed"), header=True, compression="gzip")
    assert list((tmp_path / "packed").glob("*.csv.gz"))
    assert sorted(r[0] for r in tables.read_csv(spark, str(tmp_path / "packed"), {"id": "bigint"}, header=True).collect()) == [0, 1, 2, 3, 4]


def test_a_line_of_a_tile_is_judged_once(spark, tmp_path):
    (tmp_path / "0001_a.tbl").write_text("| dec | ra |\n 1 2\n x 2\n 1\n null y\n")
    found = tiles.rejected_rows(spark, str(tmp_path), {"ra": "double", "dec": "double"})
    assert sorted((r["line"], r["reason"]) for r in found.collect()) == [(3, "dec does not parse"), (4, "too few fields"), (5, "ra does not parse")]
    physical = plan_text(found).split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert physical.count("dec does not parse") == 1


def test_full_folders_are_few_files(spark, skewed, tmp_path):
    """A folder of the deepest level that holds far more than ``folder_rows`` is one task's file, not one for each such number."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layouts.write_hybrid(layouts.hybrid_layout(skewed, coarse=2, deepest=4, folder_rows=50), str(tmp_path / "few"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folders = list((tmp_path / "few").glob("partition_id=*"))
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in folders) and len(folders) > 2


def test_many_circles_are_merged_before_they_are_covered(spark, monkeypatch):
    """Ranges hold every cell that a circle touches, and what lies between two fields stays out of them."""
    monkeypatch.setattr(ranges, "MERGED", 16)
    rng = random.Random(91)
    rows = [(x + rng.uniform(0, 3), y + rng.uniform(0, 3), rng.choice([0.0, 0.3])) for x, y in ((-179.9, -2.0), (20.0, 60.0)) for _ in range(60)]
    circles = spark.createDataFrame(rows, "lon double, lat double, r double")
    merged, reach = ranges.merged_circles(circles, F.col("r"), "lon", "lat")
    about = [(m["lon"], m["lat"], m["reach"]) for m in merged.select("lon", "lat", reach.alias("reach")).collect()]
    assert len(about) < 40 and all(any(math.hypot(x - a, y - b) + r <= to + 1e-9 for a, b, to in about) for x, y, r in rows)
    got = ranges.touched_ranges(circles, F.col("r"), 9, "lon", "lat", len(rows))
    cells = [c["cell_id"] for c in explode_s2_covering(circles, F.col("r"), 9, "cell_id", "lon", "lat").collect()]
    assert cells and all(any(low <= c <= high for low, high in got) for c in cells)
    far = with_s2_cell(spark.createDataFrame([(100.0, -40.0), (-60.0, 0.0)], "lon double, lat double"), 9, "cell_id").collect()
    assert not any(low <= c["cell_id"] <= high for c in far for low, high in got)
