import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from almagest.functions.coords import with_lon_lat  # noqa: E402
from almagest.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "almagest-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sky_points(spark):
    """Frame of ``(id, ra, dec)`` rows with their plane position."""

    def make(rows, name="source_id"):
        frame = spark.createDataFrame([(int(i), float(a), float(d)) for i, a, d in rows], f"{name} bigint, ra double, dec double")
        return with_lon_lat(frame)

    return make


def pair_ids(pairs):
    return sorted((r["source_id"], r["query_point_id"]) for r in pairs.collect())


def plane_pairs(sources, points, radius):
    return sorted(
        (i, j)
        for i, a, d in sources
        for j, b, e in points
        if ((a - 180) - (b - 180)) ** 2 + (d - e) ** 2 <= radius * radius
    )


def sphere_distance(a, d, b, e):
    a, d, b, e = map(math.radians, (a, d, b, e))
    h = math.sin((d - e) / 2) ** 2 + math.cos(d) * math.cos(e) * math.sin((a - b) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


def plan_text(df):
    """Physical plan as Spark prints it."""
    return df._jdf.queryExecution().toString()


def executed(df):
    """Nodes of the plan that ran, as (class name, node)."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        below = node.children()
        return [(name, node)] + [n for k in range(below.size()) for n in walk(below.apply(k))]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def metric(node, name):
    return node.metrics().apply(name).value()
