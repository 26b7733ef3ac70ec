"""Hull, diameter and pivots of three datasets, against values computed beforehand with other means."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators import hull, pivots
from lodestar.plans.registry import as_points

ROOT = "/root/testdata"

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def orders_points(orders):
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    return orders.select(F.col("o_orderkey").alias("uid"), (F.col("o_totalprice") / 1000).alias("x"), day.alias("y"))


def customer_points(customer):
    return customer.select(
        F.col("c_custkey").alias("uid"),
        F.col("c_nationkey").cast("double").alias("x"),
        (F.col("c_acctbal") / 100).alias("y"),
    )


LOADERS = {"events": as_points, "orders": orders_points, "customer": customer_points}


@pytest.mark.parametrize(
    "table, sf, vertices, diameter, chosen",
    [
        ("events", "0.001", 10, 327.5061068132929, [0, 2, 288]),
        ("events", "0.01", 15, 506.23931504773503, [0, 9, 110]),
        ("events", "0.1", 20, 1524.1338991046687, [0, 1, 11505]),
        ("orders", "0.001", 16, 2434.904153, [0, 2]),
        ("orders", "0.01", 25, 2448.686791, [0, 8, 24]),
        ("orders", "0.1", 26, 2454.306814, [0, 2, 3]),
        ("customer", "0.001", 10, 108.170943, [0, 2]),
        ("customer", "0.01", 9, 111.884953, [0, 4]),
        ("customer", "0.1", 14, 112.250111, [0, 6, 12]),
    ],
)
def test_known_values(spark, table, sf, vertices, diameter, chosen):
    points = LOADERS[table](spark.read.parquet(f"{ROOT}/sf{sf}/{table}.parquet"))
    found = hull.extremes(points)
    edges = hull.convex_hull(points, found)
    widest = hull.hull_diameter(edges).first()["diameter"]
    assert edges.count() == vertices
    assert round(widest, 6) == round(diameter, 6)
    assert [p.uid for p in pivots.sss_pivots(points, widest, found=found)] == chosen
