"""What the plans must look like to hold at scale."""

import contextlib
import io

import pytest

from lodestar import build_index
from lodestar.functions.geometry import Location, inside_window, same_place
from lodestar.operators import lookup, ordering, pivots, search
from lodestar.session import scratch_path
from lodestar.sources import cells
from tests.fixtures import frame, scattered

Q = Location(1.0, 2.0)


@pytest.fixture(scope="module")
def index(spark):
    return build_index(frame(spark, scattered(500, 41)), scratch_path(spark, "physical"))


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def pushed(text: str) -> str:
    return next(line for line in text.splitlines() if "PushedFilters" in line)


def test_range_query_prunes_at_the_scan_without_a_shuffle(index):
    text = plan(index.range_query(Q, 3.0, pivot_bounds=True, ordered=False))
    for name in ("x", "y", *(f"dp_{p.ord}" for p in index.pivots)):
        assert f"GreaterThanOrEqual({name}" in text and f"LessThanOrEqual({name}" in text
    assert "Exchange" not in text and "quadrant" not in text and "closest_pivot" not in text


def test_pivot_distances_are_one_narrow_stage(index):
    for df in (
        pivots.pivot_distances(index.points, index.pivots),
        pivots.closest_pivot(index.points, index.pivots),
        pivots.pivot_distances_wide(index.points.select("uid", "x", "y"), index.pivots),
        index.initial_ranges(5),
        search.flagged(index.points, index.pivots, Q, 3.0, "q"),
    ):
        text = plan(df)
        assert not any(word in text for word in ("Exchange", "Join", "Python"))


def test_certain_hits_and_windows_are_pushed_down(index):
    assert "LessThanOrEqual(dp_closest" in pushed(plan(index.certain_hits(Q, 900.0)))
    assert "GreaterThan(x" in pushed(plan(index.points.filter(inside_window(Q))))
    assert "EqualTo(x" in pushed(plan(index.points.filter(same_place(Q))))


def test_lookups_are_pushed_down(spark, tmp_path):
    rows = [("a", "F", "q", 1, "v")]
    cells.write_cells(spark.createDataFrame(rows, cells.CELL_SCHEMA), str(tmp_path / "c"))
    table = cells.open_cells(spark, str(tmp_path / "c"))
    assert "EqualTo(row,a)" in pushed(plan(lookup.lookup_row(table, "a", "F", "q")))
    assert "StringStartsWith(row,a)" in pushed(plan(lookup.lookup_prefix(table, "a", "F", "q")))
    assert "StringContains(row,a)" in pushed(plan(lookup.grep_key(table, "a")))
    assert "GreaterThanOrEqual(row,a)" in pushed(plan(lookup.lookup_key_range(table, ("a", "F", "q"), ("b", "F", "q"))))


def test_no_cartesian_products(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    for name in ("pivot_distances", "closest_pivot", "diameter", "term_intersect", "upsert_points", "initial_range"):
        text = plan(__spark_entry__.queries()[name](spark, folder))
        assert "Cartesian" not in text and "NestedLoop" not in text, name


def test_first_rows_are_cut_before_anything_moves(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MERGE_ROWS", 0)
    written = []
    points = frame(spark, scattered(3000, 5), 8)
    original = ordering.ranked
    ordering.ranked = lambda df, order, name: written.append(df.count()) or original(df, order, name)
    try:
        assert ordering.first_rows(points, 20, ["x", "uid"]).count() == 20
    finally:
        ordering.ranked = original
    assert 20 <= written[0] <= 8 * 20
