import pytest

from lodestar.operators import pivots
from tests.fixtures import brute_diameter, brute_pivots, frame, hot_spot, ring, scattered

SETS = [scattered(300, seed, grid) for seed, grid in ((1, None), (2, 9), (3, 60), (4, None))]
SETS += [ring(150), ring(150)[::-1], hot_spot(240, 5), sorted(scattered(300, 6)), [(i, 0) for i in range(90)]]


@pytest.mark.parametrize("number", range(len(SETS)))
@pytest.mark.parametrize("grid", [2, 32])
def test_choice_is_that_of_the_sequential_pass(spark, monkeypatch, number, grid):
    monkeypatch.setattr(pivots, "GRID", grid)
    places = SETS[number]
    found = pivots.sss_pivots(frame(spark, places), brute_diameter(places))
    assert [p.uid for p in found] == brute_pivots(places)
    assert [p.pivot_id for p in found] == [f"pivot_{i}" for i in range(len(found))]


def test_few_scans(spark, monkeypatch):
    scans = []
    original = pivots._first_per_cell
    monkeypatch.setattr(pivots, "_first_per_cell", lambda *args: scans.append(1) or original(*args))
    places = scattered(2000, 8, 1000)
    found = pivots.sss_pivots(frame(spark, places), brute_diameter(places[:400]) * 0.98)
    assert len(scans) < len(found)
