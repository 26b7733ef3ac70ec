"""Similarity search over planar points with a sparse landmark index, on Spark."""

from lodestar.plans.index import LandmarkIndex, build_index, load_index
from lodestar.plans.upkeep import clean_index, update_index

__all__ = ["LandmarkIndex", "build_index", "clean_index", "load_index", "update_index"]
