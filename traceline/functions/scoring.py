"""Distances and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angular_distance(cos_sim: Column) -> Column:
    """Euclidean distance of the unit vectors, 0 to 2."""
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 * (1.0 - cos_sim)))


def score(distance: Column) -> Column:
    """The score reported for a distance: its cosine."""
    return F.cos(distance)
