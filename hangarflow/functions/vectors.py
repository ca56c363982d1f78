"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_to_score(squared_distance: Column) -> Column:
    """Similarity in (0, 1] from a squared L2 distance."""
    return 1.0 / (1.0 + squared_distance)


def squared_l2(left: Column, right: Column) -> Column:
    """Squared L2 distance of two float arrays, summed in double."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double")),
        F.lit(0.0),
        lambda acc, d: acc + d * d,
    )


def embedding_or_zero(embedding: Column, dimension: int) -> Column:
    """The embedding, or a zero vector where it is missing."""
    return F.coalesce(embedding, F.array_repeat(F.lit(0.0).cast("float"), dimension))
