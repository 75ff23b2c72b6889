"""Connected components of an edge table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: those above it; small: itself and those below) are joined to its least neighbour.

    The least neighbour comes from an aggregation with partial sums and is joined back, so a hub's edges
    are split over tasks like any skewed join."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # large: a's neighbours on either side; small: a is the larger end
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a != b").distinct()


#: Edges that a written file has at least, where the count is known.
FILE_EDGES = 200_000


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, least (the least node of its component), for each node that edges (a, b) name.

    Rounds are written, so a lost executor costs no more than a round; a round's files follow the number of edges left."""
    now = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    state, files = None, None
    for _ in range(most_rounds):
        after = _star(_star(now, True), False)
        now = written(after.coalesce(files) if files else after, "edges")
        # a change of the edge set moves its order-free sum
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, files = seen, 1 + seen[0] // FILE_EDGES
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(roots)
