"""Connected components of a table of links, by contraction to stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60, part_rows: int = 200_000) -> DataFrame:
    """(vertex, root) for every vertex of ``links`` (a, b: long); root is the least vertex of its component.

    Each round keeps at most as many links as it got, and is written to the shared folder, so a
    lost executor costs one round.  Vertices, not links, meet in a task: a vertex with very many
    links is summed before the shuffle and its join can be split.  No links: no rows.
    """
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    before = (now.count(), None)
    for _ in range(most_rounds):
        # Few links need few partitions; where one holds them all, a round has no shuffle.
        now = now.coalesce(1 + before[0] // part_rows)
        now = written(_small_star(_large_star(now).distinct()).distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        before = state
    raise RuntimeError("components did not settle")
