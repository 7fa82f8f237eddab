"""Connected components of an edge table."""

from pyspark.sql import functions as F

from lurewatch.session import materialise


def _fingerprint(edges):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _nearest(edges):
    """The smallest neighbour of each vertex, as a written table, so a join with it can split a hot vertex."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "nearest")


def connected_components(edges):
    """(vertex, root) for every vertex of ``edges`` (u, v: bigint); root is the smallest vertex it can reach.

    Alternates two rewirings until nothing changes: every vertex hands its larger neighbours to its smallest
    neighbour, then hands itself and its smaller neighbours to the smallest. The table never grows beyond
    its edges and a few rounds suffice, about the logarithm of the longest path. Minima are pre-aggregated,
    and their join with the edges is between two written tables, so a vertex with very many neighbours can
    be split. Each round ends in the shared folder. Null ends and loops are ignored; no edges, no rows.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialise(both.filter("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        every = materialise(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
        large = (
            every.join(_nearest(every), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = materialise(large, "edges")
        small = large.join(_nearest(large), "u")
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(own)
        now = materialise(small.distinct(), "edges")
        last, seen = seen, _fingerprint(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("root"))
    ).distinct()
