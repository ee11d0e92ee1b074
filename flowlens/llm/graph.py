"""Connected components of a table of links.

Rounds of star contraction: every node goes to the neighbour (or itself) that
a hash puts first, and links are renamed to these stars, until at most
``links`` links are left.  A star takes in all that points at it, so a round
leaves a fraction of the nodes whatever the shape of the graph; hashing keeps
long chains of rising ids from shrinking one by one.  The rest, of that
measured size, is joined by one task, and the stars are followed back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import stored

#: Links that one task joins (two 64-bit ids each).
LINKS = 200_000


def _roots(frames):
    """The smallest node of each component, by union of its links."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root
    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        yield pd.DataFrame({"id": list(parent), "root": [find(x) for x in parent]})


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """``id, component`` (smallest id) of all ends of ``links(a, b)``; ends are
    longs.  ``most``: links that one task joins, ``LINKS`` by default."""
    most = LINKS if most is None else most
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    stars = []
    while edges.count() > most:
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b", F.lit(len(stars))).alias("h"), F.col("b"))
        own = F.struct(F.xxhash64("a", F.lit(len(stars))).alias("h"), F.col("a").alias("b"))
        star = stored(ends.groupBy("a").agg(F.min(F.least(order, own)).alias("s"))
                      .select(F.col("a").alias("id"), F.col("s.b").alias("star")), "stars")
        stars.append(star)
        renamed = edges.join(star.toDF("a", "x"), "a").join(star.toDF("b", "y"), "b").where("x <> y")
        edges = stored(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    found = edges.coalesce(1).mapInPandas(_roots, "id long, root long")
    if not stars:
        return stored(found.withColumnRenamed("root", "component"), "labels")
    for star in reversed(stars):
        found = stored(star.join(found.toDF("star", "root"), "star", "left")
                       .select("id", F.coalesce("root", "star").alias("root")), "roots")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return stored(found.join(least, "root").select("id", "component"), "labels")
