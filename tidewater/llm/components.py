"""Connected components of links that lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(v, c: the least vertex reachable) for each end of ``links`` (a, b).

    Each round a vertex takes the least label among its neighbours' and its own, then the label of that label.
    Rounds end when no label changes; a hub's links combine before they are dealt out.
    """
    both = links.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "components-labels")
    while True:
        heard = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        near = labels.withColumnRenamed("c", "old").join(heard, "v").select("v", "old", F.least("old", "m").alias("c"))
        far = labels.select(F.col("v").alias("c"), F.col("c").alias("next"))
        after = written(near.join(far, "c").select("v", "old", F.least("c", "next").alias("c")), "components-labels")
        changed = after.where("c <> old").limit(1).count()
        labels = after.select("v", "c")
        if not changed:
            return labels
