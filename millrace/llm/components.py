"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (id, label), the label being the smallest id of the
    component. Every round is a few shuffles over the links; nothing is
    collected but the number of changed labels."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        hooked = stored(labels.join(near, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        up = hooked.select(F.col("id").alias("u"), F.col("label").alias("above"))
        jumped = stored(hooked.join(up, F.col("label") == F.col("u"), "left").select("id", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        labels = jumped.select("id", "label")
        if not jumped.filter("label <> old").limit(1).count():
            return labels
