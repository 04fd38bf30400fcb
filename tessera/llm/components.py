"""Connected components as Spark jobs: lowest label of the neighbours, then of the label's own label, until none falls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pin


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link, labelled with the least node of its component.

    A node with very many links is met by map-side minima and by joins that Spark splits where they are skewed.
    """
    both = pin(links.select(F.col(a).alias("x"), F.col(b).alias("y"))
               .unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "links")
    labels = pin(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("x") == F.col("node")).groupBy(F.col("y").alias("node")).agg(
            F.min("label").alias("heard"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = pin(labels.join(heard, "node").join(own, "label").select(
            "node", F.least("label", "heard", "further").alias("label"),
            (F.least("heard", "further") < F.col("label")).alias("fell")), "labels")
        labels = new.select("node", "label")
        if not new.where("fell").head(1):
            return labels
