"""Connected components of a table of links, by rounds of joins.

Every node starts with its own name. In a round it takes the least name among its
own and its neighbours', then the name that this name has itself (pointer jumping),
so long chains close in a few rounds. A round's names are written to the shared
checkpoint folder: lineage stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (least node that can be reached) of every node in ``links``."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "enlaces")
    names = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "nombres")
    while True:
        seen = both.join(names.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other")
        near = seen.groupBy("node").agg(F.min("theirs").alias("theirs"))
        taken = names.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        own = names.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(taken.join(own, "component").select("node", "was", F.least("component", "further").alias("component")), "nombres")
        names = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return names
