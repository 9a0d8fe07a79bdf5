"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.common import remove, scratch


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches. Nodes without a link are not in it.

    Large stars hang each node's larger neighbours below the smallest one around it, small
    stars do so with the smaller ones; when nothing changes, every node hangs below the
    smallest of its component. Each round is a table in the shared folder, which goes when the next one is there.
    """
    spark, state = links.sparkSession, None

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "links")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    up, path = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old = path
        up, path = kept(small)
        remove(spark, old)
        now = up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return up.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(up.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
