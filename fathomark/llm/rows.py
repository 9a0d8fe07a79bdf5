"""An integer key for each row, in the order of its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.common import written

KEY = "_row_key"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with KEY (long): doc_id itself where ids are there and tell texts apart.

    Otherwise the rows get new keys in the order of id and text, null ids first, and rows
    alike in both share a key: they are one document.
    """
    seen = docs.groupBy(F.col(f"`{doc_id}`").alias("d")).agg(F.min(F.xxhash64(f"`{text}`")).alias("a"), F.max(F.xxhash64(f"`{text}`")).alias("b"))
    if seen.where("d is null or a <> b").isEmpty():
        return docs.withColumn(KEY, F.col(f"`{doc_id}`").cast("long"))
    distinct = docs.select(F.col(f"`{doc_id}`").alias("_d"), F.col(f"`{text}`").alias("_t")).distinct()
    numbered = distinct.repartitionByRange("_d", "_t").sortWithinPartitions("_d", "_t").withColumn(KEY, F.monotonically_increasing_id())
    numbered = written(numbered, "keys")
    return docs.join(numbered, F.col(f"`{doc_id}`").eqNullSafe(F.col("_d")) & F.col(f"`{text}`").eqNullSafe(F.col("_t"))).drop("_d", "_t")
