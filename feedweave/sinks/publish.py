"""Publishing change events: topic, key, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.operators.outbox import PUBLISH_ORDER, TOPIC_PREFIX


def publish_sink(outbox: DataFrame, prefix: str = TOPIC_PREFIX) -> DataFrame:
    """Outbox rows as messages: one topic per feed, keyed by business key, so a key keeps its order."""
    return outbox.select(
        F.concat_ws(".", F.lit(prefix), F.col("feed")).alias("topic"),
        F.col("business_key").alias("key"),
        F.col("payload").alias("value"),
    )


def write_messages(outbox: DataFrame, path: str, prefix: str = TOPIC_PREFIX) -> None:
    """File form of the publish: one folder per topic. A broker takes the same columns through format("kafka").

    Rows are range-partitioned in publish order, so a key with very many events is spread over files whose order is
    the publish order.
    """
    ordered = outbox.repartitionByRange("feed", "business_key", *PUBLISH_ORDER[:2]).sortWithinPartitions(
        "feed", "business_key", *PUBLISH_ORDER[:2]
    )
    publish_sink(ordered, prefix).write.mode("append").partitionBy("topic").json(path)
