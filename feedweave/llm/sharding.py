"""Sharding by bytes: contiguous shards of nearly equal size.

Rows are put in one global order (by the MD5 of the text, then doc_id), equal texts next to each other, and global byte-size prefix sums are taken from
per-partition totals. The byte axis is cut at equal targets; a document belongs to the shard in which its bytes begin.
Equal texts stay in one shard as long as together they are small against a shard (`tight` of the target); larger
groups are cut like everything else. A shard differs from its target by a document and a small group at most.

A null text is empty: size 1. Repeated rows and null doc_ids are rows like any other. Fewer documents than shards leave
shards empty. A column of the input that has the name of a result column is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column
from feedweave.llm.prefix import placed, totals

SHARDS = 16
LAW = "bytes"
TIGHT = 0.01
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_by_bytes(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    doc_id: str = "doc_id",
    tight: float = TIGHT,
    carry: list[str] | None = None,
) -> DataFrame:
    """The documents with size, text_crc32, law, shard (from 0) and slot (gapless from 0 in each shard).

    `carry` names the columns to hand on, all by default; texts that nobody needs are not moved.
    """
    aside = Aside(carried(docs, *RESULTS) if carry is None else carry)
    body = F.coalesce(column(text), F.lit(""))
    rows = placed(
        docs.select(
            *aside.out(),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("_text_hash"),
            F.coalesce(column(doc_id).cast("bigint"), F.lit((1 << 63) - 1)).alias("_doc"),
        ),
        "_text_hash",
        "_doc",
    )
    target = (rows.agg(F.sum("size")).first()[0] or 1) / shards
    slim = totals(rows.select("_part", "_slot", "_text_hash", "size"), [], _start=F.col("size"), _row=F.lit(1))
    small_groups = (
        slim.groupBy("_text_hash")
        .agg(F.count(F.lit(1)).alias("_copies"), F.sum("size").alias("_group_size"), F.min("_start").alias("_group_start"))
        .where((F.col("_copies") > 1) & (F.col("_group_size") <= target * tight))
        .select("_text_hash", "_group_start")
    )
    start = F.coalesce("_group_start", "_start")
    cut = slim.join(small_groups, "_text_hash", "left").select(
        "_part", "_slot", "_row", F.least(F.floor(start / target), F.lit(shards - 1)).cast("int").alias("shard")
    )
    firsts = F.broadcast(cut.groupBy("shard").agg(F.min("_row").alias("_first")))  # one row for each shard
    numbered = cut.join(firsts, "shard").select("_part", "_slot", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
    return rows.join(numbered, ["_part", "_slot"]).select(
        *aside.back(),
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
