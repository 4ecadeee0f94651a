"""Row ids derived from content, so that a retried task or a replayed batch produces the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
