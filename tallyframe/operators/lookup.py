"""A join with a lookup that stays even when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Sequence[str] = (),
    salts: int | None = None,
) -> DataFrame:
    """Inner join with a frame that has one row per key.

    Each key's rows are dealt into `salts` groups and the lookup is copied for
    each of them, so a hot key goes to several tasks. Adaptive execution does
    not split a hot key by itself here, because the lookup comes straight from
    an aggregate. Where the lookup is small, Spark broadcasts it as usual.
    Unless given, there is a group per 16 shuffle partitions, 16 at least.
    """
    if salts is None:
        salts = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    spread = F.pmod(F.xxhash64(*(spread_by or rows.columns)), F.lit(salts))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    dealt = rows.withColumn("_salt", spread)
    copied = lookup.withColumn("_salt", F.explode(every))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
