"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATA = 1000


def stratified(rows: DataFrame, stratum: str, key: str, per: int) -> DataFrame:
    """At most about 1.2 * per rows of each stratum, chosen by a hash of the key; the STRATA largest strata take part."""
    counts = rows.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(STRATA).collect()
    if not counts:
        return rows.limit(0)
    grain = 1 << 30
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(int(min(1.0, 1.1 * per / r[1]) * grain)))])
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(grain)) < share[F.col(stratum)])
