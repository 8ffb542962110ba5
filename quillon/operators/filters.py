"""Row predicates: metadata, liveness, expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import InvalidArgument

FIELDS = ("tag", "source", "lang")


def metadata(filters: dict[str, str] | None, meta: str = "meta") -> Column:
    """All given fields must be equal; a row without the field fails; no filter passes."""
    out = F.lit(True)
    for name, want in (filters or {}).items():
        if name not in FIELDS:
            raise InvalidArgument(f"only {', '.join(FIELDS)} can be filtered")
        out = out & F.coalesce(F.col(meta)[name] == F.lit(want), F.lit(False))
    return out


def unexpired(as_of: datetime | Column, column: str = "expires_at") -> Column:
    """A row expires at its time, inclusively; null never expires."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.col(column).isNull() | (at < F.col(column))


def live(df: DataFrame, as_of: datetime | Column | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    if as_of is not None and "expires_at" in df.columns:
        df = df.where(unexpired(as_of))
    return df.where(metadata(filters)) if filters else df
