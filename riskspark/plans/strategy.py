"""Join strategy helpers: broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only below this many bytes of payload (measured).
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
          T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8}


def payload_bytes(df: DataFrame) -> int:
    """Bytes of column data in ``df`` (strings by UTF-8 length, other
    fields by their fixed width).  One small aggregation action; call it
    only on sides whose row count is bounded by construction."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"))
        else:
            parts.append(F.lit(_WIDTH.get(type(f.dataType), 16)).cast("long"))
    if not parts:
        return 0
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return int(df.agg(F.coalesce(F.sum(total + F.lit(16)), F.lit(0))).first()[0])


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join with ``small`` broadcast if its measured size is under the bound,
    otherwise as a shuffle join (sort-merge, with AQE's skew handling)."""
    if payload_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
