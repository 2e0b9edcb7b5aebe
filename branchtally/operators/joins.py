"""Left joins to a side with unique keys, whatever the size of either side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col


@dataclass(frozen=True)
class JoinPolicy:
    """When a lookup side is broadcast, what counts as a hot key beyond that, and over how many salts it is dealt."""

    broadcast_bytes: int = 64 << 20
    hot_share: float = 0.005
    salts: int = 64


_SALT = "_salt_of_key"


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, or None where it cannot be asked."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(stats.sizeInBytes())
    except Exception:  # a client without access to the plan
        return None


def measured_bytes(df: DataFrame) -> int:
    """The size a table would have as a broadcast, measured by one aggregate."""
    width = 16
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(col(f.name)), F.lit(0)) + 16
        else:
            width = width + 16
    row = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width)).alias("b")).first()
    return int(row["b"] or 0)


def _auto_broadcast_bytes(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    digits = text.lower().removesuffix("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits[:-1] if scale else digits) << scale


def fits_broadcast(df: DataFrame, policy: JoinPolicy = JoinPolicy()) -> bool:
    """Whether a lookup side may be broadcast: by estimate if small, else by measure."""
    estimate = estimated_bytes(df)
    if estimate is not None and estimate <= min(policy.broadcast_bytes, _auto_broadcast_bytes(df)):
        return True
    return measured_bytes(df) <= policy.broadcast_bytes


def left_lookup(
    left: DataFrame, right: DataFrame, key: str, policy: JoinPolicy = JoinPolicy()
) -> DataFrame:
    """Left join to a side with unique keys; every left row stays, once.

    A small right side is broadcast and the left side is not shuffled. With a large one both
    sides are shuffled by key and salt: rows of hot keys are dealt over the salts, and the few
    right rows they can meet are copied once a salt. Every other key has one salt. The join is
    one plan over one scan of the left side; before it, one pass over the key column alone finds
    the hot keys.
    """
    if fits_broadcast(right, policy):
        return left.join(F.broadcast(right), key, "left")
    hot = hot_keys(left, key, policy.hot_share)
    is_hot = F.coalesce(col(key), F.lit("")).isin(*hot)
    # whatever salt a row gets, its right row is there; so a task that is run again may deal anew
    dealt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(policy.salts))).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(policy.salts - 1))).otherwise(F.array(F.lit(0)))
    salted = right.withColumn(_SALT, F.explode(copies))
    return left.withColumn(_SALT, dealt.cast("int")).join(salted, [key, _SALT], "left").drop(_SALT)


def hot_keys(df: DataFrame, key: str, share: float) -> list[str]:
    """Every key that may hold more than ``share`` of the rows (and blank).

    One pass with bounded memory; it can name a key too many but never misses one, and
    at most ``1/share`` come back.
    """
    found = df.select(F.coalesce(col(key), F.lit("")).alias("k")).freqItems(["k"], share).first()
    return sorted({*(found["k_freqItems"] or []), ""})
