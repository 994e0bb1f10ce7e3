"""Column functions: null-safe clipping, logs, hashes, array statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-4
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clipping that keeps null as null; greatest and least alone would not."""
    x = col(x)
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def to_log(x: Column | str) -> Column:
    """log1p of a value clipped at 0."""
    return F.log1p(clip(x, 0.0))


def from_log(z: Column | str) -> Column:
    """The inverse of to_log with the output floor."""
    return clip(F.expm1(col(z)), FLOOR)


def epoch_hour(ts: str) -> Column:
    """Whole hours since 1970 of a timestamp without zone; no session zone enters."""
    return F.expr(f"cast(timestampdiff(HOUR, {EPOCH}, {ts}) as bigint)")


def hour_timestamp(hour: str) -> Column:
    return F.expr(f"timestampadd(HOUR, cast({hour} as int), {EPOCH})")


def hash_uniform(*tokens: Column | str) -> Column:
    """The first 8 bytes of the SHA-256 of the joined tokens as a number in [0, 1)."""
    text = F.concat_ws("|", *[col(t).cast("string") for t in tokens])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_bucket(token: Column | str, n: int) -> Column:
    """The first byte of a SHA-256, modulo n."""
    return (F.conv(F.substring(F.sha2(col(token).cast("string"), 256), 1, 2), 16, 10).cast("int") % n).cast("int")


def array_median(values: Column) -> Column:
    """The median of an array's non-null numbers, null without any."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def array_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v.isNotNull()))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def softplus(x: Column | str) -> Column:
    return F.log1p(F.exp(col(x)))
