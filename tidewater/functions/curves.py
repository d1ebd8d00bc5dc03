"""Space-filling-curve codes as native integer column expressions.

Everything here is ``shiftleft`` / ``shiftright`` / ``bitwiseAND`` / ``^``
on BIGINT columns, so it stays inside whole-stage codegen (no UDF).
Coordinates are non-negative voxel indices below 2^16 (depth <= 16).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 16


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bit_length(c: Column | str) -> Column:
    """Bits needed for a non-negative integer (0 -> 0)."""
    c = _c(c)
    return F.when(c <= 0, F.lit(0)).otherwise(F.length(F.bin(c))).cast("bigint")


def interleave3(x: Column | str, y: Column | str, z: Column | str, bits: int = MAX_DEPTH) -> Column:
    """Bit i of x, y, z goes to key bits 3i+2, 3i+1, 3i (z-order / Morton)."""
    x, y, z = (_c(v).cast("bigint") for v in (x, y, z))
    key = F.lit(0).cast("bigint")
    for i in range(bits):
        for axis, off in ((x, 2), (y, 1), (z, 0)):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(axis, i).bitwiseAND(F.lit(1)), 3 * i + off))
    return key


def deinterleave3(key: Column | str, axis: int, bits: int = MAX_DEPTH) -> Column:
    """Coordinate ``axis`` (0 = x, 1 = y, 2 = z) of an interleaved key."""
    key = _c(key).cast("bigint")
    off = 2 - axis
    v = F.lit(0).cast("bigint")
    for i in range(bits):
        v = v.bitwiseOR(F.shiftleft(F.shiftright(key, 3 * i + off).bitwiseAND(F.lit(1)), i))
    return v


def z_order(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """PC3 key."""
    return interleave3(x, y, z)


def _pow2(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int"))


def _skilling_step(s: Column, q: Column, axes: tuple[int, ...]) -> Column:
    """One level of Skilling's transform on state struct(a0, a1, a2) for the
    given axis order; set bit -> invert the lower bits of a0, clear bit ->
    exchange the lower bits of a0 and the axis where they differ."""
    p = q - 1
    a = [s["a0"], s["a1"], s["a2"]]
    for i in axes:
        setbit = a[i].bitwiseAND(q) != 0
        if i == 0:
            a[0] = F.when(setbit, a[0].bitwiseXOR(p)).otherwise(a[0])
            continue
        t = a[0].bitwiseXOR(a[i]).bitwiseAND(p)
        a0 = F.when(setbit, a[0].bitwiseXOR(p)).otherwise(a[0].bitwiseXOR(t))
        a[i] = F.when(setbit, a[i]).otherwise(a[i].bitwiseXOR(t))
        a[0] = a0
    return F.struct(a[0].alias("a0"), a[1].alias("a1"), a[2].alias("a2"))


def _levels(depth: Column, descending: bool) -> Column:
    d = depth.cast("int")
    seq = F.sequence(d - 1, F.lit(0), F.lit(-1)) if descending else F.sequence(F.lit(0), d - 1)
    return F.when(d > 0, seq).otherwise(F.array().cast("array<int>"))


def with_hilbert(df: DataFrame, x: str, y: str, z: str, depth: Column | str, out: str) -> DataFrame:
    """PC5: add the Hilbert key of (x, y, z) at ``depth`` bits as ``out``.

    Skilling's transform level by level from the top bit, axes in order 0, 1,
    2; then the axes are interleaved (axis 0 highest) and Gray-decoded
    (prefix XOR). The key depends on ``depth`` (leading zero levels still
    exchange axes), which may be a column. The level loop is one higher-order
    ``aggregate``; interleave and prefix XOR are separate projections so no
    expression is ever duplicated into another.
    """
    init = F.struct(*[F.col(c).cast("bigint").alias(f"a{i}") for i, c in enumerate((x, y, z))])
    d = df.withColumn("_hst", F.aggregate(_levels(_c(depth), True), init,
                                          lambda s, lv: _skilling_step(s, _pow2(lv), (0, 1, 2))))
    d = d.withColumn("_hk", interleave3(F.col("_hst.a0"), F.col("_hst.a1"), F.col("_hst.a2"))).drop("_hst")
    for sh in (1, 2, 4, 8, 16, 32):
        d = d.withColumn("_hk", F.col("_hk").bitwiseXOR(F.shiftright("_hk", sh)))
    return d.withColumnRenamed("_hk", out)


def with_hilbert_decoded(df: DataFrame, key: str, depth: Column | str, outs: tuple[str, str, str]) -> DataFrame:
    """PC6: inverse of :func:`with_hilbert`: Gray-encode, de-interleave, then
    undo the levels bottom-up with the axes reversed (each step is its own
    inverse). Adds the cells as columns ``outs``."""
    d = df.withColumn("_hg", F.col(key).cast("bigint").bitwiseXOR(F.shiftright(F.col(key).cast("bigint"), 1)))
    d = d.withColumn("_hin", F.struct(*[deinterleave3("_hg", i).alias(f"a{i}") for i in range(3)])).drop("_hg")
    d = d.withColumn("_hdec", F.aggregate(_levels(_c(depth), False), F.col("_hin"),
                                          lambda s, lv: _skilling_step(s, _pow2(lv), (2, 1, 0)))).drop("_hin")
    return d.select("*", *[F.col("_hdec")[f"a{i}"].alias(o) for i, o in enumerate(outs)]).drop("_hdec")


def shift_left(c: Column | str, bits: Column | str | int) -> Column:
    """``c << bits`` with a column shift amount."""
    b = F.lit(bits) if isinstance(bits, int) else _c(bits)
    return F.call_function("shiftleft", _c(c).cast("bigint"), b.cast("int"))


def shift_right(c: Column | str, bits: Column | str | int) -> Column:
    """``c >> bits`` (arithmetic) with a column shift amount."""
    b = F.lit(bits) if isinstance(bits, int) else _c(bits)
    return F.call_function("shiftright", _c(c).cast("bigint"), b.cast("int"))


def with_batch(key: Column | str, batch: Column | str, depth: Column | str) -> Column:
    """PC9: key OR (batch << 3 * depth): many clouds in one key space."""
    return _c(key).bitwiseOR(shift_left(batch, F.lit(3) * _c(depth)))


def batch_of(key: Column | str, depth: Column | str) -> Column:
    """PC9 inverse: the cloud part of a combined key."""
    return shift_right(key, F.lit(3) * _c(depth))
