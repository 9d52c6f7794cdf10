"""Joins whose key may be hot, and reads of the few rows a key table asks for.

The right side of ``hot_join`` has one row per key and says how many left rows
each key has, so the hot keys are known before the join: those with more than
``PER_TASK`` left rows.  A hot key is split into so many salts that none has more;
its one right row is repeated once per salt.  What is broadcast is a hash and a
number per hot key (at most one key in ``PER_TASK`` left rows, 12 bytes each),
never a right row, and only up to ``MOST_HOT`` keys: beyond these, the threshold
rises until they fit, so that the largest pieces are split first.

``asked_for`` keeps the rows of a wide table whose key is in a key table, and
few others, without a shuffle: the keys set bits in a filter of at most 4 MB,
which is broadcast.  The join behind it then shuffles the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight.store import keep

#: Left rows of one key, or piece of a key, that one task joins; the most hot keys.
PER_TASK, MOST_HOT = 250_000, 500_000
#: Stretches of the filter; each has 32,768 bits (4 KB).
STRETCHES = 1_024


def _free(names: list[str], *tables: DataFrame) -> list[str]:
    """``names``, made longer where a column of the tables is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while taken & set(names):
        names = ["_" + n for n in names]
    return names


def hot_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, per_task: int = PER_TASK) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row per key, ``count`` left rows each).

    ``total`` is the number of left rows that have a partner or an upper bound
    of it.  A key of the left that is not on the right must not be hot.
    ``count`` is not in the result.  Left rows that are equal in every column
    get the same salt.
    """
    if total <= per_task:  # no key can be hot
        return left.join(right.drop(count), on)
    bound = max(per_task, -(-total // MOST_HOT))
    h, s, salt = _free(["_h", "_s", "_salt"], left, right)
    # By hash on both sides: should a cold key share the hash of a hot one, both its sides are salted alike.
    salts = right.where(F.col(count) > bound).groupBy(F.xxhash64(*on).alias(h)).agg(F.max(F.ceil(F.col(count) / bound)).cast("int").alias(s))
    salts = F.broadcast(keep(salts, "hot"))
    pieces = F.coalesce(s, F.lit(1))
    one = right.drop(count).withColumn(h, F.xxhash64(*on)).join(salts, h, "left")
    one = one.withColumn(salt, F.explode(F.sequence(F.lit(0), pieces - 1))).drop(h, s)
    others = [c for c in left.columns if c not in on]  # no draw: a task that is run again salts alike
    many = left.withColumn(h, F.xxhash64(*on)).join(salts, h, "left")
    drawn = F.when(F.col(s).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(7), *others), pieces)).cast("int")
    return many.withColumn(salt, drawn).drop(h, s).join(one, [*on, salt]).drop(salt)


def _place(key: list[str]) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(5), *key)
    return F.pmod(h, F.lit(STRETCHES)).cast("int"), F.shiftrightunsigned(h, 24) % 32_768


def asked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``_asked``: true for each row whose key is in ``keys`` and few others.

    Of the others three in a thousand at a hundred thousand keys, three in a
    hundred at a million, all at a billion (a larger ``STRETCHES`` moves that up).
    A null key may be asked for.
    """
    stretch, bit = _place(on)
    filter_ = keys.select(stretch.alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    filter_ = F.broadcast(keep(filter_, "filter"))
    byte = F.expr("conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10)").cast("int")
    hit = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1")
    placed = rows.withColumns({"_at": stretch, "_bit": bit}).join(filter_, "_at", "left").withColumn("_byte", byte)
    return placed.withColumn("_asked", F.coalesce(hit, F.lit(False))).drop("_at", "_bit", "_bits", "_byte")


def asked_for(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows ``asked`` says yes to."""
    return asked(rows, keys, on).where("_asked").drop("_asked")
