"""Items packed into containers of one capacity, by the sum-of-squares rule.

An item goes where the sum, over all gaps, of the squared number of open
containers with that gap becomes smallest: into an open container, or a new one.
The rule keeps a stock of different gaps, so that later items find one they fill
exactly, without knowing what is to come.

Items are dealt to packers of about ``PER_PACKER`` items by the hash of their
key; each packer takes its items by falling size (ties by that hash), so a packer
that is run again packs alike.  The containers left open by all packers then become
the items of a next round with ``FAN_IN`` times fewer packers, until one packer is
left; what a round leaves open is a few thousand containers per packer, however
many items it had.  Containers that are full are never touched again.  The stock
the rule still holds open when the last packer is done has no later items to wait
for: it is closed by best fit, open containers that fit together becoming one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provelight.llm.hot import asked
from provelight.store import keep

PER_PACKER = 200_000
FAN_IN = 16


class Packer:
    """Sum-of-squares packing of a stream of sizes from 1 to ``capacity``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open containers by gap; full and new ones count as none
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, size: int) -> int:
        """The container the item goes into, numbered from 0."""
        count, cap = self.count, self.capacity
        # From gap g to g - size the sum of squares changes by 2 * (count[g - size] - count[g] + 1); a gap
        # that becomes 0 no longer counts (- 2 * count[g] + 1), a new container adds 2 * count[cap - size] + 1.
        change = 2 * (count[: cap - size] - count[size:cap] + 1)
        change[:1] = 1 - 2 * count[size : size + 1]
        usable = count[size:cap] > 0
        best, gap = 2 * int(count[cap - size]) + 1 if size < cap else 0, cap
        if usable.any():
            change = np.where(usable, change, np.iinfo(np.int64).max)
            at = int(change.argmin())
            if change[at] <= best:
                best, gap = int(change[at]), at + size
        if gap == cap:
            number = self.used
            self.used += 1
        else:
            number = self.open[gap].pop()
            count[gap] -= 1
        left = gap - size
        if left:
            self.open[left].append(number)
            count[left] += 1
        return number

    def closing(self) -> list[tuple[int, int]]:
        """(container, container it is emptied into) by best fit among those left open, fullest first."""
        moves, gaps = [], []
        for n, filled in sorted(self.left_open(), key=lambda x: (-x[1], x[0])):
            at = bisect.bisect_left(gaps, (filled, -1))
            if at < len(gaps):
                gap, into = gaps.pop(at)
                moves.append((n, into))
                bisect.insort(gaps, (gap - filled, into))
            else:
                bisect.insort(gaps, (self.capacity - filled, n))
        return moves

    def left_open(self) -> list[tuple[int, int]]:
        """(container, filled) of all containers with a gap."""
        return [(n, self.capacity - gap) for gap in range(1, self.capacity) for n in self.open[gap]]


def _round(items: DataFrame, packers: int, level: int, capacity: int) -> DataFrame:
    """(item, piece, box, filled, kind).

    kind 0: the box of each item; 1: a box left open, item NULL; 2: box ``item``
    is emptied into ``box`` (the last round, which has one packer, closes so).
    """
    import pandas as pd

    columns = {"item": "Int64", "piece": "Int32", "box": "int64", "filled": "int32", "kind": "int32"}
    table = lambda *values: pd.DataFrame({c: pd.array(v, t) for (c, t), v in zip(columns.items(), values, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, group, base = None, None, 0

        def rest() -> pd.DataFrame:
            if packers == 1:
                moves = packer.closing()
                none = [0] * len(moves)
                return table([base + a for a, _ in moves], none, [base + b for _, b in moves], none, [2] * len(moves))
            left = packer.left_open()
            none = [None] * len(left)
            return table(none, none, [base + n for n, _ in left], [f for _, f in left], [1] * len(left))

        for batch in batches:
            for g, part in batch.groupby("g", sort=False):
                if g != group:
                    if packer is not None:
                        yield rest()
                    packer, group = Packer(capacity), g
                    base = (level << 58) | (int(g) << 32)
                sizes = part["size"].tolist()
                yield table(part["item"].tolist(), part["piece"].tolist(), [base + packer.place(s) for s in sizes], sizes, [0] * len(sizes))
        if packer is not None:
            yield rest()

    dealt = items.withColumn("_h", F.xxhash64("item")).withColumn("g", F.pmod("_h", F.lit(packers)).cast("int"))
    ordered = dealt.repartitionById(packers, "g").sortWithinPartitions("g", F.desc("size"), "_h", "item", "piece")
    return ordered.select("g", "item", "piece", "size").mapInPandas(run, "item bigint, piece int, box bigint, filled int, kind int")


def pack(df: DataFrame, key: str, size: str, capacity: int, per_packer: int = PER_PACKER, fan_in: int = FAN_IN) -> DataFrame:
    """(key, piece, start, n_units, container) of every row.

    A row larger than ``capacity`` is split into full pieces and a rest; any
    other row is one piece and never split.  Rows of size 0, null or negative
    need no room: one piece of 0 units in no container (NULL).  Keys must be
    distinct bigints.
    """
    sizes = df.select(F.col(key).cast("bigint").alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_s"))
    sizes = keep(sizes, "sizes")  # read twice below; measuring may be dear
    pieces = keep(
        sizes.where("_s > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_s - 1) div {capacity} as int)"))))
        .select("item", "piece", F.least(F.col("_s") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("int").alias("size")),
        "pieces",
    )
    n = pieces.count()
    packers = max(1, -(-n // per_packer))
    packed = keep(_round(pieces, packers, 0, capacity), "packed")
    placed = packed.where("kind = 0").select("item", "piece", "box", F.col("filled").alias("size"))
    moves = lambda kind: packed.where(F.col("kind") == kind).select(F.col("item").alias("box"), F.col("box").alias("_to"))
    # Moves of the rounds are few; they are composed, and the items meet them once.
    way, level = [], 1
    while packers > 1:
        packers = -(-packers // fan_in)
        left = packed.where("kind = 1").select(F.col("box").alias("item"), F.lit(0).alias("piece"), F.col("filled").alias("size"))
        packed = keep(_round(left, packers, level, capacity), "repacked")
        way.append(moves(0))
        level += 1
    final = moves(2)
    for step in reversed(way):
        on = final.select(F.col("box").alias("_to"), F.col("_to").alias("_on"))
        final = step.join(on, "_to", "left").select("box", F.coalesce("_on", "_to").alias("_to"))
    final = keep(final, "moves")
    met = asked(placed, final, ["box"])
    moved = met.where("_asked").join(final, "box", "left").select("item", "piece", F.coalesce("_to", "box").alias("box"), "size")
    placed = met.where("not _asked").select("item", "piece", "box", "size").unionByName(moved)
    rows = placed.select("item", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), F.col("size").alias("n_units"), F.col("box").alias("container"))
    empty = sizes.where("_s = 0").select(
        "item", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("n_units"), F.lit(None).cast("bigint").alias("container")
    )
    return rows.unionByName(empty).withColumnRenamed("item", key)
