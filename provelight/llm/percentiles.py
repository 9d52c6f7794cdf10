"""Exact percentiles per group by distributed multi-select.

``parts`` turns each input partition (a file, a day) into sorted runs of at most
``RUN`` values; parts made apart are combined by a plain union.  ``percentiles``
finds the wanted ranks of all groups at once, round by round: a pivot is the
weighted median of the medians that the partitions propose; every partition
counts its values below, at and above the pivot and, in the same pass, proposes
the medians of what it has below and above, so that one pass over the runs is one
round; the range that cannot hold the rank is discarded.  A pivot is an element
of the data that is still in range, so each round discards something, and at
least an eighth of the candidates.  Once the candidates of all open ranks are a
quarter of the values a pass reads, they are written out and the next passes read
only them.  After at least one round a rank with at most ``GATHER`` candidates is
read off its sorted candidates.  The values found are elements of the data; their
rank error is 0.

Targets, ranges, pivots and results are tables, one row per group, metric and
quantile; the driver sees one row of totals a round.  The runs meet them in a join
that Spark broadcasts if the table is small and shuffles if not (a hot group's
runs are many rows of one key, which adaptive execution splits).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight.store import keep

#: Values of one sorted run; values a task holds before it writes runs; rows of totals it holds.
RUN, HELD, TOTALS = 8_192, 2_000_000, 50_000
#: Candidates of one rank that are sorted at last.
GATHER = 512

_TARGET = ["group", "metric", "quantile"]
_COUNTED = "`group` string, metric string, quantile double, less bigint, same bigint, more bigint, below double, above double"


def parts(df: DataFrame, groups: Sequence[str], values: Sequence[str], least: float = 0.0) -> DataFrame:
    """(group, metric, run) of all measured values; ``group`` is the JSON of the group columns.

    Null, NaN and values below ``least`` are not measured and stay out; infinity
    is a value like any other, the largest.
    """
    import pyarrow as pa

    values = list(values)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (group, metric), arrays in held.items():
            run = np.sort(np.concatenate(arrays))
            for at in range(0, len(run), RUN):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group]), pa.array([metric]), pa.array([run[at : at + RUN]], pa.list_(pa.float64()))], ["group", "metric", "run"]
                )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            group = batch.column(0).dictionary_encode()
            code = group.indices.to_numpy(zero_copy_only=False)
            names = group.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(names) + 1))
            for at, metric in enumerate(values, 1):
                x = batch.column(at).to_numpy(zero_copy_only=False).astype(np.float64)[order]
                for k, name in enumerate(names):
                    mine = x[edges[k] : edges[k + 1]]
                    mine = mine[mine >= least]  # false for NaN, and for null, which arrives as NaN
                    if len(mine):
                        held.setdefault((name, metric), []).append(mine)
                        size += len(mine)
            if size > HELD:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    rows = df.select(key.alias("group"), *[F.col(v).cast("double").alias(v) for v in values])
    return rows.mapInArrow(work, "`group` string, metric string, run array<double>")


def _pairs(values: str, weights: str) -> Column:
    """An aggregate: (value, weight) of what the partitions propose, one pair per partition and flush."""
    return F.sort_array(F.collect_list(F.when(F.col(weights) > 0, F.struct(F.col(values).alias("v"), F.col(weights).alias("w")))))


def _weighted_median(pairs: str) -> Column:
    """The first value at which half of all weights are reached; NULL of nothing."""
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(F.col(pairs), zero, lambda acc, p: acc + p["w"])
    start = F.struct(total.alias("all"), zero.alias("sum"), F.lit(None).cast("double").alias("v"))
    step = lambda acc, p: F.struct(
        acc["all"].alias("all"),
        (acc["sum"] + p["w"]).alias("sum"),
        F.coalesce(acc["v"], F.when((acc["sum"] + p["w"]) * 2 >= acc["all"], p["v"])).alias("v"),
    )
    return F.aggregate(F.col(pairs), start, step)["v"]


def _met(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Each run with the open targets it can hold: (group, metric, run, targets)."""
    target = F.struct("quantile", "low", "high", "pivot")
    if "quantile" in runs.columns:
        return runs.join(state.select(*_TARGET, F.array(target).alias("targets")), _TARGET).drop("quantile")
    return runs.join(state.groupBy("group", "metric").agg(F.collect_list(target).alias("targets")), ["group", "metric"])


def _ranges(batch) -> Iterator[tuple[tuple, np.ndarray, float]]:
    """((group, metric, quantile), values in range, pivot) of every run and target of a batch."""
    groups, metrics, runs, targets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
    for i, wanted in enumerate(targets):
        x = runs[i].values.to_numpy(zero_copy_only=False)
        for t in wanted:
            a = 0 if t["low"] is None else int(np.searchsorted(x, t["low"], "right"))
            b = len(x) if t["high"] is None else int(np.searchsorted(x, t["high"], "left"))
            if b > a:
                yield (groups[i], metrics[i], t["quantile"]), x[a:b], t["pivot"]


def _middle(pieces: list[tuple[float, int]]) -> float | None:
    if not pieces:
        return None
    values, weights = map(np.asarray, zip(*sorted(pieces), strict=True))
    total = np.cumsum(weights)
    return float(values[np.searchsorted(total, total[-1] / 2)])


def _round(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Per target: values below, at and above its pivot, and the next pivots of both sides."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, n[0], n[1], n[2], _middle(n[3]), _middle(n[4])) for k, n in held.items()]
            types = [pa.string(), pa.string(), pa.float64(), *[pa.int64()] * 3, *[pa.float64()] * 2]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["group", "metric", "quantile", "less", "same", "more", "below", "above"])

        for batch in batches:
            for key, x, pivot in _ranges(batch):
                less, upto = int(np.searchsorted(x, pivot, "left")), int(np.searchsorted(x, pivot, "right"))
                n = held.setdefault(key, [0, 0, 0, [], []])
                n[0] += less
                n[1] += upto - less
                n[2] += len(x) - upto
                if less:
                    n[3].append((float(x[less // 2]), less))
                if upto < len(x):
                    n[4].append((float(x[(upto + len(x)) // 2]), len(x) - upto))
            if len(held) > TOTALS:
                yield flush()
        if held:
            yield flush()

    counted = _met(runs, state).mapInArrow(work, _COUNTED)
    sums = [F.sum(c).alias(c) for c in ("less", "same", "more")]
    grouped = counted.groupBy(*_TARGET).agg(*sums, _pairs("below", "less").alias("below"), _pairs("above", "more").alias("above"))
    return grouped.withColumns({c: _weighted_median(c) for c in ("below", "above")})


def _narrowed(runs: DataFrame, state: DataFrame) -> DataFrame:
    """(group, metric, quantile, run): what of each run is a candidate of an open target."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_ranges(batch))
            if found:
                keys = [pa.array(c, t) for c, t in zip(zip(*(k for k, _, _ in found), strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([x for _, x, _ in found], pa.list_(pa.float64()))], [*_TARGET, "run"])

    return _met(runs, state).mapInArrow(work, "`group` string, metric string, quantile double, run array<double>")


def percentiles(runs: DataFrame, quantiles: Sequence[float], gather: int = GATHER) -> DataFrame:
    """(group, metric, n, quantile, value): the element at rank ceil(q * n), at least 1.

    ``runs`` is what ``parts`` gives, or a union of several.  A group without
    measured values has no rows; ties count as often as they occur.
    """
    runs = keep(runs, "runs")
    sized = runs.withColumns({"_m": F.get("run", F.floor(F.size("run") / 2).cast("int")), "_w": F.size("run").cast("bigint")})
    sizes = sized.groupBy("group", "metric").agg(F.sum("_w").alias("n"), _pairs("_m", "_w").alias("pivot")).withColumn("pivot", _weighted_median("pivot"))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("quantile") * F.col("n"), 9))).cast("bigint") - 1
    state = (
        sizes.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumns({"rank": rank, "left": F.col("n"), **{c: F.lit(None).cast("double") for c in ("low", "high", "value")}})
        .withColumn("open", F.lit(True))
    )
    state = keep(state, "targets")
    unread = None
    while True:
        # open: not found and still too many candidates, or not yet met by any pivot
        waiting = state.where("open")
        total = waiting.agg(F.sum("left").alias("left"), F.count("*").alias("n")).first()
        if not total["n"]:
            break
        if unread is not None and total["left"] * 4 <= unread:
            runs = keep(_narrowed(runs, state.where("value is null")), "candidates")
            unread = total["left"]
        unread = unread if unread is not None else total["left"]
        met = state.join(_round(runs, waiting), _TARGET, "left")
        down, hit = F.col("rank") < F.col("less"), F.col("rank") < F.col("less") + F.col("same")
        was = F.col("less").isNotNull()
        pick = lambda lower, equal, upper, old: F.when(~was, old).when(down, lower).when(hit, equal).otherwise(upper)
        none = F.lit(None).cast("double")
        gone = F.col("less") + F.col("same")
        left = pick(F.col("less"), F.lit(0).cast("bigint"), F.col("more"), F.col("left"))
        value = pick(none, F.col("pivot"), none, F.col("value"))
        state = met.select(
            *_TARGET, "n",
            pick(F.col("rank"), F.col("rank"), F.col("rank") - gone, F.col("rank")).alias("rank"),
            left.alias("left"),
            pick(F.col("low"), F.col("low"), F.col("pivot"), F.col("low")).alias("low"),
            pick(F.col("pivot"), F.col("high"), F.col("high"), F.col("high")).alias("high"),
            value.alias("value"),
            pick(F.col("below"), none, F.col("above"), F.col("pivot")).alias("pivot"),
            (F.col("open") & value.isNull() & (left > gather)).alias("open"),
        )
        state = keep(state, "targets")
    rest = state.where("value is null")
    last = _narrowed(runs, rest).groupBy(*_TARGET).agg(F.sort_array(F.flatten(F.collect_list("run"))).alias("_x"))
    found = F.coalesce("value", F.get("_x", F.col("rank").cast("int")))
    return state.join(last, _TARGET, "left").select("group", "metric", "n", "quantile", found.alias("value"))
