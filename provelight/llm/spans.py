"""Long spans that stand verbatim in more than one text, by recompression.

Every text is rewritten in rounds.  A round names runs of one symbol (two or
more equal neighbours become one symbol) or pairs (a pair of symbols from the
left and the right half of the alphabet becomes one symbol).  Which runs and
pairs are named, and their names, depend on nothing but the symbols themselves:
names are hashes of what they stand for, so they are global without any exchange
between tasks, and equal substrings get equal symbols but for a bounded margin at
their ends.  No symbol may grow beyond the cap of its round, which bounds both
the margin (``MARGIN``) and the length of a symbol (``GAP``), so that every
shared span of ``length`` characters holds symbol boundaries both occurrences
agree on; ``plan`` checks that.

1. Of the agreed boundaries the one whose symbol has the smallest hash is the
   anchor of a window of ``length`` characters (about one in 70 characters is
   anchor of some window).  Anchors with the same ``2 * MARGIN`` characters
   around them in two or more texts reveal candidates (first shuffle: one row
   of a few numbers per anchor).
2. Equal windows have equal anchors, so a window need only be compared with those
   of its anchor's candidates.  Where the windows of all candidates cover equal
   content, these are shared as a whole and nothing more is looked at: that is the
   inside of a repeat.  At its edges contents differ; equal ones are shared, and
   one text stands for all that have it in the next step.
3. The windows at the edges are fingerprinted and counted by text (second
   shuffle).  A window that stands in two texts is shared; adjoining windows are
   merged into spans.

Texts are fetched again for step 3 alone, and only those that have edges.  No
pairs of texts are made; a passage that stands in a third of all texts is one hot
key, which is aggregated before the shuffle and split after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provelight.llm.hot import asked_for, hot_join
from provelight.llm.prints import ODD, Windows, block, blocks, mix
from provelight.store import keep

#: Rounds and the most characters a symbol may have after each.
ROUNDS = [("run", 3), ("pair", 3), ("pair", 4), ("pair", 6), ("run", 8), ("pair", 9), ("pair", 13), ("pair", 18)]


def margin_and_gap(rounds: list[tuple[str, int]] = ROUNDS) -> tuple[int, int]:
    """Characters at either end of equal substrings whose boundaries may differ, and the longest symbol.

    A pair round can change the outermost symbol only.  A run round can besides
    join or leave apart the symbols of the outermost run, which if joined has at
    most the cap's length.
    """
    margin, longest = 0, 1
    for kind, cap in rounds:
        margin += longest + (cap if kind == "run" else 0)
        longest = max(longest, cap)
    return margin, longest


MARGIN, GAP = margin_and_gap()


def plan(length: int) -> int:
    """Width of the part of a window in which anchors are sought; at least one boundary is in it."""
    width = length - 2 * MARGIN - GAP
    if width < GAP:
        raise ValueError(f"spans of {length} characters are too short for these rounds (at least {2 * MARGIN + 2 * GAP})")
    return width


def symbols(codes: np.ndarray, breaks: np.ndarray, rounds: list[tuple[str, int]] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(start, name) of the symbols of a block of texts.

    ``codes`` are the code points of all texts, ``breaks`` marks the first
    character of each text; nothing is joined across it.
    """
    start = np.arange(len(codes), dtype=np.int64)
    name = mix(codes.astype(np.uint64) + np.uint64(1))
    first = breaks.copy()
    for number, (kind, cap) in enumerate(rounds):
        n = len(name)
        if n < 2:
            break
        size = np.diff(start, append=len(codes))
        salt = mix(np.array([number + 1], np.uint64) * ODD[0])
        if kind == "run":
            # Symbols equal to their left neighbour, few as a rule, in groups that follow one another.
            same = np.flatnonzero((name[1:] == name[:-1]) & ~first[1:]) + 1
            if not len(same):
                continue
            head = np.flatnonzero(np.diff(same, prepend=same[0] - 2) != 1)
            left, count = same[head] - 1, np.diff(head, append=len(same)) + 1
            join = size[left] * count <= cap  # equal symbols have equal lengths
            gone = same[np.repeat(join, count - 1)]
            left, count = left[join], count[join]
            name[left] = mix(name[left] * ODD[1] + count.astype(np.uint64) * ODD[0] + salt)
        else:
            # Names are hashes, so one product mixes them enough to tell the halves of the alphabet apart.
            side = ((name ^ salt) * ODD[0] >> np.uint64(63)).astype(bool)
            left = np.flatnonzero(~side[:-1] & side[1:] & ~first[1:] & (size[:-1] + size[1:] <= cap))
            gone = left + 1
            name[left] = mix(mix(name[left] * ODD[0] + salt) + name[gone] * ODD[1])
        stay = np.ones(n, bool)
        stay[gone] = False
        start, name, first = start[stay], name[stay], first[stay]
    return start, name


def anchors(codes: np.ndarray, breaks: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block: (text number, position, first and last window start it is anchor of).

    Positions and window starts count from the start of the text.
    """
    seek = plan(length)
    start, name = symbols(codes, breaks)
    # Order of the anchors: a boundary's rank is the hash of the symbol that begins there.
    rank = mix(name + ODD[0])
    text = np.searchsorted(at, start, side="right") - 1
    ok = (np.diff(at) >= length)[text]
    start, rank, text = start[ok], rank[ok], text[ok]
    # A window p seeks the smallest rank in [p + MARGIN, p + MARGIN + seek], so that the symbol
    # beginning there ends inside the agreed part too; of equal ranks the first.
    before = _smaller(start, rank, text, seek, -1)
    after = _smaller(start, rank, text, seek, 1)
    first = np.maximum(np.maximum(at[text], start - MARGIN - seek), before - MARGIN + 1)
    last = np.minimum(np.minimum(at[text + 1] - length, start - MARGIN), after - MARGIN - seek - 1)
    some = np.flatnonzero(first <= last)
    text, begin = text[some], at[text[some]]
    return text, start[some] - begin, first[some] - begin, last[some] - begin


def _smaller(start: np.ndarray, rank: np.ndarray, text: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Position of the nearest boundary on one side with a smaller rank (before: or an equal one).

    Sought up to ``reach`` characters away in the same text; else beyond all positions.
    """
    n = len(start)
    found = np.full(n, -(1 << 40) if step < 0 else 1 << 40, np.int64)
    open_, k = np.arange(n), 0
    while len(open_):
        k += step
        there = open_ + k
        ok = (there >= 0) & (there < n)
        open_, there = open_[ok], there[ok]
        ok = (text[there] == text[open_]) & (np.abs(start[there] - start[open_]) <= reach)
        open_, there = open_[ok], there[ok]
        less = rank[there] <= rank[open_] if step < 0 else rank[there] < rank[open_]
        found[open_[less]] = start[there[less]]
        open_ = open_[~less]
    return found


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    import pyarrow as pa

    names = ["id", "g1", "g2", "c1", "c2", "first", "last"]
    types = [*[pa.int64()] * 5, pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            codes, at = block([t for _, t in rows])
            breaks = np.zeros(len(codes), bool)
            breaks[at[:-1]] = True  # no text here is empty
            number, pos, first, last = anchors(codes, breaks, at, length)
            if not len(number):
                continue
            # A text shows the same grams again where it repeats itself; that is harmless.
            windows = Windows(codes)
            gram = windows.prints(at[number] + pos - MARGIN, 2 * MARGIN)
            content = windows.prints(at[number] + first, last - first + length)
            ids = np.fromiter((i for i, _ in rows), np.int64, len(rows))[number]
            columns = (ids, *gram, *content, first, last)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return texts.mapInArrow(run, "id bigint, g1 bigint, g2 bigint, c1 bigint, c2 bigint, first int, last int")


def _window_rows(texts: DataFrame, length: int) -> DataFrame:
    """(id, p, w1, w2, lo, hi) of every window start in the ranges listed for a text.

    lo and hi are the smallest and largest id of the texts a range stands for.
    """
    import pyarrow as pa

    names = ["id", "p", "w1", "w2", "lo", "hi"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            codes, at = block([r[1] for r in rows])
            ids, ps, where, lo, hi = [], [], [], [], []
            for k, (ident, _, ranges) in enumerate(rows):
                for r in ranges:
                    p = np.arange(r["first"], r["last"] + 1)
                    ids.append(np.full(len(p), ident))
                    ps.append(p)
                    where.append(p + at[k])
                    lo.append(np.full(len(p), r["lo"]))
                    hi.append(np.full(len(p), r["hi"]))
            w1, w2 = Windows(codes).prints(np.concatenate(where), length)
            columns = (np.concatenate(ids), np.concatenate(ps), w1, w2, np.concatenate(lo), np.concatenate(hi))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return texts.mapInArrow(run, "id bigint, p int, w1 bigint, w2 bigint, lo bigint, hi bigint")


def _texts_by(rows: DataFrame, key: list[str], *more, lo: str = "id", hi: str = "id") -> DataFrame:
    """(key..., _lo, _hi, _n): smallest and largest text and number of rows of each key."""
    return rows.groupBy(*key).agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"), F.count("*").alias("_n"), *more)


def _met(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    total = keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return hot_join(rows, keys, key, "_n", total)


def shared_spans(df: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """(key, span_start, span_end) of the longest stretches of shared characters.

    A character is shared if it lies in ``length`` characters that stand
    unchanged in the text of another key.  Positions count code points from 0.
    Null texts and texts below ``length`` have no spans; a passage repeated in
    one text only is not shared; texts that are equal share all they have.
    """
    plan(length)
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length("text") >= length)
    grams = keep(_anchor_rows(texts, length), "anchors")
    gram, content = ["g1", "g2"], ["c1", "c2"]
    edge = (F.min("c1") != F.max("c1")).alias("_edge")
    common = keep(_texts_by(grams, gram, edge).where("_lo <> _hi").select(*gram, "_n", "_edge"), "grams")
    candidates = _met(asked_for(grams, common, gram), common, gram)
    candidates = keep(candidates.select("id", *content, "first", "last", "_edge"), "candidates")
    inside = candidates.where("not _edge").select("id", "first", "last")
    edges = candidates.where("_edge").drop("_edge")
    contents = keep(_texts_by(edges, content), "contents")
    marked = keep(_met(edges, contents, content).select("id", "first", "last", "_lo", "_hi"), "marked")
    sure = inside.unionByName(marked.where("_lo <> _hi").select("id", "first", "last"))
    sought = marked.where("id = _lo").select("id", "first", "last", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    ranges = keep(sought.groupBy("id").agg(F.collect_list(F.struct("first", "last", "lo", "hi")).alias("ranges")), "ranges")
    windows = keep(_window_rows(asked_for(texts, ranges, ["id"]).join(ranges, "id"), length), "windows")
    shared = keep(_texts_by(windows, ["w1", "w2"], lo="lo", hi="hi").where("_lo <> _hi").select("w1", "w2", "_n"), "shared")
    windows = windows.select("id", "p", "w1", "w2")
    hits = _met(asked_for(windows, shared, ["w1", "w2"]), shared, ["w1", "w2"])
    # Stretches that touch or overlap become one span; a text's are bounded by its length.
    parts = hits.select("id", F.col("p").alias("s"), (F.col("p") + length).alias("e")).unionByName(
        sure.select("id", F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    )
    by = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("_new", F.coalesce(F.col("s") > before, F.lit(True)).cast("int"))
    islands = opened.withColumn("_k", F.sum("_new").over(by))
    spans = islands.groupBy("id", "_k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return spans.select(
        F.col("id").cast(df.schema[key].dataType).alias(key),
        F.col("s").cast("int").alias("span_start"),
        F.col("e").cast("int").alias("span_end"),
    )


def shared_share(df: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every text, null texts with 0 characters."""
    spans = shared_spans(df, key, text, length).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = F.coalesce(F.length(text), F.lit(0))
    shared = F.coalesce(F.col("shared_chars"), F.lit(0))
    return (
        df.select(key, n.alias("n_chars"))
        .join(spans, key, "left")
        .select(key, "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)).alias("share"))
    )
