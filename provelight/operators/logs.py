"""Log streams of several programs, parsed into entries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provelight.functions.logscan import entries

FIELDS = "stream string, line_no int, ts_ms bigint, level string, component string, message string"
#: Rows a worker hands back at once; bounds the memory one long stream can take.
CHUNK = 5000


def parse_logs(df: DataFrame, key: str, streams: Sequence[str], started_at: str) -> DataFrame:
    """One row per log entry of the given text columns.

    Columns: the key, stream, line_no (from 1), ts_ms (-1 where the head has no
    time), level, component, message (continuation lines attached, joined by
    line feeds).  Null, empty and headless streams give no rows.  A time without
    a year takes that of ``started_at`` (1970 where that is null).

    Every stream is parsed where it is read: no shuffle, and only the named
    columns are scanned.
    """
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, year, *texts in batch.itertuples(index=False, name=None):
                for stream, text in zip(streams, texts, strict=True):
                    if text:
                        rows.extend((ident, stream, *entry) for entry in entries(text, int(year)))
                if len(rows) >= CHUNK:
                    yield pd.DataFrame(rows, columns=[key, *names])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[key, *names])

    year = F.coalesce(F.year(started_at), F.lit(1970))
    return df.select(key, year.alias("_year"), *streams).mapInPandas(run, f"`{key}` {kind}, {FIELDS}")
