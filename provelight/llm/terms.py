"""How often every distinct term occurs, and in how many records.

Heavy-light aggregation.  A first pass over a sample finds the heavy terms; the
list only steers where a term is counted, never what is counted, and holds at
most ``HEAVY`` terms, so it can be broadcast.  Then every task walks its records
once: heavy terms go into exact local counter arrays (one slot per term), all
others leave the task as rows and are aggregated by term through a shuffle.  The
arrays come out as one row per task and heavy term and are summed; both tables
are united.  A term that is in a third of all records costs each task one slot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the local counter arrays, and the most terms that are broadcast.
HEAVY = 2048
#: Rows of the sample that finds the heavy terms (expected number).
SAMPLE_ROWS = 20_000
#: Light terms a task holds before it hands their partial counts on.
HELD = 200_000

WORD = "[A-Za-z0-9_']+"


def _is_map(records: DataFrame) -> bool:
    return dict(records.dtypes)["terms"].startswith("map")


def heavy_terms(records: DataFrame, n_records: int, most: int = HEAVY, seed: int = 7) -> list[str]:
    """The terms in most records of a sample of about ``SAMPLE_ROWS`` records."""
    sample = records if n_records <= SAMPLE_ROWS else records.sample(SAMPLE_ROWS / n_records, seed)
    terms = F.map_keys("terms") if _is_map(records) else F.array_distinct(F.regexp_extract_all("terms", F.lit(WORD), F.lit(0)))
    rows = sample.select(F.explode(terms).alias("term"))
    top = rows.groupBy("term").count().where("count > 1").orderBy(F.desc("count"), "term").limit(most)
    return [r["term"] for r in top.collect()]


def count_terms(records: DataFrame, heavy: list[str]) -> DataFrame:
    """Counts of every term: (term, occurrences, records).

    ``records`` has a column ``terms``: a text, whose terms are its longest runs
    of ``WORD`` characters in the letter case they have, or a map from a term to
    its count in the record.  Null records, null or zero counts are no
    occurrences.
    """
    import pyarrow as pa

    slots = {t: i for i, t in enumerate(heavy)}
    known = records.sparkSession.sparkContext.broadcast(slots)
    as_map = _is_map(records)
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def rows(terms: list, occurrences: list, n_records: list) -> pa.RecordBatch:
        columns = zip(schema, (terms, occurrences, n_records), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_of = known.value
        split = re.compile(WORD, re.ASCII).findall
        heavy_occ, heavy_rec = [0] * len(slot_of), [0] * len(slot_of)
        light_occ: dict[str, int] = {}
        light_rec: dict[str, int] = {}
        find, occ, rec = slot_of.get, light_occ.get, light_rec.get
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                if not terms:
                    continue
                pairs = terms if as_map else Counter(split(terms)).items()
                for term, n in pairs:
                    if not n or term is None:
                        continue
                    at = find(term)
                    if at is not None:
                        heavy_occ[at] += n
                        heavy_rec[at] += 1
                    else:
                        light_occ[term] = occ(term, 0) + n
                        light_rec[term] = rec(term, 0) + 1
                if len(light_occ) > HELD:
                    yield rows(list(light_occ), list(light_occ.values()), list(light_rec.values()))
                    light_occ.clear()
                    light_rec.clear()
        if light_occ:
            yield rows(list(light_occ), list(light_occ.values()), list(light_rec.values()))
        used = [(t, i) for t, i in slot_of.items() if heavy_rec[i]]
        yield rows([t for t, _ in used], [heavy_occ[i] for _, i in used], [heavy_rec[i] for _, i in used])

    counted = records.select("terms").mapInArrow(run, "term string, occurrences bigint, records bigint")
    # Both tables leave the tasks as one and share an exchange: a heavy term has
    # one row per task in it, a light one a row per time a task handed it on.
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(records: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """(term, occurrences, records, mark) of every term in the ``terms`` column.

    mark is ``rare`` for a term in fewer than ``rare_below`` records, ``common``
    for one in more than ``common_above`` of the records that are not null, else
    NULL; rare goes first.  Empty records count as records.
    """
    held = records.where("terms is not null")
    n = held.count()
    counts = count_terms(held, heavy_terms(held, n))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n, "common")
    return counts.withColumn("mark", mark)
