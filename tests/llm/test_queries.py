"""The llm queries on the smallest driver tables, against SQL or against plain Python."""

import math
import sys
from collections import Counter
from pathlib import Path

import pytest

from provelight.llm import queries as Q
from provelight.llm.tokens import encoder

sys.path.insert(0, str(Path(__file__).parent))
from test_llm import brute_spans  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="driver tables are not here")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got = Q.queries()[name](spark, str(DATA))
    twin = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == sorted(got.columns)
    left = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect())
    assert left == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in twin.fetchall())


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text").collect()]


def test_token_ids(spark, documents):
    encode = encoder().encode_ordinary
    got = {r["doc_id"]: list(r["ids"]) for r in Q.p7_ids(spark, str(DATA)).collect()}
    assert got == {i: encode(t) if t else [] for i, t in documents}


def test_packing(spark, documents):
    encode = encoder().encode_ordinary
    rows = Q.p8_packed(spark, str(DATA)).collect()
    units, fill = Counter(), Counter()
    for r in rows:
        units[r["doc_id"]] += r["n_units"]
        if r["container"] is not None:
            fill[r["container"]] += r["n_units"]
    assert units == Counter({i: len(encode(t)) if t else 0 for i, t in documents}) and max(fill.values()) <= 2048


def test_spans(spark, documents):
    assert {tuple(r) for r in Q.p9_found(spark, str(DATA)).collect()} == brute_spans(documents, 240)
    assert Q.p9_share(spark, str(DATA)).count() == len(documents)


def test_cut_rates_sum_up(spark):
    found = Q.p5_found(spark, str(DATA)).count()
    assert sum(r["n_cut"] for r in Q.p5_rates(spark, str(DATA)).collect()) == found


def test_collapsed_attempts_are_whole(spark, tmp_path):
    rows = [(1, "t", "m", None, "a b"), (2, "t", "m", None, "A (b)"), (3, "t", "m", None, "c"), (4, "t", "m", None, None), (5, "t", "m", None, " ")]
    schema = "record_id bigint, task_id string, model string, metadata map<string,string>, proof string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/attempts.parquet")
    assert {tuple(r) for r in Q.queries()["p3_collapsed"](spark, str(tmp_path)).collect()} == {(1, 2), (3, 1), (4, 1), (5, 1)}
