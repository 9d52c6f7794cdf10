"""Queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight.llm.cutoff import cut_rates, cut_texts
from provelight.llm.dedup import PUNCTUATION, SPACE, dress_copies
from provelight.llm.packing import pack
from provelight.llm.percentiles import parts, percentiles
from provelight.llm.spans import shared_share, shared_spans
from provelight.llm.terms import term_frequencies
from provelight.llm.tokens import encode_corpus, token_counts
from provelight.store import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents, over all cores where the table is one small file."""
    return spread(_read(spark, sf_dir, "documents").select(*columns))


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of proofs and of invented names with its counts and its mark."""
    proofs = spread(_read(spark, sf_dir, "attempts").select(F.col("proof").alias("terms")))
    names = _read(spark, sf_dir, "failure_stats").select(F.col("invented_names").alias("terms"))
    return (
        term_frequencies(proofs)
        .withColumn("field", F.lit("proof"))
        .unionByName(term_frequencies(names).withColumn("field", F.lit("invented_names")))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p2_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "attempts").select("record_id", "task_id", "model", "metadata", "proof"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that are copies of one another but for their dress."""
    return dress_copies(_proofs(spark, sf_dir), "record_id", "proof", ["task_id", "model"], ["metadata"])


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that has copies, with their number."""
    found = p3_found(spark, sf_dir)
    return found.groupBy("keep_id").agg((F.count("*") + 1).alias("n_copies"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, n_copies): one row for each record that remains, 1 for singles.

    A proof that is null or has nothing left is no copy of another: its record remains with 1.
    """
    found = p3_found(spark, sf_dir)
    kept = found.groupBy(F.col("keep_id").alias("record_id")).agg((F.count("*") + 1).alias("n"))
    rest = _read(spark, sf_dir, "attempts").select("record_id").join(found.select(F.col("copy_id").alias("record_id")), "record_id", "left_anti")
    return rest.join(kept, "record_id", "left").select("record_id", F.coalesce("n", F.lit(1)).alias("n_copies"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs and messages.  Equal proofs of one task and equal messages of one attempt are copies."""
    attempts = _read(spark, sf_dir, "attempts").select(
        F.lit("attempts").alias("source_table"), "record_id", F.lit(-1).alias("position"), F.col("model").alias("source"),
        F.col("task_id").alias("origin"), F.col("proof").alias("text"),
    )
    results = _read(spark, sf_dir, "results").select(
        F.lit("results").alias("source_table"), "record_id", F.col("backend").alias("source"), F.col("attempt_id").alias("origin"), F.posexplode("diagnostics").alias("position", "d")
    )
    return spread(attempts).unionByName(spread(results).select("source_table", "record_id", "position", "source", "origin", F.col("d.message").alias("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs and messages that lost their end."""
    return cut_texts(_texts(spark, sf_dir)).select("source_table", "record_id", "position")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's proofs and each backend's messages are cut."""
    return cut_rates(_texts(spark, sf_dir))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each rule flags, at significant lengths and elsewhere."""
    return cut_texts(_texts(spark, sf_dir)).groupBy("source_table", "reason", "at_limit").agg(F.count("*").alias("n"))


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both times per backend, over parts made file by file."""
    runs = parts(_read(spark, sf_dir, "results"), ["backend"], ["wall_time_s", "compile_time_s"])
    found = percentiles(runs, QUANTILES)
    return found.select(F.get_json_object("group", "$.backend").alias("backend"), "metric", "n", "quantile", "value")


def p6_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both times per backend and day of arrival: what the parts say before they are combined."""
    results = _read(spark, sf_dir, "results").withColumn("day", F.date_format("ingested_at", "yyyy-MM-dd"))
    found = percentiles(parts(results, ["backend", "day"], ["wall_time_s", "compile_time_s"]), QUANTILES)
    names = [F.get_json_object("group", f"$.{c}").alias(c) for c in ("backend", "day")]
    return found.select(*names, "metric", "n", "quantile", "value")


def p6_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from parts of separate days, made apart and then united."""
    results = _read(spark, sf_dir, "results").withColumn("odd", F.dayofyear("ingested_at") % 2)
    made = [parts(results.where(F.col("odd") == k), ["backend"], ["wall_time_s", "compile_time_s"]) for k in (0, 1)]
    found = percentiles(made[0].unionByName(made[1]), (0.5,))
    return found.select(F.get_json_object("group", "$.backend").alias("backend"), "metric", "n", "quantile", "value")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(_texts_of(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of a document beyond the capacity, with its container."""
    sizes = token_counts(_texts_of(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", 2048)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of text that stand in another document too."""
    return shared_spans(_texts_of(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    return shared_share(_texts_of(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_copies": p3_copies,
    "p3_collapsed": p3_collapsed,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p5_reasons": p5_reasons,
    "p6_percentiles": p6_percentiles,
    "p6_daily": p6_daily,
    "p6_combined": p6_combined,
    "p7_ids": p7_ids,
    "p8_packed": p8_packed,
    "p9_found": p9_found,
    "p9_share": p9_share,
}


def queries() -> dict:
    return dict(QUERIES)


_TERMS = """with p as (select record_id, list_filter(regexp_split_to_array(proof, '[^A-Za-z0-9_'']+'), lambda x: x <> '') t from attempts where proof is not null),
pt as (select record_id, unnest(t) term from p),
n as (select invented_names m, record_id from failure_stats where invented_names is not null),
nt as (select record_id, unnest(map_keys(m)) term, unnest(map_values(m)) c from n),
c as (select 'proof' field, term, count(*) occurrences, count(distinct record_id) records, (select count(*) from p) total from pt group by term
union all select 'invented_names', term, sum(c)::bigint, count(*), (select count(*) from n) from nt where c is not null and c <> 0 group by term),
m as (select field, term, occurrences, records, case when records < 3 then 'rare' when records > 0.2 * total then 'common' end mark from c)
"""
_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACE)
_MARKS = "'" + PUNCTUATION.replace("'", "''") + "'"
_COPIES = f"""with r as (select record_id, task_id, model,
  translate(lower(proof), {_SPACES} || {_MARKS}, '') b,
  list_sort(map_entries(coalesce(metadata, map {{}}))::varchar[]) m from attempts where proof is not null),
g as (select *, min(record_id) over (partition by task_id, model, b, m) keep_id from r where b <> '')
"""


def _percentiles_sql(quantiles: tuple, day: str = "") -> str:
    rows = ", ".join(f"({q}::double)" for q in quantiles)
    return f"""with v as (select backend, {day} 'wall_time_s' metric, wall_time_s x from results union all select backend, {day} 'compile_time_s', compile_time_s from results),
s as (select * exclude (x), list_sort(list(x)) xs, count(*) n from v where x is not null and not isnan(x) and x >= 0 group by all)
select * exclude (xs, n, quantile),  n, quantile, xs[greatest(1, ceil(round(quantile * n, 9)))::int] "value" from s, (values {rows}) q(quantile)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_percentiles": _percentiles_sql(QUANTILES),
        "p6_daily": _percentiles_sql(QUANTILES, "strftime(ingested_at at time zone 'UTC', '%Y-%m-%d') as \"day\","),
        "p6_combined": _percentiles_sql((0.5,)),
        "p2_found": _TERMS + "select field, term, mark from m where mark is not null",
        "p2_terms": _TERMS + "select field, term, occurrences, records, mark from m",
        "p3_found": _COPIES + "select keep_id, record_id copy_id from g where record_id <> keep_id",
        "p3_copies": _COPIES + "select keep_id, count(*) n_copies from g group by keep_id having count(*) > 1",
    }
