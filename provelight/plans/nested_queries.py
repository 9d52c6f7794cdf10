"""Queries over the nested parts of results, verdicts and wire records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight.operators.nested import entities, shred, shred_json
from provelight.store import spread

#: Objects inside one another that are shredded (a block lies four deep); what is deeper stays JSON text.
MAX_DEPTH = 6
KEYS = ["source_table", "record_id"]
COLUMNS = {"results": ["soundness", "diagnostics"], "verdicts": ["checks", "judge"]}
ARRAYS = ["checks", "diagnostics", "soundness.violations", "judge.samples", "judge.raw", "judge.raw.blocks"]
#: child, label, whether its parent has a place of its own
CHILDREN = [
    ("check", "checks", False),
    ("violation", "soundness.violations", False),
    ("diagnostic", "diagnostics", False),
    ("judge", "judge", False),
    ("sample", "judge.samples", True),
    ("call", "judge.raw", True),
    ("block", "judge.raw.blocks", True),
]
#: Entity tables: the label and its scalar fields.
TABLES = {
    "p1_checks": ("checks", {"kind": "string", "passed": "boolean", "detail": "string", "fatal": "boolean"}),
    "p1_diagnostics": ("diagnostics", {"severity": "string", "message": "string", "line": "int", "column": "int", "kind": "string"}),
    "p1_soundness": ("soundness", {"ok": "boolean"}),
    "p1_violations": ("soundness.violations", {}),
    "p1_judges": ("judge", {"label": "string", "reasoning": "string", "confidence": "double", "aggregation": "string"}),
    "p1_samples": ("judge.samples", {}),
    "p1_usage": (
        "judge.usage",
        {
            "input_tokens": "bigint",
            "output_tokens": "bigint",
            "cache_read_input_tokens": "bigint",
            "cache_creation_input_tokens": "bigint",
            "calls": "int",
            "estimated_cost_usd": "double",
            "model": "string",
        },
    ),
    "p1_calls": ("judge.raw", {"call_id": "string", "model": "string"}),
    "p1_blocks": ("judge.raw.blocks", {"type": "string", "body": "string"}),
}


def adjacency(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("results", "verdicts", "wire_records")) -> DataFrame:
    """The adjacency table of all named tables."""
    out = None
    for name in tables:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        keys = [F.lit(name).alias("source_table"), F.col("record_id")]
        if name == "wire_records":
            part = shred_json(df, keys, "payload", unwrap="record", arrays=ARRAYS, max_depth=MAX_DEPTH)
        else:
            part = shred(spread(df.select("record_id", *COLUMNS[name])), keys, COLUMNS[name])
        out = part if out is None else out.unionByName(part)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child that is not null, with its place and that of its parent.

    The places of the entities of all seven labels, from one pass over the
    adjacency table in which objects meet their scalar children.
    """
    fields = dict(TABLES.values())
    found = entities(adjacency(spark, sf_dir), KEYS, {label: fields[label] for _, label, _ in CHILDREN})
    name = F.create_map(*[F.lit(x) for child, label, _ in CHILDREN for x in (label, child)])[F.col("_label")]
    placed = [label for _, label, up in CHILDREN if up]
    return found.select(
        *KEYS,
        name.alias("child"),
        F.when(F.col("_label").isin(*placed), F.coalesce("parent_ordinal", F.lit(0))).otherwise(-1).alias("parent_position"),
        F.coalesce("ordinal", F.lit(0)).alias("position"),
    )


def _table(query: str):
    label, fields = TABLES[query]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = "results" if label.split(".")[0] in COLUMNS["results"] else "verdicts"
        return entities(adjacency(spark, sf_dir, (typed, "wire_records")), KEYS, {label: fields}).drop("_label")

    run.__doc__ = f"""Entity table of {label} over every source that can hold it.

    One row per value with its source_table, record, node and parent node.
    ``value`` is the text of a value that is no object (a violation, a sample, a
    payload's bare value in place of an object), NULL for objects.
    """
    return run


def queries() -> dict:
    return {"p1_found": p1_found, **{name: _table(name) for name in TABLES}}


_WIRE = """wire as (
  select record_id, case when json_type(p, '$.record') = 'OBJECT' then json_extract(p, '$.record') else p end r
  from (select record_id, case when json_valid(payload) then payload::json end p from wire_records)
  where json_type(p) = 'OBJECT')"""


def _listed(path: str, frm: str = "wire", var: str = "r") -> str:
    return (
        f"case json_type({var}, '{path}') when 'ARRAY' then json_extract({var}, '{path}[*]')"
        f" when 'NULL' then [] else case when json_extract({var}, '{path}') is null then [] else [json_extract({var}, '{path}')] end end"
    )


def _found_sql() -> str:
    out = []

    def typed(table: str, child: str, array: str, parent: str = "-1", frm: str | None = None, where: str = "true") -> None:
        out.append(
            f"select '{table}' source_table, record_id, '{child}' child, {parent}::int parent_position, (i - 1)::int position from "
            f"(select record_id, {array} a, unnest(generate_series(1, len({array}))) i{', up' if parent == 'up' else ''} from {frm or table} where {where})"
            f" where a[i] is not null"
        )

    typed("results", "violation", "soundness.violations")
    typed("results", "diagnostic", "diagnostics")
    typed("verdicts", "check", "checks")
    typed("verdicts", "sample", "judge.samples", "0")
    typed("verdicts", "call", "judge.raw", "0")
    calls = "(select record_id, up, judge.raw[up + 1].blocks b from (select record_id, judge, unnest(generate_series(0, len(judge.raw) - 1)) up from verdicts))"
    typed("verdicts", "block", "b", "up", calls)
    out.append("select 'verdicts', record_id, 'judge', -1, 0 from verdicts where judge is not null")

    def wire(child: str, array: str, parent: str = "-1", frm: str = "wire") -> None:
        up = ", up" if parent == "up" else ""
        out.append(
            f"select 'wire_records', record_id, '{child}', {parent}::int, (i - 1)::int from (select record_id, a, unnest(generate_series(1, len(a))) i{up}"
            f" from (select record_id, {array} a{up} from {frm})) where json_type(a[i]) <> 'NULL'"
        )

    wire("check", _listed("$.checks"))
    wire("violation", _listed("$.soundness.violations"))
    wire("diagnostic", _listed("$.diagnostics"))
    wire("sample", _listed("$.judge.samples"), "0")
    wire("call", _listed("$.judge.raw"), "0")
    each = f"(select record_id, up - 1 as up, a[up] as r from (select record_id, a, unnest(generate_series(1, len(a))) up from (select record_id, {_listed('$.judge.raw')} a from wire)))"
    wire("block", _listed("$.blocks"), "up", each)
    out.append("select 'wire_records', record_id, 'judge', -1, 0 from wire where json_type(r, '$.judge') <> 'NULL'")
    return f"with {_WIRE}\n" + "\nunion all ".join(out)


def _elements(path: str) -> tuple[str, str]:
    """Relations (record_id, node, parent, up, i, e) of the values with a label: of the typed table and of wire_records.

    ``i`` is the position from 0, NULL outside arrays; ``up`` that of the parent.
    """
    table = "results" if path.split(".")[0] in COLUMNS["results"] else "verdicts"
    typed, wire = f"(select record_id, '$' node, null::int i, {table} e from {table})", "(select record_id, '$' node, null::int i, r e from wire)"
    steps, label = path.split("."), ""
    for step in steps:
        label = f"{label}.{step}".lstrip(".")
        if label in ARRAYS:
            typed = f"""(select record_id, node || '.{step}[' || (j - 1) || ']' node, node parent, i up, (j - 1)::int i, a[j] e from
                (select record_id, node, i, e.{step} a, unnest(generate_series(1, len(e.{step}))) j from {typed}) where a[j] is not null)"""
            wire = f"""(select record_id, node || '.{step}' || case when listed then '[' || (j - 1) || ']' else '' end node, node parent, i up, (j - 1)::int i, a[j] e from
                (select *, unnest(generate_series(1, len(a))) j from (select record_id, node, i, json_type(e, '$.{step}') = 'ARRAY' listed, {_listed("$." + step, var="e")} a from {wire}))
                where json_type(a[j]) <> 'NULL')"""
        else:
            typed = f"(select record_id, node || '.{step}' node, node parent, i up, null::int i, e.{step} e from {typed} where e.{step} is not null)"
            wire = f"(select record_id, node || '.{step}' node, node parent, i up, null::int i, json_extract(e, '$.{step}') e from {wire} where json_type(e, '$.{step}') <> 'NULL')"
    return typed, wire


def _table_sql(label: str, fields: dict[str, str]) -> str:
    typed, wire = _elements(label)
    table = "results" if label.split(".")[0] in COLUMNS["results"] else "verdicts"
    place = "record_id, node, parent, up parent_ordinal, i ordinal"
    flat = "case when json_type(e, '$.{0}') not in ('OBJECT', 'ARRAY', 'NULL') then try_cast(json_extract_string(e, '$.{0}') as {1}) end \"{0}\""
    kinds = {"string": "varchar"}
    own = [f'e."{f}" "{f}"' for f in fields]
    theirs = [flat.format(f, kinds.get(k, k)) for f, k in fields.items()]
    bare = "e::varchar" if not fields else "null::varchar"
    return f"""with {_WIRE} select {", ".join([f"'{table}' source_table", place, bare + ' "value"', *own])} from {typed}
        union all select {", ".join(["'wire_records'", place, "case when json_type(e) <> 'OBJECT' then json_extract_string(e, '$') end", *theirs])} from {wire}"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _found_sql(), **{name: _table_sql(*TABLES[name]) for name in TABLES}}
