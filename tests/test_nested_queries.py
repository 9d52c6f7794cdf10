"""The entity tables over all sources, wire records included."""

import json

from provelight.plans import nested_queries as Q

CHECKS = "array<struct<kind:string,passed:boolean,detail:string,fatal:boolean>>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,calls:int,estimated_cost_usd:double,model:string>"
RAW = "array<struct<call_id:string,model:string,blocks:array<struct<type:string,body:string>>>>"
JUDGE = f"struct<label:string,reasoning:string,confidence:double,samples:array<string>,aggregation:string,usage:{USAGE},raw:{RAW}>"
DIAGNOSTICS = "array<struct<severity:string,message:string,line:int,column:int,kind:string>>"


def tables(spark, folder):
    judge = ("pass", "r", 0.5, ["a", None, "b"], "vote", (1, 2, 3, 4, 5, 0.25, "m"), [("c0", "m", [None, ("text", "hi")])])
    spark.createDataFrame([(1, [("k", True, "d", False)], judge), (2, None, None)], f"record_id bigint, checks {CHECKS}, judge {JUDGE}").write.parquet(f"{folder}/verdicts.parquet")
    results = [(1, (False, ["v", None]), [None, ("error", "m", 3, 4, "k")]), (2, (None, None), None), (3, None, [])]
    spark.createDataFrame(results, f"record_id bigint, soundness struct<ok:boolean,violations:array<string>>, diagnostics {DIAGNOSTICS}").write.parquet(f"{folder}/results.parquet")
    usage = {"model": "w", "input_tokens": 10, "output_tokens": 20, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 40, "calls": 1, "estimated_cost_usd": 0.5}
    verdict = {"judge": {"raw": [None, {"blocks": {"body": "b", "type": "t"}, "call_id": "c"}], "usage": usage, "samples": "one", "label": "fail"}, "checks": {"kind": "w", "passed": False}}
    payloads = [json.dumps({"record": verdict}), json.dumps({"soundness": {"violations": "x", "ok": True}, "diagnostics": [{"message": "w", "line": 7}]}), "{not json", None]
    spark.createDataFrame(list(enumerate(payloads, 1)), "record_id bigint, payload string").write.parquet(f"{folder}/wire_records.parquet")


def test_tables_hold_every_source_and_field(spark, tmp_path):
    tables(spark, str(tmp_path))
    run = lambda name, *columns: sorted(tuple(r[c] for c in ("source_table", "record_id", "node", *columns)) for r in Q.queries()[name](spark, str(tmp_path)).collect())
    v, r, w = "verdicts", "results", "wire_records"
    assert run("p1_checks", "kind", "passed", "fatal") == [(v, 1, "$.checks[0]", "k", True, False), (w, 1, "$.checks", "w", False, None)]
    assert run("p1_diagnostics", "ordinal", "message", "line") == [(r, 1, "$.diagnostics[1]", 1, "m", 3), (w, 2, "$.diagnostics[0]", 0, "w", 7)]
    assert run("p1_soundness", "ok") == [(r, 1, "$.soundness", False), (r, 2, "$.soundness", None), (w, 2, "$.soundness", True)]
    assert run("p1_violations", "parent", "ordinal", "value") == [(r, 1, "$.soundness.violations[0]", "$.soundness", 0, "v"), (w, 2, "$.soundness.violations", "$.soundness", 0, "x")]
    assert run("p1_judges", "label", "confidence") == [(v, 1, "$.judge", "pass", 0.5), (w, 1, "$.judge", "fail", None)]
    assert run("p1_samples", "ordinal", "value") == [(v, 1, "$.judge.samples[0]", 0, "a"), (v, 1, "$.judge.samples[2]", 2, "b"), (w, 1, "$.judge.samples", 0, "one")]
    fields = list(Q.TABLES["p1_usage"][1])
    assert run("p1_usage", *fields) == [(v, 1, "$.judge.usage", 1, 2, 3, 4, 5, 0.25, "m"), (w, 1, "$.judge.usage", 10, 20, 30, 40, 1, 0.5, "w")]
    assert run("p1_calls", "ordinal", "call_id") == [(v, 1, "$.judge.raw[0]", 0, "c0"), (w, 1, "$.judge.raw[1]", 1, "c")]
    assert run("p1_blocks", "parent_ordinal", "ordinal", "body") == [(v, 1, "$.judge.raw[0].blocks[1]", 0, 1, "hi"), (w, 1, "$.judge.raw[1].blocks", 1, 0, "b")]
