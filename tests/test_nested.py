import json

from pyspark.sql import functions as F

from provelight.operators.nested import entities, shred, shred_json

SCHEMA = "id bigint, items array<struct<name: string, tags: array<string>, deep: struct<x: int, y: map<string, int>>>>, node string"


def rows_of(spark):
    data = [
        (1, [("a", ["t", None, "t"], (1, {"k": 2})), None, (None, None, None)], "clash"),
        (2, [], None),
        (3, None, "x"),
        (4, [("a", ["t", None, "t"], (1, {"k": 2}))], "clash"),
        (4, [("a", ["t", None, "t"], (1, {"k": 2}))], "clash"),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_shred_keeps_places_and_links(spark):
    got = shred(rows_of(spark).where("id = 1"), ["id"], ["items"]).orderBy("node").collect()
    by = {r["node"]: r for r in got}
    assert set(by) == {
        "$.items[0]", "$.items[0].name", "$.items[0].tags[0]", "$.items[0].tags[2]", "$.items[0].deep", "$.items[0].deep.x",
        "$.items[0].deep.y", "$.items[0].deep.y.k", "$.items[2]",
    }
    assert by["$.items[2]"]["ordinal"] == 2 and by["$.items[2]"]["kind"] == "object"
    assert by["$.items[0].tags[2]"]["parent"] == "$.items[0]" and by["$.items[0].tags[2]"]["parent_ordinal"] == 0
    assert by["$.items[0].deep.y.k"]["scalar"] == "2" and by["$.items[0].deep.y.k"]["label"] == "items.deep.y.k"


def test_shred_of_empty_null_and_repeated(spark):
    df = rows_of(spark)
    assert shred(df.where("id in (2, 3)"), ["id"], ["items"]).count() == 0
    assert shred(df.limit(0), ["id"], ["items"]).count() == 0
    # repeated rows give repeated nodes, and one entity per node of the key
    assert shred(df.where("id = 4"), ["id"], ["items"]).where("node = '$.items[0]'").count() == 2
    assert entities(shred(df.where("id = 4"), ["id"], ["items"]), ["id"], {"items": {"name": "string"}}).count() == 1


def test_entities_pivot_and_cast(spark):
    adj = shred(rows_of(spark).where("id = 1"), ["id"], ["items"])
    got = entities(adj, ["id"], {"items": {"name": "string"}}).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"]) for r in got] == [(0, "a"), (2, None)]
    deep = entities(adj, ["id"], {"items.deep": {"x": "int", "missing": "int"}}).collect()
    assert [(r["x"], r["missing"], r["parent"], r["parent_ordinal"]) for r in deep] == [(1, None, "$.items[0]", 0)]
    tags = entities(adj, ["id"], {"items.tags": {}}).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["value"]) for r in tags] == [(0, "t"), (2, "t")]


def test_maps_of_objects(spark):
    df = spark.createDataFrame([(1, {"k": (5, ["a", None]), "l": None})], "id int, m map<string, struct<x: int, tags: array<string>>>")
    got = {(r["node"], r["label"], r["scalar"]) for r in shred(df, ["id"], ["m"]).collect()}
    assert got == {("$.m", "m", None), ("$.m.k", "m.k", None), ("$.m.k.x", "m.k.x", "5"), ("$.m.k.tags[0]", "m.k.tags", "a")}


def brute(value, arrays, label="", node="$", parent=None, depth=7):
    """Adjacency rows of a parsed value, as (node, parent, label, ordinal, kind)."""
    out = []
    items = [(x, f"{node}[{i}]", i) for i, x in enumerate(value)] if isinstance(value, list) else [(value, node, 0 if label in arrays else None)]
    for x, n, o in items:
        if x is None:
            continue
        out.append((n, parent, label, o, "object" if isinstance(x, dict) else "scalar"))
        if isinstance(x, dict):
            for k, v in x.items():
                out += brute(v, arrays, f"{label}.{k}" if label else k, f"{n}.{k}", n, depth - 1)
    return out


def test_shred_json_equals_brute_force(spark):
    texts = [
        '{"a": 1} x', '{"a": 1, "a": 2}', "[1]", "null", "", None, '{"a": 1}}', '{"a": 1}]', '{"a": 1},{"b": 2}', '{"a": 1', ' {"a": "s", "d": null}\n',
        '{"record": {"a": {"q": []}}}', '{"record": 5, "a": [null, {"b": [1, {"c": true}]}]}', '{"a": [[1, 2], 3]}', '{"x": {"y": {"z": {"w": [1.5, "t"]}}}}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    got = shred_json(df, ["id"], "p", unwrap="record", arrays=["a"])
    have = sorted((r["id"], r["node"], r["parent"], r["label"], r["ordinal"], r["kind"]) for r in got.where("node not like '%[%[%'").collect())
    want = []
    for i, text in enumerate(texts):
        try:
            value = json.loads(text, object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else None)
        except (TypeError, ValueError):
            continue
        if isinstance(value, dict):
            value = value["record"] if isinstance(value.get("record"), dict) else value
            want += [(i, *r) for r in brute(value, ["a"]) if r[0] != "$" and r[0].count("[") < 2]
    assert [h for h in have if h[0] != 13] == sorted(w for w in want if w[0] != 13)


def test_json_deeper_than_the_bound_stays_as_text(spark):
    text = '{"a": ' * 5 + "1" + "}" * 5
    df = spark.createDataFrame([(1, text)], "id int, p string")
    got = shred_json(df, ["id"], "p", max_depth=3).orderBy(F.length("node").desc()).first()
    assert got["scalar"] == '{"a":{"a":1}}' and got["kind"] == "scalar"
