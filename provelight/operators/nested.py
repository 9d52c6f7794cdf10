"""Deeply nested records as an adjacency table and as flat entity tables.

``shred`` (typed columns) and ``shred_json`` (JSON text) turn every record into
rows of one adjacency table

    record keys..., node, parent, label, ordinal, parent_ordinal, kind, scalar

``node``            path of the value inside its record, unique in the record
``parent``          node of the object the value belongs to (``$`` for the record)
``label``           field path without positions, e.g. ``judge.raw.blocks``
``ordinal``         position in the array that holds the value, NULL outside arrays
``parent_ordinal``  ordinal of the parent object, NULL where it has none
``kind``            ``object`` or ``scalar``
``scalar``          the value as text, NULL for objects

Arrays are edges, not nodes: their elements hang on the object that owns the
array.  Null values and null elements give no row, but null elements keep their
place in the ordinals.  An empty object gives its own row and no children.

``entities`` joins object nodes with their scalar children and pivots the
children into columns, for any number of labels in one pass.  All nodes of a record are made from one row in one task,
so object row and scalar children meet in the map-side half of one hash
aggregate keyed on the object's node, and only finished entity rows are
shuffled; no node row ever is.  Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "$"
NODE = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("parent_ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
    ]
)


def _none() -> Column:
    return F.lit(None).cast("int")


def _empty() -> Column:
    return F.array().cast(T.ArrayType(NODE))


def _one(node: Column, parent: Column, label: Column, ordinal: Column, up: Column, kind: str, scalar: Column) -> Column:
    return F.array(
        F.struct(
            node.alias("node"),
            parent.alias("parent"),
            label.alias("label"),
            ordinal.alias("ordinal"),
            up.alias("parent_ordinal"),
            F.lit(kind).alias("kind"),
            scalar.cast("string").alias("scalar"),
        )
    ).cast(T.ArrayType(NODE))


def _text(value: Column, dtype: T.DataType) -> Column:
    return F.base64(value) if isinstance(dtype, T.BinaryType) else value.cast("string")


def _typed(value: Column, dtype: T.DataType, node: Column, parent: Column, label: str, ordinal: Column, up: Column) -> Column:
    """The nodes of one typed value, itself included, as an array."""
    if isinstance(dtype, T.StructType):
        own = _one(node, parent, F.lit(label), ordinal, up, "object", F.lit(None))
        parts = [own]
        for f in dtype.fields:
            child = F.concat(node, F.lit("." + f.name))
            parts.append(_typed(value[f.name], f.dataType, child, node, f"{label}.{f.name}", _none(), ordinal))
        return F.when(value.isNotNull(), F.concat(*parts)).otherwise(_empty())
    if isinstance(dtype, T.ArrayType):
        each = lambda x, i: _typed(
            x, dtype.elementType, F.concat(node, F.lit("["), i.cast("string"), F.lit("]")), parent, label, i.cast("int"), up
        )
        return F.coalesce(F.flatten(F.transform(value, each)), _empty())
    if isinstance(dtype, T.MapType):
        own = _one(node, parent, F.lit(label), ordinal, up, "object", F.lit(None))

        def entry(e: Column) -> Column:
            key = e["key"].cast("string")
            inner = _typed(e["value"], dtype.valueType, F.concat(node, F.lit("."), key), node, f"{label}.*", _none(), ordinal)
            below = lambda n: F.substring(n["label"], len(label) + 3, 1 << 30)
            return F.transform(inner, lambda n: n.withField("label", F.concat(F.lit(label + "."), key, below(n))))

        return F.when(
            value.isNotNull(), F.concat(own, F.flatten(F.transform(F.map_entries(value), entry)))
        ).otherwise(_empty())
    return F.when(
        value.isNotNull(), _one(node, parent, F.lit(label), ordinal, up, "scalar", _text(value, dtype))
    ).otherwise(_empty())


def _exploded(df: DataFrame, keys: Sequence[str | Column], nodes: Column) -> DataFrame:
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.select(*keys, F.explode(nodes).alias("_n")).select("*", "_n.*").drop("_n")


def shred(df: DataFrame, keys: Sequence[str | Column], columns: Iterable[str]) -> DataFrame:
    """Adjacency rows of the given typed columns; ``keys`` identify the record.

    Only the keys and the given columns are read, so a scan below is pruned to
    them.  A record whose columns are all null has no rows.
    """
    root = F.lit(ROOT)
    parts = []
    for name in columns:
        dtype = df.schema[name].dataType
        parts.append(_typed(F.col(f"`{name}`"), dtype, F.lit(f"{ROOT}.{name}"), root, name, _none(), _none()))
    return _exploded(df, keys, F.concat(*parts))


def _variant(value: Column, node: Column, parent: Column, label: Column, up: Column, arrays: Sequence[str], depth: int) -> Column:
    """The nodes of one variant value; below ``depth`` the rest stays JSON text."""
    as_array = F.try_variant_get(value, "$", "array<variant>")
    scalar = lambda v, n, o: _one(n, parent, label, o, up, "scalar", v)
    alone = F.when(label.isin(*arrays), F.lit(0)).otherwise(_none()) if arrays else _none()

    def item(v: Column, n: Column, o: Column) -> Column:
        null = v.isNull() | F.is_variant_null(v)
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        if depth == 0:
            return F.when(null, _empty()).otherwise(scalar(_json_text(v), n, o))
        own = _one(n, parent, label, o, up, "object", F.lit(None))
        prefix = F.when(label == "", F.lit("")).otherwise(F.concat(label, F.lit(".")))
        below = F.flatten(
            F.transform(
                F.map_entries(fields),
                lambda e: _variant(
                    e["value"], F.concat(n, F.lit("."), e["key"]), n, F.concat(prefix, e["key"]), o, arrays, depth - 1
                ),
            )
        )
        return F.when(null, _empty()).when(fields.isNotNull(), F.concat(own, below)).otherwise(scalar(_json_text(v), n, o))

    # One expression for both shapes, so that its size stays linear in the depth.
    place = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
    return F.flatten(
        F.transform(
            F.coalesce(as_array, F.array(value)),
            lambda x, i: item(
                x,
                F.when(as_array.isNotNull(), F.concat(node, place(i))).otherwise(node),
                F.when(as_array.isNotNull(), i.cast("int")).otherwise(alone),
            ),
        )
    )


def _json_text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def json_object(text: Column) -> Column:
    """The one JSON object the text consists of, as a variant; else NULL.

    The parser reads the first value of a text and ignores what follows.  So the
    text is parsed twice more, inside an array and inside an object: whatever
    may follow a value in the one is an error in the other, but for a comma,
    which makes the array longer than one.
    """
    value = F.try_parse_json(text)
    in_array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    is_object = F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
    return F.when(is_object & (F.size(in_array) == 1) & in_object.isNotNull(), value)


def shred_json(
    df: DataFrame, keys: Sequence[str | Column], payload: str, unwrap: str | None = None, arrays: Sequence[str] = (), max_depth: int = 7
) -> DataFrame:
    """Adjacency rows of the JSON objects in a text column.

    Text that is not exactly one JSON object gives no rows.  With ``unwrap`` the
    record is the object under that field, where there is one.  ``arrays`` are
    labels whose value counts as an array of one where it is not an array.
    Values nested deeper than ``max_depth`` objects are kept as JSON text.
    """
    held = df.select(*keys, json_object(F.col(payload)).alias("_v"))
    keep = [F.col(f"`{c}`") for c in held.columns[:-1]]
    if unwrap:
        inner = F.try_variant_get("_v", f"$.{unwrap}", "variant")
        inside = F.try_variant_get(inner, "$", "map<string,variant>").isNotNull()
        held = held.select(*keep, F.when(inside, inner).otherwise(F.col("_v")).alias("_v"))
    nodes = _variant(F.col("_v"), F.lit(ROOT), F.lit(None).cast("string"), F.lit(""), _none(), tuple(arrays), max_depth)
    return _exploded(held.where("_v is not null"), keep, nodes).where(F.col("node") != ROOT)


def entities(adjacency: DataFrame, keys: Sequence[str], tables: dict[str, dict[str, str]]) -> DataFrame:
    """One row per value with one of the labels of ``tables``, its scalar children as columns.

    ``tables`` maps each label to its fields, and these to the SQL type of the
    output column (one name has one type); a value that cannot be cast is NULL, as
    are the fields of other labels.  Scalar elements (an array of strings) come
    out with their own text in ``value`` and NULL children.  A field that is an
    array of scalars gives its greatest text.
    """
    children = {f"{label}.{name}": name for label, fields in tables.items() for name in fields}
    kinds = {name: kind for fields in tables.values() for name, kind in fields.items()}
    wanted = adjacency.where(F.col("label").isin(*tables, *children))
    own = F.col("label").isin(*tables)
    entity = F.when(own, F.col("node")).otherwise(F.col("parent"))
    child = lambda name: F.max(F.when(F.col("label").isin(*[p for p, n in children.items() if n == name]), F.col("scalar")))
    mine = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    return (
        wanted.groupBy(*keys, entity.alias("_node"))
        .agg(
            *[mine(c) for c in ("label", "parent", "parent_ordinal", "ordinal")],
            F.max(F.when(own, F.col("scalar"))).alias("value"),
            *[child(name).alias("_c_" + name) for name in kinds],
        )
        .where("label is not null")
        .select(
            *keys,
            F.col("label").alias("_label"),
            F.col("_node").alias("node"),
            "parent",
            "parent_ordinal",
            "ordinal",
            "value",
            *[F.expr(f"try_cast(`_c_{name}` as {kind})").alias(name) for name, kind in kinds.items()],
        )
    )
