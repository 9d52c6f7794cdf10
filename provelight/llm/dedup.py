"""Records that differ only in formatting, collapsed to one each.

Every normalized pair of field name and value is hashed; the hashes are combined
by addition, which is commutative, so the order of fields and of map entries is
free and nothing is sorted.  Rows are grouped by that multiset fingerprint, with
counts and smallest ids only (partial sums before the shuffle).  Members of
groups of two or more then meet the row that is kept and are compared field by
field; a row that differs although its fingerprint is equal is grouped again, by
the fields themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight.llm.hot import asked_for, hot_join
from provelight.store import keep

# Characters that do not count.  White space is what Unicode calls so, and U+200B and U+FEFF.
SPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
PUNCTUATION = ".,;:!?'\"()[]{}\u2018\u2019\u201c\u201d`"
#: Rows of one group that one task compares with the row that is kept.
PER_SALT = 100_000


def bare(text: Column) -> Column:
    """Lower case without white space and without punctuation."""
    return F.translate(F.lower(text), SPACE + PUNCTUATION, "")


def _pair_hash(seed: int, name: Column, value: Column) -> tuple[Column, Column]:
    """The hash of one pair, as two halves whose sums cannot overflow."""
    h = F.xxhash64(F.lit(seed), name, value)
    return h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)


def fingerprint(fields: dict[str, Column], maps: dict[str, Column], bits: int = 64) -> list[Column]:
    """Two commutative multiset hashes over all pairs, each as a bigint pair.

    ``fields`` are single values, null counting as a value of its own; ``maps``
    add one pair per entry, so null equals empty.  ``bits`` below 64 weakens the
    hash (to test what happens when fingerprints collide).
    """
    out = []
    for seed in (17, 92821):
        low, high = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for name, value in fields.items():
            tag = F.concat(F.lit(name), F.when(value.isNull(), "?").otherwise("="))
            a, b = _pair_hash(seed, tag, F.coalesce(value.cast("string"), F.lit("")))
            low, high = low + a, high + b
        for name, value in maps.items():
            pairs = F.map_entries(value)
            tag = lambda e, name=name: F.concat(F.lit(name + "."), e["key"], F.when(e["value"].isNull(), "?").otherwise("="))
            part = lambda e, k, s=seed: _pair_hash(s, tag(e), F.coalesce(e["value"], F.lit("")))[k]
            for_half = lambda k, v=pairs: F.coalesce(
                F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, e: acc + part(e, k)), F.lit(0)
            )
            low, high = low + for_half(0), high + for_half(1)
        if bits < 64:
            low, high = low % (1 << (bits // 2)), high % (1 << (bits // 2))
        out += [low, high]
    return out


def _same_map(a: Column, b: Column) -> Column:
    """Equal as sets of entries; null equals empty."""
    a, b = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (a, b))
    inside = F.forall(F.map_entries(a), lambda e: F.map_contains_key(b, e["key"]) & e["value"].eqNullSafe(F.element_at(b, e["key"])))
    return (F.size(a) == F.size(b)) & inside


def dress_copies(
    df: DataFrame, key: str, text: str, fields: Sequence[str], maps: Sequence[str], bits: int = 64
) -> DataFrame:
    """(keep_id, copy_id) of all rows that are one record but for its dress.

    Rows are copies if ``fields`` are equal (null equals null), ``maps`` hold
    the same entries (null equals empty) and the texts are equal in ``bare``
    form.  Rows whose text is null or has nothing left are no copies of any.
    keep_id is the smallest key of a group.
    """
    bared = df.where(F.col(text).isNotNull()).select(key, *fields, *maps, bare(F.col(text)).alias("_bare"))
    rows = bared.where(F.length("_bare") > 0)
    marks = fingerprint({"_bare": F.col("_bare"), **{f: F.col(f) for f in fields}}, {m: F.col(m) for m in maps}, bits)
    prints = [f"_f{i}" for i in range(len(marks))]
    # The one pass over all texts leaves four numbers a row.
    printed = keep(rows.select(F.col(key).alias("_id"), *[m.alias(p) for m, p in zip(marks, prints, strict=True)]), "prints")
    groups = keep(
        printed.groupBy(*prints).agg(F.min("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1"), "groups"
    )
    # A group of any size: its kept row is repeated once for each PER_SALT members.
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    sized = groups.select(*prints, "_keep", F.ceil(F.col("_n") / PER_SALT).cast("int").alias("_s"), "_n")
    members = keep(hot_join(printed, sized, prints, "_n", total).select("_id", "_keep", "_s"), "ids")
    # Texts are fetched for members of groups only (the others do not get to the shuffle), and made bare again once.
    texts = df.select(F.col(key).alias("_id"), F.col(text), *fields, *maps)
    full = asked_for(texts, members, ["_id"]).join(members, "_id")
    full = keep(full.select("_id", "_keep", "_s", bare(F.col(text)).alias("_bare"), *fields, *maps), "members")
    mine = full.where("_id <> _keep").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_s")).cast("int")).drop("_s")
    names = {c: f"_k_{c}" for c in ["_bare", *fields, *maps]}
    kept = (
        full.where("_id = _keep")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .select("_keep", "_salt", *[F.col(c).alias(n) for c, n in names.items()])
    )
    same = F.col("_bare") == F.col("_k__bare")
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(names[f]))
    for m in maps:
        same = same & _same_map(F.col(m), F.col(names[m]))
    met = mine.join(kept, ["_keep", "_salt"]).select("_keep", "_id", same.alias("_same"))
    judged = keep(met, "judged")
    found = judged.where("_same").select(F.col("_keep").alias("keep_id"), F.col("_id").alias("copy_id"))
    strays = judged.where("not _same").select("_id")
    if strays.isEmpty():
        return found
    strays = full.join(strays, "_id")
    # Equal fingerprints of unequal records: group these by the fields themselves.
    entries = [F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))).alias(m) for m in maps]
    exact = strays.select("_id", "_bare", *fields, *entries)
    firsts = exact.groupBy("_bare", *fields, *maps).agg(F.min("_id").alias("keep_id"))
    again = exact.alias("a").join(
        firsts.alias("b"),
        [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["_bare", *fields, *maps]],
    )
    return found.unionByName(again.where("_id <> keep_id").select("keep_id", F.col("_id").alias("copy_id")))
