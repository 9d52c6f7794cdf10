"""Texts that lost their end, and how often each source loses it.

Discrete hazards decide: how many of the texts that reach a point end there, tested
against what the neighbouring points lead one to expect.

* **Lengths.**  Per source, and for lengths in characters and in UTF-8 bytes, the
  hazard of each length is computed with window functions and tested against the
  pooled hazard of the lengths near it; a Benjamini-Hochberg bound keeps the share
  of false discoveries below ``ALPHA``.  Copies of one text count once.  A text
  whose length is significant and whose ending is incomplete is cut by a limit
  (``at_limit``).  If most texts that reach a significant length end there, most of
  them incomplete, the whole-looking ones of that length are flagged, too
  (``limit``), where they outnumber twice what the neighbours lead one to expect.
* **Endings.**  An ending is incomplete if the hazard of a line end at this point of
  the line, names and numbers masked, is tiny (``goes_on``), if the hazard of a text
  end behind this line is tiny (``seldom``), if its last word is nearly always the
  beginning of a longer one (``word``), if it leaves a fence open that opened the
  text (``fence``), or if it carries a sign put in place of the rest, unless lines
  like this one regularly do (``sign``).  An incomplete ending away from every
  significant length is a text lost in mid-transfer; it is flagged, too, with
  ``at_limit`` false.

Evidence is counted over pieces.  A piece is a text of one origin: what is delivered
again or copied within its origin is no evidence for itself, while a message that
many origins bring forth on their own is.  Without an origin every distinct text is
one piece.

Rates decide, but only with a minimum support: a line or word is known from ``KNOWN``
occurrences and ``seldom`` needs ``SEEN``, so the same rates at another size can give
other flags.  Texts are passed over once; what later steps read are their masked
lines, their words and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provelight.llm.hot import asked, asked_for, hot_join
from provelight.store import keep

#: False-discovery rate of the length tests; lengths on either side that are compared.
ALPHA, NEAR = 0.01, 25
#: A line shape is known from so many occurrences.
KNOWN = 3
#: A line that goes on in more than this share of its occurrences is a beginning, not a line.
GOES_ON = 0.9
#: A known line that is last in a smaller share of its occurrences is no ending.
SELDOM_LAST, SEEN = 0.02, 40
#: A word that ends more than this share of all texts regularly ends texts.
REGULAR = 0.0005
#: Of the texts that reach a limit so many end there, and so many of these incomplete.
MOSTLY = 0.5

# Signs of a lost end.
SIGNS = [
    "…", "...", "[...]", "[…]", "(...)", "(…)", "<...>", "[truncated]", "(truncated)", "<truncated>",
    "[cut]", "[snip]", "(more)", "[output truncated]", "...(truncated)", "…(truncated)", "[clipped]", "<snip>",
]
_SPACES = "".join(map(chr, [9, 11, 12, 13, *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_BLANK = _SPACES + "\n"
_PUNCTUATION = ".,;:!?'\"()[]{}\u2018\u2019\u201c\u201d`"
_SIGN = "(?:" + "|".join(
    "".join("\\" + c if c in ".[]()<>" else c for c in s) for s in sorted(SIGNS, key=len, reverse=True)
) + ")$"


def _shapes(text: Column) -> Column:
    """The non-blank lines of a lower-case text, names and numbers masked, without white space."""
    named = F.regexp_replace(text, "\\p{L}[\\p{L}\\p{N}']*+(?:[._]++[\\p{L}\\p{N}_]++)++", "q")
    bare = F.translate(named, "123456789" + _SPACES, "000000000")
    return F.filter(F.split(F.regexp_replace(bare, "00++", "0"), "\n"), lambda line: line != "")


def _endings(texts: DataFrame) -> DataFrame:
    """What is known of each text that is not blank: its lines, its words, its last line and its last word.

    The filter looks at the raw text and the steps below it are separate
    projections, so each pass over a text is made once.
    """
    full = texts.where(F.col("text").rlike(f"[^{_BLANK}]"))
    low = full.select("*", F.rtrim(F.lower("text"), F.lit(_BLANK)).alias("_t"))
    held = low.select(
        "*",
        _shapes(F.col("_t")).alias("_lines"),
        F.reverse(F.regexp_extract(F.reverse("_t"), "^[\\p{L}\\p{N}_.]+", 0)).alias("word"),
        F.xxhash64(F.translate("_t", _BLANK + _PUNCTUATION, "")).alias("same"),
    )
    before = F.when(F.size("_lines") > 1, F.element_at("_lines", -2)).otherwise("")
    fences = (F.length("_t") - F.length(F.replace("_t", F.lit("```"), F.lit("")))) / 3
    inside = F.left("_t", F.length("_t") - F.length("word"))
    return held.select(
        "source_table",
        "record_id",
        "position",
        "source",
        F.xxhash64("record_id", "position").alias("_row"),
        F.xxhash64("same", "origin").alias("piece"),
        "_lines",
        F.array_distinct(F.split(inside, "[^\\p{L}\\p{N}_.]++")).alias("_words"),
        F.element_at("_lines", -1).alias("shape"),
        F.xxhash64(before).alias("ctx"),
        "word",
        F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"),
        "same",
        ((fences % 2 == 1) & F.col("_t").startswith("```")).alias("fence"),
    )


def _again(ends: DataFrame) -> DataFrame:
    """(source_table, _row) of every row but one of each piece."""
    slim = ends.select("source_table", "piece", "_row")
    pieces = slim.groupBy("source_table", "piece").agg(F.min("_row").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    pieces = keep(pieces, "pieces")
    total = pieces.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    key = ["source_table", "piece"]
    return hot_join(asked_for(slim, pieces, key), pieces, key, "_n", total).where("_row <> _keep").select("source_table", "_row")


def _firsts(ends: DataFrame, again: DataFrame, *columns: str) -> DataFrame:
    """Columns of all rows, with ``first``: true for one row of each piece.  Only what may be a copy is shuffled."""
    key = ["source_table", "_row"]
    rows = asked(ends.select(*key, *columns), again, key)
    alone = rows.where("not _asked").withColumn("first", F.lit(True))
    rest = rows.where("_asked").join(again.withColumn("_copy", F.lit(True)), key, "left").withColumn("first", F.col("_copy").isNull())
    return alone.unionByName(rest.drop("_copy")).drop("_asked", "_row")


def _shape_table(ends: DataFrame, again: DataFrame) -> DataFrame:
    """(source_table, ctx, shape, fin, inner, rows): how often each line stands last and elsewhere.

    fin and inner count a piece once, and a last line at least once; rows counts every text that ends so.
    """
    inner = F.slice("_lines", F.lit(1), F.size("_lines") - 1)
    each = F.transform(
        inner,
        lambda s, i: F.struct(
            F.xxhash64(F.when(i > 0, F.get(F.col("_lines"), i - 1)).otherwise("")).alias("ctx"), s.alias("shape")
        ),
    )
    lines = _firsts(ends, again, "_lines").where("first").select("source_table", F.explode(each).alias("l")).select("source_table", "l.*")
    key = ["source_table", "ctx", "shape"]
    zero = F.lit(0).cast("bigint")
    lines = lines.groupBy(*key).agg(F.count("*").alias("inner")).withColumns({"fin": zero, "rows": zero})
    return lines.unionByName(_last_ones(ends, again, ["ctx", "shape"]).withColumn("inner", zero)).groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("fin", "inner", "rows")]
    )


def _last_ones(ends: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """(source_table, key..., fin, rows): pieces (one at least) and rows that end so."""
    each = _firsts(ends, again, *key).groupBy("source_table", *key)
    return each.agg(F.greatest(F.lit(1), F.sum(F.col("first").cast("bigint"))).alias("fin"), F.count("*").alias("rows"))


def _level(length: Column) -> Column:
    """The largest power of 8 up to a length of at least 1."""
    return F.call_function("shiftleft", F.lit(1), (F.floor((F.length(F.bin(length)) - 1) / 3) * 3).cast("int"))


def _longer(known: DataFrame, probes: DataFrame, key: list[str]) -> DataFrame:
    """(key..., p, ext): occurrences ``n`` of known texts that go on behind a probe; ``p`` is the probe's hash.

    Prefixes are taken only at lengths that probes have.  A ladder finds these: a
    probe is filed under its first 1, 8, 64, ... characters, as many as it has, and
    a known text looks only there, so it is hashed a few times, not once per
    character.
    """
    step = [*key, "c", "h"]
    head = lambda text, c: F.xxhash64(F.substring(F.col(text), F.lit(1), F.col(c)))
    filed = probes.where(F.length("text") > 0).withColumn("c", _level(F.length("text")))
    filed = filed.select(*key, "c", head("text", "c").alias("h"), F.length("text").alias("k"))
    filed = keep(filed.groupBy(*step).agg(F.collect_set("k").alias("ks")), "ladder")
    top = (F.length(F.bin(F.length("text") - 1)) - 1) / 3
    rungs = F.transform(F.sequence(F.lit(0), F.floor(top).cast("int")), lambda i: F.call_function("shiftleft", F.lit(1), i * 3))
    heads = known.where(F.length("text") > 1).select(*key, "n", "text", F.explode(rungs).alias("c")).withColumn("h", head("text", "c"))
    heads = keep(asked_for(heads, filed, step), "heads")
    sizes = heads.groupBy(*step).agg(F.count("*").alias("_n"))
    met = hot_join(heads, filed.join(sizes, step), step, "_n", heads.count())
    ends = F.transform(F.filter("ks", lambda k: k < F.length("text")), lambda k: F.xxhash64(F.substring(F.col("text"), F.lit(1), k)))
    return met.select(*key, "n", F.explode(ends).alias("p")).groupBy(*key, "p").agg(F.sum("n").alias("ext"))


def _broken_lines(shapes: DataFrame) -> DataFrame:
    """(source_table, ctx, shape, rows, broken) of every last line that is incomplete."""
    full = F.col("fin") + F.col("inner")
    alone = keep(shapes.groupBy("source_table", "shape").agg(*[F.sum(c).alias(c) for c in ("fin", "inner")]), "lines")
    finals = alone.where("fin > 0").withColumn("text", F.regexp_replace("shape", _SIGN, ""))
    finals = finals.withColumn("_signed", F.col("text") != F.col("shape")).withColumn("p", F.xxhash64("text"))
    known = alone.where(full >= KNOWN).select("source_table", F.col("shape").alias("text"), full.alias("n"))
    longer = _longer(known, finals.select("source_table", "text"), ["source_table"])
    judged = finals.drop("text").join(longer, ["source_table", "p"], "left").withColumn("ext", F.coalesce("ext", F.lit(0)))
    # With a sign, what goes on behind the base includes the line itself where it is known.
    regular = F.col("_signed") & (full >= KNOWN) & (full >= (1 - GOES_ON) * F.col("ext"))
    goes_on = ~F.col("_signed") & (F.col("ext") > GOES_ON * (full + F.col("ext")))
    seldom = (F.col("inner") >= SEEN) & (F.col("fin") < SELDOM_LAST * full)
    kind = F.when(F.col("_signed") & ~regular, "sign").when(goes_on, "goes_on").when(seldom, "seldom")
    judged = keep(judged.select("source_table", "shape", kind.alias("kind")).where("kind is not null"), "kinds")
    # A line that goes on elsewhere may be whole behind this line: the same test in context.
    key = ["source_table", "ctx"]
    near = asked_for(shapes.where("rows > 0"), judged, ["source_table", "shape"]).join(judged, ["source_table", "shape"])
    near = keep(near.withColumn("p", F.xxhash64("shape")), "near")
    unsure = near.where("kind = 'goes_on'").select(*key, F.col("shape").alias("text"))
    here = asked_for(shapes.where(full >= KNOWN), unsure, key).select(*key, F.col("shape").alias("text"), full.alias("n"))
    near = near.join(_longer(here, unsure, key), [*key, "p"], "left").withColumn("ext", F.coalesce("ext", F.lit(0)))
    whole_here = (full >= KNOWN) & (F.col("ext") <= GOES_ON * (full + F.col("ext"))) & (F.col("fin") >= SELDOM_LAST * full)
    broken = F.when((F.col("kind") == "goes_on") & whole_here, None).otherwise(F.col("kind"))
    return near.select(*key, "shape", "rows", broken.alias("broken")).where("broken is not null")


def _torn_words(ends: DataFrame, again: DataFrame) -> DataFrame:
    """(source_table, word, rows) of every last word that is nearly always the beginning of a longer one.

    A word without a letter (a number, a full stop on its own) is never torn, nor
    is one that ends more than ``REGULAR`` of all other texts.
    """
    key = ["source_table", "word"]
    words = _firsts(ends, again, "_words").where("first")
    whole = words.select("source_table", F.explode("_words").alias("word")).where("word <> ''").groupBy(*key).agg(F.count("*").alias("whole"))
    whole = keep(whole, "vocabulary")
    last = keep(_last_ones(ends, again, ["word"]).where(F.col("word").rlike("\\p{L}")), "last_words")
    known = whole.where(F.col("whole") >= KNOWN).select("source_table", F.col("word").alias("text"), F.col("whole").alias("n"))
    longer = _longer(known, last.select("source_table", F.col("word").alias("text")), ["source_table"])
    n_texts = F.broadcast(words.groupBy("source_table").agg(F.count("*").alias("_texts")))
    both = last.join(asked_for(whole, last, key), key, "left").withColumn("p", F.xxhash64("word"))
    both = both.join(longer, ["source_table", "p"]).join(n_texts, "source_table")
    full = F.col("fin") + F.coalesce("whole", F.lit(0))
    torn = (F.col("ext") > GOES_ON * (full + F.col("ext"))) & (F.col("fin") - 1 < REGULAR * F.col("_texts"))
    return both.where(torn).select(*key, "rows")


def length_limits(lengths: DataFrame, alpha: float = ALPHA, near: int = NEAR) -> DataFrame:
    """Significant lengths: (source_table, source, unit, len, n, reach, expected, p).

    ``lengths`` has (source_table, source, unit, len, n), n distinct texts.  The
    hazard of a length is tested against the pooled hazard of the lengths up to
    ``near`` away on either side, by a Chernoff bound of the Poisson tail.
    """
    by = Window.partitionBy("source_table", "source", "unit")
    reach = F.sum("n").over(by.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0))
    held = lengths.withColumn("reach", reach)
    around = by.orderBy("len").rangeBetween(-near, near)
    n_near = F.sum("n").over(around) - F.col("n")
    reach_near = F.sum("reach").over(around) - F.col("reach")
    rate = F.coalesce(F.try_divide(n_near, reach_near), F.lit(0.0))
    held = held.withColumn("expected", F.greatest(rate * F.col("reach"), F.lit(0.5)))
    more = F.col("n") > F.col("expected")
    tail = F.when(more, F.exp(F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected")))).otherwise(1.0)
    held = held.withColumn("p", tail)
    # Benjamini-Hochberg among the lengths of one source and unit.
    m = F.count("*").over(by)
    rank = F.row_number().over(by.orderBy("p"))
    ok = held.withColumn("_ok", F.col("p") <= alpha * rank / m)
    worst = F.max(F.when(F.col("_ok"), F.col("p"))).over(by)
    return ok.withColumn("_worst", worst).where("p <= _worst").drop("_ok", "_worst")


def _with(rows: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is on the right, which says how many ``rows`` each key has."""
    total = right.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return hot_join(asked_for(rows, right, key), right, key, "rows", total)


IDENT = ["source_table", "record_id", "position", "source"]
_LENGTH = ["source_table", "source", "unit", "len"]


def _by_length(rows: DataFrame, name: str) -> DataFrame:
    """(source_table, source, unit, len, name): distinct texts of each length, in both units."""
    once = rows.select("source_table", "source", "chars", "bytes", "same").distinct()
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("bigint").alias("len")) for u in ("chars", "bytes")]))
    return once.select("source_table", "source", units.alias("u")).select("source_table", "source", "u.*").groupBy(*_LENGTH).agg(F.count("*").alias(name))


def _at(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``rows`` with ``at_limit``: whether a length of theirs, in either unit, is listed."""
    for unit in ("chars", "bytes"):
        own = lengths.where(F.col("unit") == unit).select("source_table", "source", F.col("len").cast("int").alias(unit), F.lit(True).alias("_" + unit))
        rows = rows.join(own, ["source_table", "source", unit], "left")
    return rows.withColumn("at_limit", F.coalesce("_chars", "_bytes", F.lit(False))).drop("_chars", "_bytes")


def cut_texts(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, position, source, reason, at_limit) of texts that lost their end.

    ``texts`` has (source_table, record_id, position, source, text) and may have
    origin: equal texts of one origin are copies, of two origins they are not;
    without it, or where it is null, all equal texts are copies.  Null and
    blank texts have no end to lose.  reason: ``sign``, ``goes_on``, ``seldom``,
    ``word``, ``fence`` or, for a text that looks whole, ``limit``; at_limit:
    whether the length is significant.  A null source counts as one source.
    """
    texts = texts.withColumn("source", F.coalesce("source", F.lit("")))
    if "origin" not in texts.columns:
        texts = texts.withColumn("origin", F.lit(None).cast("string"))
    ends = keep(_endings(texts), "ends")
    # Hazards of lengths.
    lengths = keep(_by_length(ends, "n"), "lengths")
    significant = keep(length_limits(lengths), "significant")
    # Hazards of endings.
    again = keep(_again(ends), "again")
    lines = keep(_broken_lines(keep(_shape_table(ends, again), "shapes")), "broken").withColumn("h", F.xxhash64("shape")).drop("shape")
    words = keep(_torn_words(ends, again), "torn")
    slim = [*IDENT, "chars", "bytes", "same"]
    by_line = _with(ends.select(*slim, "ctx", F.xxhash64("shape").alias("h")), lines, ["source_table", "ctx", "h"])
    by_word = _with(ends.select(*slim, "word"), words, ["source_table", "word"])
    rules = [(0, by_line, F.col("broken")), (1, by_word, F.lit("word")), (2, ends.where("fence"), F.lit("fence"))]
    each = None
    for order, rows, reason in rules:
        rows = rows.select(*slim, F.struct(F.lit(order).alias("order"), reason.alias("reason")).alias("why"))
        each = rows if each is None else each.unionByName(rows)
    incomplete = keep(each.groupBy(*slim).agg(F.min("why").alias("why")).select(*slim, "why.reason"), "incomplete")
    # Limits at which most texts end: the whole-looking ones of that length are cut, too.
    bad = significant.join(_by_length(incomplete, "n_bad"), _LENGTH)
    ends_here = (F.col("n") >= MOSTLY * F.col("reach")) & (F.col("n_bad") >= MOSTLY * F.col("n"))
    limits = keep(bad.where(ends_here & (F.col("n") - F.col("n_bad") >= 2 * F.col("expected"))).select(*_LENGTH), "limits")
    here = _at(ends.select(*slim), limits).where("at_limit").select(*slim, F.lit("limit").alias("reason"))
    here = here.join(incomplete.select("source_table", "record_id", "position"), ["source_table", "record_id", "position"], "left_anti")
    return _at(incomplete.unionByName(here), significant.select(*_LENGTH)).select(*IDENT, "reason", "at_limit")


def cut_rates(texts: DataFrame) -> DataFrame:
    """(source_table, source, n_texts, n_cut, n_at_limit, share) per source; null and blank texts are no texts."""
    n = texts.where(F.col("text").rlike(f"[^{_BLANK}]")).groupBy("source_table", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_texts"))
    cut = cut_texts(texts).groupBy("source_table", "source").agg(F.count("*").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"))
    both = n.join(cut, ["source_table", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_cut", "n_at_limit")})
    return both.withColumn("share", F.col("n_cut") / F.col("n_texts"))
