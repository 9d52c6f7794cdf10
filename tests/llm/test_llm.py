import bisect
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provelight.llm import spans as S
from provelight.llm import tokens as K
from provelight.llm.cutoff import _longer, cut_texts, length_limits
from provelight.llm.dedup import PUNCTUATION, SPACE, dress_copies
from provelight.llm.hot import asked_for, hot_join
from provelight.llm.packing import Packer, pack
from provelight.llm.percentiles import parts, percentiles
from provelight.llm.terms import count_terms, term_frequencies


# --- terms -------------------------------------------------------------------------
TEXTS = ["a b a x'", "", None, "  ", "a é b_1", "A a", "a " * 5000, "a b a x'"]


def test_terms_equal_counting(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "terms string")
    import re

    occ, rec = Counter(), Counter()
    for t in TEXTS:
        found = re.findall(r"[A-Za-z0-9_']+", t or "")
        occ.update(found)
        rec.update(set(found))
    n = sum(t is not None for t in TEXTS)
    mark = lambda k: "rare" if rec[k] < 3 else "common" if rec[k] > 0.2 * n else None
    want = {(k, occ[k], rec[k], mark(k)) for k in occ}
    assert {tuple(r) for r in term_frequencies(df).select("term", "occurrences", "records", "mark").collect()} == want
    for heavy in ([], ["a"], ["a", "b", "never"], list(occ)):  # the heavy list steers, it never changes a count
        assert {tuple(r) for r in count_terms(df, heavy).collect()} == {(k, occ[k], rec[k]) for k in occ}


def test_terms_of_maps(spark):
    df = spark.createDataFrame([({"x": 2, "y": None, "z": 0},), (None,), ({},), ({"x": 1},)], "terms map<string,bigint>")
    assert {tuple(r) for r in term_frequencies(df, 2).collect()} == {("x", 3, 2, "common")}
    assert term_frequencies(df.limit(0)).count() == 0


# --- dress copies ---------------------------------------------------------------------
def plain(text):
    return "".join(c for c in text.lower() if c not in SPACE and c not in PUNCTUATION)


def copies(rows):
    groups = defaultdict(list)
    for i, proof, task, model, meta in rows:
        if proof is not None and plain(proof):
            groups[plain(proof), task, model, frozenset((meta or {}).items())].append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def dress_rows(n, seed):
    rng = random.Random(seed)
    texts = ["by simp", "BY\u00a0simp!", "by  sim p", "by omega", None, "", " .\u200b", "by ring", "x" * 9000, "X" * 9000]
    metas = [None, {}, {"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": None}]
    hot = [(i, "by simp", "t", None, None) for i in range(n // 3)]
    rest = [(n + i, rng.choice(texts), rng.choice("tu"), rng.choice(["m", None]), rng.choice(metas)) for i in range(n)]
    return hot + rest


@pytest.mark.parametrize("bits", [64, 4])
def test_dress_copies_equal_brute_force(spark, bits):
    rows = dress_rows(150, bits)
    df = spark.createDataFrame(rows, "record_id bigint, proof string, task_id string, model string, metadata map<string,string>").withColumn("_id", F.lit("clash"))
    got = {tuple(r) for r in dress_copies(df, "record_id", "proof", ["task_id", "model"], ["metadata"], bits).collect()}
    assert got == copies(rows)
    assert dress_copies(df.limit(0), "record_id", "proof", ["task_id", "model"], ["metadata"]).count() == 0


def test_dress_copies_of_more_members_than_one_task_joins(spark, monkeypatch):
    from functools import partial

    from provelight.llm import dedup

    rows = [(i, f"by x{i % 20 if i % 2 else 1}", "t", None, None) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, proof string, task string, model string, meta map<string,string>")
    monkeypatch.setattr(dedup, "hot_join", partial(hot_join, per_task=20))
    monkeypatch.setattr(dedup, "PER_SALT", 30)
    found = [tuple(r) for r in dress_copies(df, "id", "proof", ["task", "model"], ["meta"]).collect()]
    assert len(found) == len(set(found)) and set(found) == copies(rows)


# --- cut texts ---------------------------------------------------------------------------
def proofs(n, seed=1):
    rng = random.Random(seed)
    steps = ["have h{0} : p k := foo_bar_{0} k", "refine bar_baz_{0} (fun x hx => q x hx)", "rw [foo_baz_{0}, add_comm]", "simp only [bar_foo_{0}] at h{0}"]
    ends = ["linarith", "omega", "ring_nf", "exact h{0}"]
    body = lambda: ["by", *(rng.choice(steps).format(rng.randint(10, 99)) for _ in range(rng.randint(2, 8))), rng.choice(ends).format(rng.randint(10, 99))]
    return ["\n  ".join(body()) for _ in range(n)]


def test_cut_texts(spark):
    rng = random.Random(5)
    whole = proofs(3000)
    whole += [w + "\n-- and so on …" for w in proofs(200, 2)]
    cut = []
    for t in proofs(200, 3):
        if len(t) > 150:
            cut.append(("limited", t[:150]))
    for t in proofs(60, 4):
        cut.append(("free", t[: rng.randint(20, len(t) - 12)] + rng.choice(["", "…", " [...]"])))
    rows = [("t", i, -1, "free", t) for i, t in enumerate(whole)]
    rows += [("t", 10_000 + i, -1, s, t) for i, (s, t) in enumerate(cut)]
    rows += [("t", 20_000, -1, None, None), ("t", 20_001, -1, None, " \n"), ("t", 20_002, -1, None, "")]
    df = spark.createDataFrame(rows, "source_table string, record_id bigint, position int, source string, text string")
    got = {r["record_id"] for r in cut_texts(df).collect()}
    true = {10_000 + i for i in range(len(cut))}
    assert len(got & true) >= 0.9 * len(true)
    assert len(got - true) <= 0.02 * len(whole)
    assert not {20_000, 20_001, 20_002} & got
    assert cut_texts(df.limit(0)).count() == 0


def test_copies_of_a_cut_text_are_no_evidence(spark):
    whole = proofs(3000)
    copied = next(t for t in proofs(50, 9) if "foo_bar_" in t)
    copied = copied[: copied.index("foo_bar_") + 6]
    # The message '[n] failed' stands alone in many origins and is the beginning of longer lines, too.
    longer = [(f"failed to find {i}", f"o{i}") for i in range(900)]
    rows = [("t", i, -1, "s", t, f"o{i}") for i, t in enumerate(whole)]
    rows += [("t", 10_000 + i, -1, "s", copied, "o1") for i in range(1500)]
    rows += [("t", 20_000 + i, -1, "s", *x) for i, x in enumerate(longer)]
    rows += [("t", 30_000 + i, -1, "s", "failed", f"o{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "source_table string, record_id bigint, position int, source string, text string, origin string")
    got = {r["record_id"] for r in cut_texts(df).collect()}
    assert {10_000 + i for i in range(1500)} <= got
    assert len(got) <= 1500 + 0.02 * len(whole)
    without = {r["record_id"] for r in cut_texts(df.drop("origin").where("record_id < 20000")).collect()}
    assert {10_000 + i for i in range(1500)} <= without


def test_torn_words_in_few_texts_and_very_long_lines(spark):
    whole = proofs(500)
    line = "have q : " + "alpha beta gamma delta " * 9_000 + "done"
    rows = [("t", i, -1, "s", t, f"o{i}") for i, t in enumerate(whole)]
    rows += [("t", 1000 + i, -1, "s", "by\n  " + line, f"p{i}") for i in range(12)]
    rows += [("t", 2000, -1, "s", "by\n  " + line[:140_001], "q")]  # ends in the middle of a word of the long line
    rows += [("t", 3000, -1, "s", "so then foo_ba", "r")]  # a torn word, in a line nobody knows
    df = spark.createDataFrame(rows, "source_table string, record_id bigint, position int, source string, text string, origin string")
    got = {r["record_id"]: r["reason"] for r in cut_texts(df).collect()}
    assert got.get(3000) == "word" and got.get(2000) in ("goes_on", "word")
    assert not set(range(1000, 1012)) & got.keys() and len(got) <= 2 + 0.02 * len(whole)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 700])
def test_prefix_ladder_equals_all_prefixes(spark, n):
    rng = random.Random(n)
    text = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([1, 2, n, n + 1, rng.randint(1, n)])))
    known = list({("s", text()): rng.randint(1, 5) for _ in range(60)}.items())
    probes = {k[1][: rng.randint(0, len(k[1]))] for k, _ in known} | {text() for _ in range(20)}
    left = spark.createDataFrame([(*k, v) for k, v in known], "key string, text string, n bigint")
    right = spark.createDataFrame([("s", p) for p in probes], "key string, text string")
    got = {(r["text"], r["ext"]) for r in right.withColumn("p", F.xxhash64("text")).join(_longer(left, right, ["key"]), ["key", "p"]).collect()}
    want = {(p, sum(v for (_, t), v in known if len(t) > len(p) and t.startswith(p))) for p in probes if p}
    assert got == {w for w in want if w[1]}


def test_length_limits(spark):
    rng = random.Random(3)
    n = Counter(min(200, int(rng.gauss(150, 40))) for _ in range(4000))
    rows = [("t", "s", "chars", k, v) for k, v in n.items() if k > 0]
    df = spark.createDataFrame(rows, "source_table string, source string, unit string, len bigint, n bigint")
    assert [r["len"] for r in length_limits(df).collect()] == [200]


# --- percentiles ------------------------------------------------------------------------
def test_percentiles_equal_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), -1.0, 0.0, 5.0, 5.0, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    runs = parts(df.where("x is null or x < 0.5"), ["g"], ["x"]).unionByName(parts(df.where("not (x is null or x < 0.5)"), ["g"], ["x"]))
    # a small ``gather``, so that many rounds are needed
    got = {(r["group"], r["quantile"]): (r["n"], r["value"]) for r in percentiles(runs, [0.0, 0.1, 0.5, 0.9, 1.0], gather=3).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for h, x in rows if h == g and x is not None and x >= 0)
        key = '{"g":%s}' % ("null" if g is None else f'"{g}"')
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert got[key, q] == (len(xs), xs[max(1, math.ceil(round(q * len(xs), 9))) - 1])
    assert percentiles(parts(df.limit(0), ["g"], ["x"]), [0.5]).count() == 0


@pytest.mark.parametrize("gather", [0, 1, 512])
def test_percentiles_of_infinite_and_equal_values(spark, gather):
    inf = math.inf
    rows = [("half", inf if i % 2 else float(i)) for i in range(1000)] + [("mostly", inf)] * 3000 + [("mostly", 1.0)] * 300
    rows += [("same", 7.0)] * 2500 + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", -inf)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(r["group"][6:-2], r["quantile"]): r["value"] for r in percentiles(parts(df, ["g"], ["x"]), [0.05, 0.5, 0.99], gather).collect()}
    want = {}
    for g in ("half", "mostly", "same", "one", "two"):
        xs = sorted(x for h, x in rows if h == g)
        want.update({(g, q): xs[max(1, math.ceil(round(q * len(xs), 9))) - 1] for q in (0.05, 0.5, 0.99)})
    assert got == want


def test_percentiles_of_many_groups_and_clashing_columns(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("group"), (F.col("id") / 20_000).cast("int").cast("double").alias("run"), F.lit("x").alias("metric"))
    got = percentiles(parts(df, ["group"], ["run"]), [0.5])
    assert got.count() == 20_000 and got.where("value <> 1 or n <> 3").count() == 0


# --- tokens -------------------------------------------------------------------------------
ODD = ["", None, " ", "\n\n\n", "a" * 5000, " " * 3000, "x y" * 900, "\ud7ff\ufeff é\u200b" * 300, "don't  stop\t\tnow\r\n" * 200, "<|endoftext|>", "漢字かな" * 500]


def test_token_ids_equal_encoding_the_whole(spark):
    encode = K.encoder().encode_ordinary
    rng = random.Random(4)
    words = ["alpha", "β", " 12", "\n", "  ", "it's", "。", "\t", "naïve", "()", "\u00a0"]
    shared = " ".join(rng.choice(words) for _ in range(800))
    texts = ODD + ["".join(rng.choice(words) for _ in range(rng.randint(1, 1500))) + shared for _ in range(40)] + [shared] * 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in K.encode_corpus(df, "doc_id", "text").collect())
    assert got == Counter((i, tuple(encode(t) if t else ())) for i, t in rows)
    assert K.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counts = {(r["doc_id"], r["n_tokens"]) for r in K.token_counts(df, "doc_id", "text").collect()}
    assert counts == {(i, len(encode(t)) if t else 0) for i, t in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1\n\t'.é\u00a0", max_size=400), st.lists(st.integers(0, 400), max_size=8))
def test_repaired_joins_agree_wherever_a_text_is_cut(text, ends):
    encode = K.encoder().encode_ordinary
    at = sorted({min(e, len(text)) for e in ends} | {0, len(text)})
    chunks = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
    assert K.assemble([K.chunk_code(c, encode) for c in chunks], encode) == encode(text)


def test_cuts_follow_the_content():
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    a, b = shared, "".join(rng.choice("xyz ") for _ in range(777)) + shared
    pieces = lambda t: {t[s:e] for s, e in zip([0, *K.cuts(t)], K.cuts(t), strict=False)}
    assert len(pieces(a) & pieces(b)) > 0.7 * len(pieces(a))
    assert max(len(p) for p in pieces("q" * 9000)) <= K.MOST


# --- packing -------------------------------------------------------------------------------
def test_packer_follows_the_rule():
    rng = random.Random(1)
    packer, open_ = Packer(10), {}
    for _ in range(400):
        s = rng.randint(1, 10)
        count = Counter(open_.values())
        square = lambda c: sum(v * v for g, v in c.items() if 0 < g < 10)

        def after(gap, c=count, s=s):
            d = Counter(c)
            if gap < 10:
                d[gap] -= 1
            d[gap - s] += 1
            return square(d)

        best = min([after(g) for g in set(open_.values()) if s <= g < 10] + [after(10)])
        before = dict(open_)
        n = packer.place(s)
        assert after(before.get(n, 10)) == best
        open_[n] = open_.get(n, 10) - s
        assert open_[n] >= 0


def best_fit(sizes, capacity):
    gaps, used = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        if at == len(gaps):
            used, gap = used + 1, capacity
        else:
            gap = gaps.pop(at)
        bisect.insort(gaps, gap - s)
    return used


def test_pack_is_whole_and_tight(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, None, 1, 100, 2048, 2049, 5000, rng.randint(1, 2048)])) for i in range(6000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n int").withColumn("box", F.lit("clash"))
    for per in (10**6, 700):
        rows = pack(df, "doc_id", "n", 2048, per_packer=per, fan_in=3).collect()
        fill, mine = Counter(), Counter()
        for r in rows:
            mine[r["doc_id"]] += r["n_units"]
            assert (r["container"] is None) == (r["n_units"] == 0)
            if r["container"] is not None:
                fill[r["container"]] += r["n_units"]
                assert r["start"] == r["piece"] * 2048
        assert mine == Counter({i: n or 0 for i, n in sizes}) and len(mine) == len(sizes)
        assert max(fill.values()) <= 2048
        assert len(fill) <= 1.03 * best_fit([r["n_units"] for r in rows if r["n_units"]], 2048)
        pieces = Counter(r["doc_id"] for r in rows)
        assert all(pieces[i] == max(1, -(-(n or 0) // 2048)) for i, n in sizes)
    assert pack(df.limit(0), "doc_id", "n", 2048).count() == 0


# --- spans -------------------------------------------------------------------------------------
def brute_spans(rows, length):
    where = defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - length + 1):
            where[t[p : p + length]].add(i)
    out = []
    for i, t in rows:
        hits = [p for p in range(len(t or "") - length + 1) if len(where[t[p : p + length]]) > 1]
        for p in hits:
            if out and out[-1][0] == i and p <= out[-1][2]:
                out[-1][2] = p + length
            else:
                out.append([i, p, p + length])
    return {tuple(s) for s in out}


@pytest.mark.parametrize("alphabet", ["abcdefghij é漢", "ab", "a "])
def test_spans_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [text(n) for n in (239, 240, 241, 300, 900)] + ["-" * 500, "ab" * 200]
    rows = []
    for i in range(60):
        body = "".join(text(rng.randint(0, 200)) + (rng.choice(common) if rng.random() < 0.5 else "") for _ in range(3))
        rows.append((i, body))
    hot = text(400)
    rows += [(100 + i, text(50) + hot + text(30)) for i in range(40)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, hot[:240]), (204, "z" * 10 + "".join(map(chr, range(500, 900))) * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("span_start", F.lit(0))
    got = {tuple(r) for r in S.shared_spans(df, "doc_id", "text").collect()}
    assert got == brute_spans(rows, 240)


def test_spans_of_a_passage_twice_in_the_text_that_stands_for_others(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    whole = text(900)
    rows = [(1, text(90) + whole + text(70) + whole[200:520] + text(60)), (2, text(50) + whole + text(40)), (3, text(44) + whole[300:610] + text(9))]
    rows += [(4, whole[250:495]), (5, text(300) + whole[655:895] + text(300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {tuple(r) for r in S.shared_spans(df, "doc_id", "text").collect()} == brute_spans(rows, 240)


def test_spans_of_nothing_and_shares(spark):
    df = spark.createDataFrame([(1, "abc" * 100), (2, "abc" * 100), (3, None)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_chars"], r["shared_chars"], r["share"]) for r in S.shared_share(df, "doc_id", "text").collect()}
    assert got == {(1, 300, 300, 1.0), (2, 300, 300, 1.0), (3, 0, 0, 0.0)}
    assert S.shared_spans(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        S.shared_spans(df, "doc_id", "text", 100)


# --- hot keys ----------------------------------------------------------------------------------
def test_hot_join_equals_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(3000)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").select("k", "v", "m").collect()))
    for per_task in (10, 300, 100_000):
        assert sorted(map(tuple, hot_join(left, right, ["k"], "n", 3000, per_task).select("k", "v", "m").collect())) == want


def test_hot_keys_are_split(spark):
    """A third of all rows has one key and another key has 1/300: no task gets more than about the bound."""
    left = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 300 == 1, -2).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = hot_join(left, right, ["k"], "n", 90_000, per_task=100)
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id(), "k").count().where("k < 0").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 30_300 and max(sizes) < 0.5 * 30_000


def test_hot_join_of_columns_with_names_of_its_own(spark):
    left = spark.range(300).selectExpr("id % 3 as k", "id as _h", "id + 1 as _SALT")
    right = spark.createDataFrame([(k, k + 10, 100) for k in range(3)], "k bigint, _s bigint, n bigint")
    want = sorted(map(tuple, left.join(right.drop("n"), ["k"]).collect()))
    for per_task in (10, 1000):
        met = hot_join(left, right, ["k"], "n", 300, per_task)
        assert met.columns == ["k", "_h", "_SALT", "_s"]
        assert sorted(map(tuple, met.collect())) == want


def test_asked_for_loses_nothing(spark):
    rows = spark.range(20_000).select((F.col("id") % 997).alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    keys = spark.createDataFrame([(i,) for i in [0, 5, 5, 700, -1, None]], "k bigint")
    got = asked_for(rows, keys, ["k"])
    assert got.columns == ["k", "text"]
    assert got.where("k in (0, 5, 700)").count() == rows.where("k in (0, 5, 700)").count() and got.count() < 100
    assert asked_for(rows, keys.limit(0), ["k"]).count() == 0


def test_sizes_that_fit_badly(spark):
    rng = random.Random(3)
    for low, high, most in ((700, 760, 1.0), (1, 2048, 1.04)):
        sizes = [(i, rng.randint(low, high)) for i in range(6000)]
        df = spark.createDataFrame(sizes, "doc_id bigint, n int")
        for per in (10**6, 1500):
            used = pack(df, "doc_id", "n", 2048, per_packer=per, fan_in=2).select("container").distinct().count()
            assert used <= most * best_fit([n for _, n in sizes], 2048)
