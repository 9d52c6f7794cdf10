"""Token ids of a whole corpus by a public byte-level BPE tokenizer.

Content-defined chunk reuse: a rolling hash over the characters cuts every text
where its content says so, so a passage that stands in many texts gives the same
chunks in all of them.  Chunks are counted by their fingerprints, without their
text.  Each chunk that stands in the corpus more than once is encoded once; the
text between such chunks is encoded where it stands.  Then the joins are repaired:
next to a join the pre-tokenizer may see other neighbours than in the chunk alone,
so the text around it is encoded again, from the last point in the left chunk to
the first point in the right one at which the encodings of both sides agree
whatever follows or precedes.  Such a point lies before a blank (U+0020) that
follows a character that is not white space: in the patterns of byte-level BPE
vocabularies a blank opens a piece or stands in a run of white space, so no piece
spans it.  (A line feed is no such point: some patterns add it to the punctuation
before.)  A chunk without such a point is taken into the window whole and the
window widens to the next chunk, until both its ends agree.  The result equals
the encoding of the whole text, id by id.
"""

from __future__ import annotations

import base64
import importlib.util
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from provelight.llm.hot import asked, hot_join
from provelight.llm.prints import Windows, block, blocks
from provelight.store import keep

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters the rolling hash sees, mean distance of cuts, least and most characters of a chunk.
ROLL, MEAN, LEAST, MOST = 24, 256, 64, 2048
_POINT = re.compile(r"\S ")

@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per process."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_vocabularies", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("provelight", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text; the last one is its length."""
    codes, at = block([text])
    return _cuts(Windows(codes), at)[0] if text else []


def _cuts(windows: Windows, at: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text of a block, counted from the start of the text.

    A cut stands behind ``ROLL`` characters whose hash is 0 modulo ``MEAN``, at
    least ``LEAST`` and at most ``MOST`` characters behind the cut before.
    """
    h = windows.rolling(ROLL).view(np.uint64) >> np.uint64(40)
    ends = np.flatnonzero(h % np.uint64(MEAN) == 0) + ROLL
    # A window may begin in the text before; such ends lie within ROLL characters of the start, and LEAST is more.
    edges = np.searchsorted(ends, at)
    out = []
    for k, n in enumerate(np.diff(at).tolist()):
        own, last = [], 0
        for end in (ends[edges[k] : edges[k + 1]] - at[k]).tolist():
            if end - last < LEAST:
                continue
            while end - last > MOST:
                last += MOST
                own.append(last)
            if end - last >= LEAST and end < n:
                own.append(end)
                last = end
        while n - last > MOST:
            last += MOST
            own.append(last)
        out.append([*own, n])
    return out


def agreeing(text: str) -> tuple[int, int] | None:
    """First and last point of a text at which encodings always agree, if any."""
    first, last = _POINT.search(text), len(text)
    if first is None:
        return None
    while True:
        last = text.rfind(" ", 0, last)
        if not text[last - 1].isspace():
            return first.start() + 1, last


def chunk_code(text: str, encode) -> tuple[str, list[int] | None, str]:
    """(head, ids between the agreeing points, tail); without such points all is head and ids are None."""
    points = agreeing(text)
    if points is None:
        return text, None, ""
    first, last = points
    return text[:first], encode(text[first:last]) if last > first else [], text[last:]


def assemble(parts: list[tuple[str, list[int] | None, str]], encode) -> list[int]:
    """The ids of a text from the codes of its chunks, joins repaired."""
    ids: list[int] = []
    window = ""
    for head, middle, tail in parts:
        window += head
        if middle is not None:
            if window:
                ids.extend(encode(window))
            ids.extend(middle)
            window = tail
    if window:
        ids.extend(encode(window))
    return ids


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; null and empty texts give an empty list.

    Ids are those of the vocabulary without special tokens; strings that look
    like special tokens are ordinary text.  Rows with equal keys stay apart.
    """
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches):
            codes, at = block([body for _, body in some])
            windows = Windows(codes)
            ends = _cuts(windows, at)
            n = np.fromiter(map(len, ends), np.int64, len(ends))
            stop = np.concatenate([np.asarray(e) + a for e, a in zip(ends, at[:-1], strict=True)])
            start = np.append(0, stop[:-1])  # texts adjoin
            h1, h2 = windows.prints(start, stop - start)
            offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(ends).astype(np.int32), h1, h2)]
            ids, texts = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, ids_type), pa.array(texts, pa.string()), *listed], ["id", "text", "ends", "h1", "h2"])

    ids_type = to_arrow_type(df.schema[key].dataType)
    texts = rows.where("text <> ''").mapInArrow(cut, f"id {kind}, text string, ends array<int>, h1 array<bigint>, h2 array<bigint>")
    texts = keep(texts.withColumn("row", F.monotonically_increasing_id()), "cut")
    # Chunks by fingerprint: how often each stands in the corpus, and where first.
    zipped = F.posexplode(F.arrays_zip("h1", "h2")).alias("seq", "h")
    chunks = texts.select("row", zipped).select("row", "seq", "h.h1", "h.h2")
    counted = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("row", "seq")).alias("at")).where("n > 1")
    repeats = keep(counted, "repeats")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            found = []
            for body, ends, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for c in own:
                    start = ends[c["seq"] - 1] if c["seq"] else 0
                    found.append((c["h1"], c["h2"], c["n"], *chunk_code(body[start : ends[c["seq"]]], encode)))
            if found:
                types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "n", "head", "middle", "tail"])

    firsts = repeats.select("h1", "h2", "n", "at.*").groupBy("row").agg(F.collect_list(F.struct("seq", "h1", "h2", "n")).alias("own"))
    firsts = keep(firsts, "firsts")
    bodies = asked(texts.select("row", "text", "ends"), firsts, ["row"]).where("_asked").join(firsts, "row").select("text", "ends", "own")
    codes = keep(bodies.mapInArrow(code, "h1 bigint, h2 bigint, n bigint, head string, middle array<int>, tail string"), "codes")
    total = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = hot_join(asked(chunks, repeats, ["h1", "h2"]).where("_asked").drop("_asked"), codes, ["h1", "h2"], "n", total)
    uses = keep(met.groupBy("row").agg(F.collect_list(F.struct("seq", "head", "middle", "tail")).alias("parts")), "uses")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            out = []
            for body, ends, parts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if not parts:
                    out.append(encode(body))
                    continue
                pieces, at = [], 0
                for p in sorted(parts, key=lambda p: p["seq"]):
                    start = ends[p["seq"] - 1] if p["seq"] else 0
                    pieces += [(body[at:start], None, ""), (p["head"], p["middle"], p["tail"])]
                    at = ends[p["seq"]]
                out.append(assemble([*pieces, (body[at:], None, "")], encode))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    # Texts without a chunk of their own in ``uses`` stay where they are; one that the filter lets through by chance has no parts.
    marked = asked(texts.select("row", "id", "text", "ends"), uses, ["row"])
    reused = marked.where("_asked").join(uses, "row", "left").select("id", "text", "ends", "parts")
    alone = marked.where("not _asked").select("id", "text", "ends", F.lit(None).cast(uses.schema["parts"].dataType).alias("parts"))
    done = alone.unionByName(reused).mapInArrow(join, f"id {kind}, ids array<int>")
    none = rows.where("text is null or text = ''").select("id", F.array().cast("array<int>").alias("ids"))
    return done.unionByName(none).select(F.col("id").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0 tokens."""
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
