"""Substring deduplication by content-defined chunks.

A gear hash runs over the bytes of each text; a chunk ends where the hash is least among its neighbours, so
ends depend on nearby bytes alone and an insertion shifts only the chunks it touches.  Chunks have digests; a
digest's first place in the corpus keeps its text.  Repeats that follow one
another make a run, and runs of enough words are cut out: lone short repeats, such as a licence
line or a phrase, stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinchgraph.llm.common import rows_of, utf8
from pinchgraph.storage import materialize

#: A chunk ends after a byte whose hash is the least of this many bytes on either side, the leftmost if equal.
#: Ends are thus further apart than this, about twice as far on average, and depend on nearby bytes alone:
#: two copies of a passage agree on all ends but those near its edges.
SPREAD = 20
#: Bytes of a chunk at most; monotonous text has no single least hash and is cut here.
MOST = 96
#: Bytes the gear hash looks back.
REACH = 16
#: Words of a run of repeated chunks for it to be cut.  A passage of 51 words loses some text at either end, by
#: measurement 18 words at most, so the bound lies below the passages meant.
MIN_WORDS = 25
#: Bits of the map that tells the second pass which chunks may repeat, 16 MiB whatever the input.  A false hit is a
#: chunk that is moved and found to be alone.
MAP_BITS = 1 << 27
#: Bytes hashed at once.
STRIDE = 1 << 20

GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + g[byte i] modulo 2**16, which is a sum over the last 16 bytes."""
    g = GEAR[data]
    h = g.copy()
    for k in range(1, min(REACH, len(g))):
        h[k:] += g[:-k] << np.uint16(k)
    return h


def _ends(raw: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, from the bytes around them."""
    n, far = len(raw), np.uint16(0xFFFF)
    h = gear(raw)
    padded = np.concatenate([np.full(SPREAD, far), h, np.full(SPREAD, far)])
    low, width = padded, 1
    while 2 * width <= SPREAD:  # low[i] is the least of padded[i : i + width]
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    least = np.minimum(low[: len(low) - (SPREAD - width)], low[SPREAD - width :])  # of padded[i : i + SPREAD]
    return np.flatnonzero((h < least[:n]) & (h <= least[SPREAD + 1 : SPREAD + 1 + n])) + 1


def cut_points(text: bytes) -> np.ndarray:
    """The ends of the chunks of a text, the last one its length.  An empty text has none."""
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    margin = SPREAD + REACH
    found = []
    for base in range(0, n, STRIDE):
        a, b = max(0, base - margin), min(n, base + STRIDE + margin)
        ends = _ends(raw[a:b]) + a
        found.append(ends[(ends > base) & (ends <= base + STRIDE) & (ends < n)])
    ends = np.concatenate([*found, [n]]) if n else np.zeros(0, np.int64)
    gaps = np.diff(ends, prepend=0)
    if (gaps > MOST).any():
        ends = np.concatenate([np.r_[e - gap + MOST : e : MOST, e] if gap > MOST else [e] for e, gap in zip(ends.tolist(), gaps.tolist())])
    inside = np.flatnonzero((raw[np.minimum(ends, n - 1)] & 0xC0 == 0x80) & (ends < n)) if n else []
    for i in inside:  # never inside a character
        while ends[i] < n and raw[ends[i]] & 0xC0 == 0x80:
            ends[i] += 1
    return np.unique(ends)


def _text_key() -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(utf8(F.col("text"))).alias("_text_key")


def _digests(text: bytes, ends: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), utf8(F.col("text")).alias("text"))


def repeated_map(docs: DataFrame, map_bits: int = MAP_BITS) -> np.ndarray:
    """A bit map of the digest halves `hi` that two rows or more hold, marked by their last bits; `map_bits` is a power of two.

    Only eight bytes a chunk are shuffled, summed up per task before.  At most map_bits / 64 words reach the driver.
    """
    schema = pa.schema([("hi", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(np.frombuffer(b"".join(_digests(text, cut_points(text))), ">i8")[::2].astype(np.int64)) for (text,) in rows_of([batch], "text")]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts))], schema=schema)

    halves = _texts(docs).select("text").mapInArrow(run, "hi long").groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.col("hi").bitwiseAND(F.lit(map_bits - 1))
    marked = halves.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(hi & 63 AS INT))").alias("bit"))
    words = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(map_bits // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return bits


def chunk_rows(docs: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """doc_id, _text_key, no, start, length, words, hi, lo, inner of every chunk, or of those that may repeat.

    Place in bytes, words begun in it, a 128-bit digest, and whether the same text has it earlier.
    Given the bit map `repeated`, rows are the chunks marked there and all places of chunks that a text holds twice.
    Null and empty texts have no chunks.
    """
    kinds = {"doc_id": pa.int64(), "_text_key": pa.int64(), "no": pa.int32(), "start": pa.int64(), "length": pa.int32(), "words": pa.int32(), "hi": pa.int64(), "lo": pa.int64(), "inner": pa.bool_()}
    schema = pa.schema(list(kinds.items()))
    shared = None if repeated is None else docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc_id, key, text in rows_of([batch], "doc_id", "_text_key", "text"):
                ends = cut_points(text)
                if not len(ends):
                    continue
                begins = np.r_[0, ends[:-1]]
                digests = _digests(text, ends)
                known = set()
                inner = np.array([d in known or known.add(d) is not None for d in digests])
                d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                if shared is None:
                    use = np.arange(len(ends))
                else:
                    place = d[:, 0].view(np.uint64) & np.uint64(64 * len(shared.value) - 1)
                    use = np.flatnonzero(inner | ((shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) != 0))
                    if not len(use):
                        continue
                raw = np.frombuffer(text, np.uint8)
                opens = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
                opens[1:] &= ~opens[:-1]
                words = np.add.reduceat(opens, begins, dtype=np.int64)
                parts.append((np.full(len(use), doc_id), np.full(len(use), key), use, begins[use], (ends - begins)[use], words[use], d[use, 0], d[use, 1], inner[use]))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, _text_key long, no int, start long, length int, words int, hi long, lo long, inner boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, map_bits: int = MAP_BITS) -> DataFrame:
    """doc_id, _text_key, start, length, words, first_doc_ids: byte spans of texts that repeat earlier text, at least `min_words` long.

    Earlier means a document with a smaller id, or an earlier place of the same text.  first_doc_ids are the documents that
    keep the text.  Rows without an id or text have no spans, and rows that share an id are no repeats of one another:
    equal rows have the spans of one, different texts their own.

    Texts are cut twice: first to find the digests that stand in two rows, then to give the places of those alone, so
    chunks found once are never stored or moved.  `map_bits` changes the work of the second pass, not the result.
    """
    chunks = materialize(chunk_rows(docs, repeated_map(docs, map_bits)), "chunks").df
    firsts = chunks.where("not inner").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    shared = materialize(firsts.where("n > 1").select("hi", "lo", "first_doc"), "shared").df
    elsewhere = chunks.join(shared, ["hi", "lo"]).where((F.col("doc_id") != F.col("first_doc")) | F.col("inner"))
    here = chunks.where("inner").join(shared, ["hi", "lo"], "left_anti").withColumn("first_doc", F.col("doc_id"))
    again = elsewhere.unionByName(here)
    order = Window.partitionBy("doc_id", "_text_key").orderBy("no")
    once = F.when(F.row_number().over(order) == 1, True).otherwise(F.lag("no").over(order) != F.col("no"))  # a row may stand twice
    words = F.when(once, F.col("words")).otherwise(0).alias("words")
    runs = again.select("doc_id", "_text_key", "no", "start", "length", words, "first_doc", (F.col("no") - F.dense_rank().over(order)).alias("run"))
    spans = runs.groupBy("doc_id", "_text_key", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("_end"), F.sum("words").alias("words"), F.array_sort(F.collect_set("first_doc")).alias("first_doc_ids"))
    return spans.where(F.col("words") >= min_words).select("doc_id", "_text_key", "start", (F.col("_end") - F.col("start")).alias("length"), "words", "first_doc_ids")


def spans_per_document(spans: DataFrame) -> DataFrame:
    """doc_id and _text_key with the spans in order; as many as the text has, so bounded by the document."""
    return spans.groupBy("doc_id", "_text_key").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_doc_ids")))).alias("first_doc_ids"))


def _cut_text(spans: str) -> Column:
    """`text` without the spans of the array column named."""
    raw = F.col("text").cast("binary")
    start = F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, n: F.substring(raw, (a + 1).cast("int"), n.cast("int"))
    folded = F.aggregate(spans, start, lambda acc, s: F.struct(
        F.concat(acc["kept"], piece(acc["at"], s["start"] - acc["at"])).alias("kept"), (s["start"] + s["length"]).alias("at")))
    tail = F.transform(F.array(folded), lambda f: F.concat(f["kept"], piece(f["at"], F.octet_length(raw) - f["at"])))[0]
    return tail.cast("string")


def changed_documents(docs: DataFrame, per: DataFrame) -> DataFrame:
    """The rows of `docs` that have spans, with doc_id, spans, first_doc_ids and the text that stays."""
    return docs.select("doc_id", "text", _text_key()).join(per, ["doc_id", "_text_key"]).select("doc_id", "spans", "first_doc_ids", _cut_text("spans").alias("text"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of `docs` with the spans cut out of its text; a text that nothing is left of becomes empty.

    Rows without spans are unchanged, null texts included.
    """
    per = spans_per_document(spans).select("doc_id", "_text_key", F.col("spans").alias("_spans"))
    joined = docs.select("*", _text_key()).join(per.hint("merge"), ["doc_id", "_text_key"], "left")  # spans grow with the documents: never broadcast
    text = F.when(F.col("_spans").isNotNull(), _cut_text("_spans")).otherwise(F.col("text")).alias("text")
    return joined.select(*[text if c == "text" else F.col(c) for c in docs.columns])
