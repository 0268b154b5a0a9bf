"""Importance resampling: ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

N-grams are words, pairs of words and the first 5 and 7 bytes of longer words, hashed to `BUCKETS` each.
The raw model counts every document, the target model a bounded sample of labelled good ones.
An n-gram's log ratio is log((c + PRIOR) / (e + PRIOR)): c its target count, e the count expected there
at its raw frequency; the prior keeps rare n-grams near ratio 1.  A document has a log weight (the sum), its mean per
word, and its least sum over `WINDOW` words in a row, since a few bad words in a long text hardly move
the mean.  Margins over cuts learnt from held-back labels make the score; keys are
score + temperature x Gumbel noise, and the k largest keys are a sample without replacement with chances by weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.llm.common import rows_of, utf8
from pinchgraph.storage import materialize

BUCKETS = 1 << 18
PREFIXES = (5, 7)
FAMILIES = 2 + len(PREFIXES)
PRIOR = 5.0
WINDOW = 3
#: Labelled documents used at most, picked by a hash of their id: the bound of everything learnt from labels.
LABELLED = 40_000
#: Of those, one in this many is held back to learn the cuts.
HELD_BACK = 4
#: Share of good documents a cut may lose at most.
LOSS = 0.02
#: Scale of the Gumbel noise.  At 1 this is the plain resampling; near 0 the best documents always stay.
TEMPERATURE = 0.01
#: Words a worker remembers before it starts anew.
CACHE = 500_000
#: Buckets in a row when counts are exchanged.
BLOCK = 1 << 13

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff \t\n\r\x0b\x0c]+")


class Features:
    """Bucket numbers of a text's n-grams.  A word's hashes are kept, as words recur."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((1024, 1 + len(PREFIXES)), np.uint32)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.at) + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(words)), self.table.shape[1]), np.uint32)])
        for w in words:
            row = self.at[w] = len(self.at)
            self.table[row] = [xxhash.xxh32_intdigest(w), *(xxhash.xxh32_intdigest(w[:k], k) | 1 if len(w) > k else 0 for k in PREFIXES)]

    def __call__(self, text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions of words, buckets) of each family."""
        words = TOKEN.findall(text.lower())
        new = {w for w in words if w not in self.at}
        if new:
            if len(self.at) > CACHE:
                self.at.clear()
                new = set(words)
            self._learn(new)
        rows = self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]
        ids = rows[:, 0].astype(np.uint64)
        pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        out = [(np.arange(len(ids)), (ids % np.uint64(BUCKETS)).astype(np.int64)), (np.arange(1, len(ids)), ((pairs >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))]
        for k in range(len(PREFIXES)):
            has = np.flatnonzero(rows[:, 1 + k])
            out.append((has, (rows[has, 1 + k] >> np.uint32(1)).astype(np.int64) % BUCKETS))
        return [(where, bucket + f * BUCKETS) for f, (where, bucket) in enumerate(out)]


_FEATURES = Features()


@dataclass(frozen=True)
class Labels:
    """The bounded sample of labelled documents: ids for the target model, and held-back ids with (quality, toxic)."""

    target: np.ndarray
    held: dict[int, tuple[int, int]]


def labelled(labels: DataFrame, most: int = LABELLED) -> Labels:
    """At most `most` labelled documents.  Of repeated labels of an id the worse counts; null labels are none."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = one.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most).collect()
    held = {r["doc_id"]: (r["quality"], r["toxic"]) for i, r in enumerate(rows) if i % HELD_BACK == 0}
    target = [r["doc_id"] for i, r in enumerate(rows) if i % HELD_BACK and r["quality"] == 1 and r["toxic"] == 0]
    return Labels(np.array(sorted(target), np.int64), held)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))


def log_ratios(docs: DataFrame, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket, from counts over all of `docs`.  Without target documents all are 0.

    A task sends one dense block of counts per `BLOCK` buckets it saw; blocks are added up in parallel and the sums,
    a fixed number whatever the input, form the model.
    """
    size = FAMILIES * BUCKETS
    ddl, schema = "block int, raw binary, target binary", pa.schema([("block", pa.int32()), ("raw", pa.binary()), ("target", pa.binary())])
    wanted = set(target.tolist())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            all_, few = [], []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                buckets = [b for _, b in _FEATURES(text)]
                all_ += buckets
                if doc_id in wanted:
                    few += buckets
            for sums, seen in ((raw, all_), (good, few)):
                if seen:
                    sums += np.bincount(np.concatenate(seen), minlength=size)
        yield from _blocks(((b, raw[b * BLOCK : (b + 1) * BLOCK], good[b * BLOCK : (b + 1) * BLOCK]) for b in range(size // BLOCK)), schema)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for block, raw, good in rows_of(batches, "block", "raw", "target"):
            new = [np.frombuffer(x, np.int64) for x in (raw, good)]
            sums[block] = [a + b for a, b in zip(sums[block], new)] if block in sums else new
        yield from _blocks(((b, *s) for b, s in sums.items()), schema)

    parts = size // BLOCK
    summed = _texts(docs).mapInArrow(count, ddl).repartition(min(parts, 64), "block").mapInArrow(add, ddl)
    raw, good = np.zeros(size), np.zeros(size)
    for row in summed.collect():
        at = slice(row["block"] * BLOCK, (row["block"] + 1) * BLOCK)
        raw[at], good[at] = np.frombuffer(row["raw"], np.int64), np.frombuffer(row["target"], np.int64)
    ratios = np.zeros(size, np.float32)
    for f in range(FAMILIES):
        at = slice(f * BUCKETS, (f + 1) * BUCKETS)
        if good[at].any():
            expected = raw[at] * (good[at].sum() / raw[at].sum())
            ratios[at] = np.clip(np.log((good[at] + prior) / (expected + prior)), -3, 3)
    return ratios


def _blocks(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = [(b, raw.tobytes(), good.tobytes()) for b, raw, good in rows if raw.any()]
    for at in range(0, len(held), 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held[at : at + 16]), schema)], schema=schema)


def weights(docs: DataFrame, ratios: np.ndarray, window: int = WINDOW, carry: bool = False) -> DataFrame:
    """doc_id, log_weight, mean, weakest of every row; with `carry` also the row itself as a struct `row`.

    A text without words has zeros.
    """
    names = ("log_weight", "mean", "weakest")

    def score(text: bytes) -> tuple[float, float, float]:
        families = _FEATURES(text)
        n = len(families[0][0])
        if not n:
            return 0.0, 0.0, 0.0
        value = np.zeros(n)
        for where, buckets in families:
            value[where] += ratios[buckets]
        sums = np.cumsum(np.r_[0.0, value])
        return float(sums[-1]), float(sums[-1] / n), float((sums[window:] - sums[:-window]).min() if n >= window else sums[-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([score(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            kept = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in kept] + [pa.array(found[:, i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), *own)
    kind = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, f"doc_id long{kind}, log_weight double, mean double, weakest double")


def best_cut(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The cut under which most of `bad` and at most `loss` of `good` lies, halfway down to the next of `bad`.

    Without an example of either kind, or where nothing bad would be caught, nothing is cut: minus infinity.
    """
    if not len(good) or not len(bad):
        return -np.inf
    tried = [good.min(), *np.quantile(good, np.linspace(0, loss, 9))]
    cut = max(tried, key=lambda t: (good >= t).mean() + (bad < t).mean())
    below = bad[bad < cut]
    return float((cut + below.max()) / 2) if len(below) else -np.inf


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = 4_096, few: int = 50_000) -> float | None:
    """The k-th largest value of a double column, from histograms that close in on it; None when k is not in 1..rows."""
    ends = keys.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    lo, hi, inside = ends["lo"], ends["hi"], ends["n"]
    if not 1 <= k <= inside:
        return None
    above = 0
    while inside > few and hi > lo:
        step = (hi - lo) / bins
        bin_ = F.least(F.floor((F.col(key) - lo) / step), F.lit(bins - 1)).cast("int")
        found = keys.where(F.col(key).between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for row in sorted(found, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                lo, hi, inside = row["lo"], row["hi"], row["n"]
                break
            above += row["n"]
    if hi <= lo:
        return lo
    last = keys.where(F.col(key).between(lo, hi)).select(key).orderBy(F.desc(key)).limit(k - above).collect()
    return last[-1][key]


def gumbel_top_k(scored: DataFrame, score: str, k: int, temperature: float = TEMPERATURE, seed: int = 7) -> DataFrame:
    """The k rows of largest score + temperature x Gumbel noise, as `scored` with `key`.

    The noise is a hash of doc_id, so it is the same on every run; rows of equal keys at the end all stay.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = scored.withColumn("key", F.col(score) - F.lit(temperature) * F.log(-F.log(u)))
    least = kth_largest(keyed, "key", k)
    return keyed.where(F.lit(False) if least is None else F.col("key") >= least)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE, carry: bool = False) -> DataFrame:
    """doc_id, log_weight, mean, weakest, score, key of the documents sampled; with `carry` also `row`, the document itself.

    score is the smaller margin of mean and weakest over their cuts, learnt from held-back labels against low quality
    and against toxicity.  k is `share` of the rows, or the number of non-negative scores.
    Null and empty texts have weight 0, as if drawn from either model.  Without labelled good documents every
    score is 0 and all stay.  Rows that share an id are scored apart and share their noise.
    """
    sample = labelled(labels)
    found = materialize(weights(docs, log_ratios(docs, sample.target), carry=carry), "weights")
    spark = docs.sparkSession
    held = spark.createDataFrame([(i, q, t) for i, (q, t) in sample.held.items()], "doc_id long, quality int, toxic int")
    rows = found.df.join(F.broadcast(held), "doc_id").select("mean", "weakest", "quality", "toxic").collect()  # at most the held-back labels
    of = lambda name, keep: np.array([r[name] for r in rows if keep(r)])
    good = lambda r: r["quality"] == 1 and r["toxic"] == 0
    mean_cut = best_cut(of("mean", good), of("mean", lambda r: r["quality"] == 0))
    weak_cut = best_cut(of("weakest", good), of("weakest", lambda r: r["toxic"] == 1))
    margin = lambda name, cut: F.lit(0.0) if np.isinf(cut) else F.col(name) - F.lit(cut)
    scored = found.df.withColumn("score", F.least(margin("mean", mean_cut), margin("weakest", weak_cut)))
    k = scored.where("score >= 0").count() if share is None else round(share * found.rows)
    return gumbel_top_k(scored, "score", k, temperature)
