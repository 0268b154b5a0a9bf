"""Packing by cutting-stock column generation.

Documents become token pieces of at most one sequence; only the histogram of piece lengths reaches the
driver, in classes of `STEP` tokens (at most `length / STEP` numbers whatever the input).  A linear
program over patterns, combinations of classes that fit one sequence, is solved by column generation:
its duals price the classes, a knapsack dynamic program finds the pattern worth most, and the simplex
step takes it in until none is worth more than a sequence.  Patterns are used a whole number of times
and what rounding leaves open, a few pieces per class, is placed first-fit by falling length.
Pieces are then ranked inside their class in bounded blocks, and a piece's rank says pattern, copy
and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinchgraph.llm.common import batches_of, rank_in_blocks, rows_of, utf8
from pinchgraph.storage import materialize

LENGTH = 2048
#: Tokens per length class: lengths are rounded up to it while patterns are built, never in the output.
STEP = 8
END = 1
#: Words kept by a worker's cache before it starts anew.
CACHE = 600_000
#: Words handed to the tokenizer at once.
LEARNT = 20_000
#: Bytes of text coded together, and one text more.
TOGETHER = 1 << 20
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which the vocabulary joins to letters


def _letters(word: bytes) -> bool:
    """Whether a word is letters only and stays as it is under composition and lower-casing."""
    text = word.decode()
    return text.isalpha() and is_normalized("NFC", text) and text.lower() == text


class WordCoder:
    """Ids of whole texts for a vocabulary that drops white space, codes words apart and lower-cases.

    Words recur, so their ids are kept.  A word is a run without ASCII white space; a tail of ASCII
    punctuation after a letter or digit a-z, 0-9 is a word of its own, since the vocabulary never joins the two.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}
        vocab = self.coder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if w.isalpha() or _letters(w)]  # these have one end of word each
        if plain:
            ids = np.array(self.coder.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                raw, at = ids.tobytes(), 0
                for word, cut in zip(plain, (cuts * 4).tolist()):
                    self.ids[word] = raw[at:cut]
                    at = cut
            else:
                words, plain = words + plain, []
        rest = [w for w in words if w not in self.ids]
        for word, e in zip(rest, self.coder.encode_batch([w.decode() for w in rest], add_special_tokens=False)):
            self.ids[word] = np.array(e.ids, np.uint32).tobytes()

    def _hold(self, words: set[bytes]) -> None:
        """Have the ids of all these words at hand."""
        missing = words.difference(self.ids)
        if len(self.ids) + len(missing) > CACHE:
            self.ids.clear()
            missing = words
        split = {w: core for w in missing if not w.isalnum() and (core := w.rstrip(PUNCTUATION)) and len(core) < len(w) and core[-1:].isalnum()}
        parts = {*missing.difference(split), *split.values(), *(w[len(core):] for w, core in split.items())}
        new = [p for p in parts if p not in self.ids]
        for at in range(0, len(new), LEARNT):
            self._learn(new[at : at + LEARNT])
        for word, core in split.items():
            self.ids[word] = self.ids[core] + self.ids[word[len(core):]]

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; words new to the worker are learnt for all texts together."""
        # a text with <| may hold a special token's string, which is found before anything else
        split = [None if b"<|" in text else text.lower().split() for text in texts]
        self._hold(set().union(*(words for words in split if words)))
        for text, words in zip(texts, split):
            if words is None:
                yield np.array(self.coder.encode(text.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                yield b"".join(map(self.ids.__getitem__, words))

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One per worker process."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of each row, with ids if asked for.

    A document's ids and the end id are cut into whole sequences and a tail.  A null text is empty: its
    only id is the end id.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    end = END.to_bytes(4, "little")

    def coded(rows: Iterable[tuple], code) -> Iterator[tuple]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= TOGETHER:
                yield from zip((r[0] for r in held), code([r[1] for r in held]))
                held, size = [], 0
        yield from zip((r[0] for r in held), code([r[1] for r in held]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        code = coder(vocabulary).encode_all
        for doc_id, ids in coded(rows_of(batches, "doc_id", "text"), code):
            ids += end
            n = len(ids) // 4
            for at in range(0, n, length):
                part = ids[4 * at : 4 * (at + length)]
                yield (doc_id, at, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(cut(batches), schema, weigh=(lambda r: len(r[-1])) if with_ids else None)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def best_pattern(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..len(values), class c of size c, in `room`: unbounded knapsack."""
    worth, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for r in range(1, room + 1):
        k = min(r, len(values))
        options = worth[r - k : r][::-1] + values[:k]
        c = int(options.argmax())
        worth[r], choice[r] = (options[c], c + 1) if options[c] > worth[r - 1] else (worth[r - 1], 0)
    counts, r = np.zeros(len(values), np.int64), room
    while r > 0:
        if choice[r]:
            counts[choice[r] - 1] += 1
            r -= int(choice[r])
        else:
            r -= 1
    return float(worth[room]), counts


def patterns(demand: np.ndarray, room: int, steps: int = 4_000, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows of class counts, how often each) that solve the linear program for demand[c - 1] pieces of class c.

    `steps` ends a degenerate run with the best solution so far, which still covers all demand.
    """
    used = np.flatnonzero(demand)
    m = len(used)
    fits = room // (used + 1)
    basis = np.diag(fits).astype(float)
    inverse = np.diag(1.0 / fits)
    amount = demand[used] / fits
    for _ in range(steps):
        prices = inverse.sum(0)
        values = np.zeros(len(demand))
        values[used] = np.maximum(prices, 0)
        worth, pattern = best_pattern(values, room)
        if worth <= 1 + eps:
            break
        column = pattern[used].astype(float)
        turn = inverse @ column
        ok = turn > 1e-9
        ratios = np.where(ok, amount / np.where(ok, turn, 1.0), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        amount = np.maximum(amount - step * turn, 0)
        amount[out] = step
        basis[:, out] = column
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
    out = np.zeros((m, len(demand)), np.int64)
    out[:, used] = basis.T.round().astype(np.int64)
    return out, amount


@dataclass(frozen=True)
class Plan:
    """Runs of equal sequences: `first[r]` is the id of the first one, `copies[r]` their number, `counts[r]` pieces per class."""

    first: np.ndarray
    copies: np.ndarray
    counts: np.ndarray

    @property
    def sequences(self) -> int:
        return int(self.copies.sum())


def plan(demand: np.ndarray, room: int) -> Plan:
    """Sequences for exactly demand[c - 1] pieces of class c."""
    demand = demand.astype(np.int64)
    runs: list[tuple[int, np.ndarray]] = []
    left = demand.copy()
    if demand.any():
        rows, amount = patterns(demand, room)
        for row, x in sorted(zip(rows, amount), key=lambda p: -p[1]):
            times = int(min(np.floor(x + 1e-6), *(left[row > 0] // row[row > 0]))) if row.any() else 0
            if times > 0:
                runs.append((times, row))
                left = left - times * row
        while left.any():  # what rounding left open: the fullest single sequence, as often as it fits
            row, space = np.zeros(len(left), np.int64), room
            for c in range(len(left), 0, -1):
                take = int(min(left[c - 1], space // c))
                row[c - 1], space = take, space - take * c
            times = int((left[row > 0] // row[row > 0]).min())
            runs.append((times, row))
            left = left - times * row
    copies = np.array([t for t, _ in runs], np.int64)
    counts = np.array([r for _, r in runs], np.int64).reshape(len(runs), len(demand))
    return Plan(np.r_[0, np.cumsum(copies)][:-1].astype(np.int64), copies, counts)


def _seat(made: Plan):
    """(class, rank) -> (sequence, place in it) for arrays; tables are as long as runs, not as pieces."""
    tables = {}
    for c in np.flatnonzero(made.counts.any(0)) if len(made.counts) else []:
        runs = np.flatnonzero(made.counts[:, c])
        per = made.counts[runs, c]
        before = np.cumsum(made.counts, 1)[runs, c] - per  # places taken by smaller classes
        tables[int(c) + 1] = (np.r_[0, np.cumsum(per * made.copies[runs])], per, before, made.first[runs])

    def seat(classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
        for c in np.unique(classes):
            at = np.flatnonzero(classes == c)
            upto, per, before, first = tables[int(c)]
            run = np.searchsorted(upto, ranks[at], "right") - 1
            inner = ranks[at] - upto[run]
            sequence[at] = first[run] + inner // per[run]
            place[at] = before[run] + inner % per[run]
        return sequence, place

    return seat


def pack(parts: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """The rows of `parts` (doc_id, start, length, ... of at most `length` tokens) with sequence_id and offset.

    Sequence ids count from 0 without gaps and offsets lie gapless from 0 in their sequence.  Equal
    pieces get places of their own, null ids are placed like others, no rows give no rows.
    """
    if length % step:
        raise ValueError("length must be a multiple of step")
    held = materialize(parts, "pieces")
    classed = held.df.withColumn("_class", F.ceil(F.col("length") / step).cast("int"))
    histogram = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()  # at most length / step rows
    demand = np.zeros(length // step, np.int64)
    for row in histogram:
        demand[row["_class"] - 1] = row["n"]
    seat = _seat(plan(demand, length // step))
    order = [F.col("doc_id"), F.col("start"), F.col("length"), F.col("ids_crc32")]
    ranked = rank_in_blocks(classed, ["_class"], order, held.rows, "_rank")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = seat(np.asarray(batch.column("_class")), np.asarray(batch.column("_rank")))
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("_place", pa.array(place))

    seated = ranked.mapInArrow(run, f"{ranked._jdf.schema().toDDL()}, sequence_id long, _place long")
    inside = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long"))).drop("_class", "_rank", "_place")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces packed with their ids; a sequence has at most `length` tokens."""
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("_p"))
    return grouped.select("sequence_id", F.aggregate("_p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"), F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"))
