"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into strides of words, and each stride, and each passage of two, is compared.  Passages and benchmark items are TF-IDF vectors over the
words of the benchmark, without those that stand in too many documents; both numbers are counted over all documents.
A randomised SVD with one power iteration of the matrix of all passages of all documents and of the items of a block, run distributed, gives
the latent space, so nothing is fitted on a part of the documents; passages whose cosine with an item is high enough are candidates.  Candidates are checked on the words themselves: the longest common
subsequence with the item, in a stretch of text little longer than the item, must hold most of it, or a
smaller part together with the answer, its last words.  So paraphrases that swap, drop or insert words are found.

Items longer than a passage are sought by passages of their own, and checked whole.

Items made of common words, such as those that stand in a hot group of documents, cannot be told apart in that
space.  They are found by counting: documents with enough of an item's words are checked on the words, none is lost.

The benchmark is the stated query set: it is taken in blocks of `ITEMS` items, and each block passes over all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.llm.common import batches_of, rows_of, utf8
from pinchgraph.storage import drop_scratch, materialize, recorded_scratch

#: Words of a passage and of a stride, half of it.
PASSAGE, STRIDE = 64, 32
#: Items searched in one pass over the documents.
ITEMS = 5_000
#: Dimensions of the latent space, and those added while it is found.
DIMENSIONS, EXTRA = 128, 16
#: Words in a larger share of the documents, and in more than so many, have no weight.
COMMON = 0.2
COMMON_LEAST = 100
#: Cosine of a candidate at least.
COSINE = 0.4
#: Share of the weight of an item, or of a passage of a long item, that a candidate passage has at least.
MASS = 0.3
#: Cosine that a passage holding an item has to be expected to have for the item to be sought in the latent space.
EXPECTED = 0.6
#: Shares of an item in common subsequence: enough alone, and enough with the answer.
ALONE, WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: The last words of an item that count as its answer: a quarter, three at least.
ANSWER_PART = 4

#: Bytes of words: digits, letters (A-Z lower-cased) and all beyond ASCII; any other byte parts words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Block:
    """A block of items: ids, words as vocabulary numbers, and the vocabulary."""

    item_ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @staticmethod
    def of(rows: Iterable[tuple[int, str | None]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        ids, words = [], []
        for item_id, text in rows:
            found = words_of((text or "").encode())
            if found:
                ids.append(item_id)
                words.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found]))
        return Block(ids, words, vocabulary)

    def numbers(self, text: bytes) -> np.ndarray:
        """The words of a text as vocabulary numbers, -1 for others."""
        found = words_of(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))


def _starts(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words: the last one holds the end."""
    return np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def queries(items: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(item of each, words of each): items as they are, long ones as passages; those without weight are left out."""
    parts = [(i, w[s : s + PASSAGE]) for i, w in enumerate(items) for s in _starts(len(w)).tolist()]
    parts = [(i, part) for i, part in parts if weight[part].any()]
    return np.array([i for i, _ in parts], np.int64), [part for _, part in parts]


def survey(texts: DataFrame, block: Block) -> DataFrame:
    """Two kinds of rows, told apart by what is null.

    (word, documents, times): the words of the benchmark in each task, the documents that have it, and how often it stands in them.
    (doc_id, numbers, passages): each document with a word of the benchmark, its words as vocabulary numbers, and its passages that have one.
    """
    m, kind = len(block.vocabulary), _kind(len(block.vocabulary))
    carry = "doc_id" in texts.columns
    schema = pa.schema([("word", pa.int32()), ("documents", pa.int64()), ("times", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("passages", pa.int64())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        counts, times = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for doc_id, text in rows_of(batches, "doc_id", "text") if carry else ((None, text) for (text,) in rows_of(batches, "text")):
            numbers = block.numbers(text)
            seen, n = np.unique(numbers[numbers >= 0], return_counts=True)
            if len(seen):
                counts[seen] += 1
                times[seen] += n
                known = np.add.reduceat(numbers >= 0, np.arange(0, len(numbers), STRIDE)) > 0
                yield None, None, None, doc_id, numbers.astype(kind).tobytes(), int(np.count_nonzero(known[:-1] | known[1:])) if len(known) > 1 else 1
        for w in np.flatnonzero(counts):
            yield int(w), int(counts[w]), int(times[w]), None, None, None

    weigh = lambda row: len(row[4] or b"")
    return texts.mapInArrow(lambda it: batches_of(rows(it), schema, 5_000, weigh=weigh), "word int, documents long, times long, doc_id long, numbers binary, passages long")


def _kind(vocabulary: int) -> type:
    """The narrowest numbers that hold the words of a vocabulary and -1."""
    return np.int16 if vocabulary <= np.iinfo(np.int16).max else np.int32


def _numbers_of(column: pa.Array, vocabulary: int) -> list[np.ndarray]:
    """The words of each text: bytes as `survey` writes them, or lists."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(x, _kind(vocabulary)) for x in column.to_pylist()]
    return [np.array(x, np.int64) for x in column.to_pylist()]


def _weighted(texts: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, stride, start, last): the words of the texts that have weight and the stride each stands in, numbered through all texts;
    whether a stride starts a passage, and whether it is the last of its text."""
    length = np.array([len(t) for t in texts if len(t)], np.int64)
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    size = -(-length // STRIDE)
    first = np.cumsum(size) - size
    word = np.concatenate([t for t in texts if len(t)])
    at = np.flatnonzero(np.append(weight > 0, False)[word])  # -1 has none
    text = np.repeat(np.arange(len(length)), length)[at]
    stride = first[text] + (at - (np.cumsum(length) - length)[text]) // STRIDE
    last = np.zeros(size.sum(), bool)
    last[first + size - 1] = True
    start = ~last
    start[first[size == 1]] = True
    return word[at].astype(np.int64), stride, start, last


def _segment_sums(table: np.ndarray, pick: np.ndarray, begin: np.ndarray, at_once: int = 32) -> np.ndarray:
    """Sums of the rows `pick` of `table` over the segments of `pick` that begin at `begin`.

    The r-th rows of all segments are added together, which is quicker than `np.add.reduceat` on rows; long segments are sums of sums.
    """
    size = np.diff(begin, append=len(pick))
    if len(size) and size.max() > at_once:
        parts = -(-size // at_once)
        first = np.cumsum(parts) - parts
        inner = np.repeat(begin - at_once * first, parts) + at_once * np.arange(parts.sum())
        return _segment_sums(_segment_sums(table, pick, inner), np.arange(len(inner)), first)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    out = table[pick[begin]]
    for r in range(1, size[0] if len(size) else 0):
        n = np.searchsorted(-size, -r)
        out[:n] += table[pick[begin[:n] + r]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _stride_sums(word: np.ndarray, stride: np.ndarray, strides: int, scaled: np.ndarray, at_once: int = 4_096) -> np.ndarray:
    """The sum of the rows of `scaled` of the words of each stride; `stride` ascends."""
    out = np.zeros((strides, scaled.shape[1]), scaled.dtype)
    for low in range(0, strides, at_once):
        a, b = np.searchsorted(stride, [low, low + at_once])
        if a < b:
            begin = np.flatnonzero(np.diff(stride[a:b], prepend=-1))
            out[stride[a:b][begin]] = _segment_sums(scaled, word[a:b], begin)
    return out


def _gram(texts: list[np.ndarray], weight: np.ndarray, basis: np.ndarray, at_once: int = 4_096) -> np.ndarray:
    """A'(A basis), A the matrix of the unit TF-IDF rows of all passages of `texts`; a passage without weighted words has no row.

    A passage is two strides, so strides are added up once and passages are sums of neighbours.
    """
    out = np.zeros(basis.shape)
    word, stride, start, last = _weighted(texts, weight)
    scaled, square = (basis * weight[:, None]).astype(np.float32), weight**2
    for low in range(0, len(start), at_once):  # passages that start at these strides; the last one ends in the stride behind
        n = min(at_once, len(start) - low)
        a, b = np.searchsorted(stride, [low, low + n + 1])
        w, s = word[a:b], stride[a:b] - low
        if not len(w):
            continue
        two = ~last[low : low + n, None]
        parts = _stride_sums(w, s, n + 1, scaled)
        order = np.argsort(w, kind="stable")
        w, s = w[order], s[order]
        run = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])])  # a word in a stride
        times, rw, rs = np.diff(run, append=len(w)), w[run], s[run]
        own = np.bincount(rs, square[rw] * times**2, n + 1)
        meet = np.flatnonzero((rw[1:] == rw[:-1]) & (rs[1:] == rs[:-1] + 1))  # the same word in the next stride
        shared = np.bincount(rs[meet], square[rw[meet]] * times[meet] * times[meet + 1], n + 1)
        norm = own[:n] + np.where(two[:, 0], own[1:] + 2 * shared[:n], 0.0)
        inverse = np.divide(1.0, norm, out=np.zeros(n), where=start[low : low + n] & (norm > 0)).astype(np.float32)
        passage = (parts[:n] + np.where(two, parts[1:], 0)) * inverse[:, None]
        back = np.zeros_like(parts)
        back[:n] = passage
        back[1:] += np.where(two, passage, 0)
        begin = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[begin]] += _segment_sums(back, s, begin)
    return out * weight[:, None]


def _summed_gram(passages: DataFrame, rows: int, weight: np.ndarray, basis: np.ndarray, at_once: int = 256) -> np.ndarray:
    """A'(A basis) over the passages of all tasks, added up in parallel by blocks of words.

    Sums of tasks travel as whole numbers of a unit that `rows` passages cannot overflow, so the order in which they come changes nothing.
    """
    m, width = basis.shape
    ddl, schema = "block int, part binary", pa.schema([("block", pa.int32()), ("part", pa.binary())])
    most = max(1, rows) * PASSAGE**0.5 * max(1e-9, float(np.abs(basis).max()))  # of a product of a unit row of PASSAGE words, times the rows
    unit = 2.0 ** (ceil(log2(most)) - 61)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, width))
        for batch in batches:
            total += _gram(_numbers_of(batch.column("numbers"), m), weight, basis)
        whole = np.rint(total / unit).astype(np.int64)
        yield from batches_of(((b, whole[b * at_once : (b + 1) * at_once].tobytes()) for b in range(-(-m // at_once))), schema, 16)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b, part in rows_of(batches, "block", "part"):
            sums[b] = sums.get(b, 0) + np.frombuffer(part, np.int64)
        yield from batches_of(((b, s.tobytes()) for b, s in sums.items()), schema, 16)

    out = np.zeros((m, width))
    for r in passages.mapInArrow(project, ddl).repartition(min(64, -(-m // at_once)), "block").mapInArrow(add, ddl).collect():
        out[r["block"] * at_once : (r["block"] + 1) * at_once] = np.frombuffer(r["part"], np.int64).reshape(-1, width) * unit
    return out


def latent_space(passages: DataFrame, rows: int, items: list[np.ndarray], weight: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 3) -> np.ndarray:
    """Words x dimensions: right singular vectors of the TF-IDF matrix of all passages of the texts `passages(numbers)`, items included.

    `rows` is the number of these passages at least.  Items weigh as much as all passages together, so the space holds what sets them apart.
    Directions without weight are left out.
    """
    m = len(weight)
    width = min(m, dimensions + EXTRA)
    heavy = max(1.0, rows / max(1, len(items)))
    both = lambda basis: _summed_gram(passages, rows, weight, basis) + heavy * _gram(items, weight, basis)
    basis = np.linalg.qr(both(np.random.default_rng(seed).standard_normal((m, width))))[0]
    image = both(basis)
    basis, r = np.linalg.qr(image)
    left, values, _ = np.linalg.svd(r)
    return (basis @ left[:, values > 1e-6 * values[0]])[:, :dimensions].astype(np.float32)


def common_subsequence(masks: dict[int, int], size: int, text: Iterable[int]) -> int:
    """A bit per word of an item (of `size` words, `masks` says where each stands): zero where the longest common subsequence with `text` gains."""
    full = (1 << size) - 1
    row = full
    for w in text:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return full & ~row


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def checked(item: np.ndarray, text: np.ndarray, own: np.ndarray | None = None) -> tuple[float, float, int]:
    """(share of the item, share of its answer, start) of the best stretch of `text` a quarter longer than the item.

    `own` tells for each word of `text` whether the item has it, where that is known.
    """
    n = len(item)
    length, step = n + n // 4 + 2, max(1, n // 4)
    best = (0.0, 0.0, 0)
    starts = np.arange(0, max(1, len(text) - length + step), step)
    known = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.isin(text, item, kind="table") if own is None else own, out=known[1:])
    starts = starts[known[np.minimum(starts + length, len(text))] - known[starts] >= WITH_ANSWER * n]  # else no subsequence is long enough
    if not len(starts):
        return best
    answer = item[-max(3, n // ANSWER_PART) :]
    masks, answer_masks = _masks(item), _masks(answer)
    for at in starts.tolist():
        part = text[at : at + length].tolist()
        share = common_subsequence(masks, n, part).bit_count() / n
        if share >= WITH_ANSWER and share > best[0]:
            best = (share, common_subsequence(answer_masks, len(answer), part).bit_count() / len(answer), at)
            if share == 1:
                break
    return best


def is_leak(share: float, answer: float) -> bool:
    return share >= ALONE or (share >= WITH_ANSWER and answer >= ANSWER)


def told_apart(items: list[np.ndarray], weight: np.ndarray, common_text: float) -> np.ndarray:
    """Whether each item is sought in the latent space: its leaks keep some weight, and a passage that holds it has a cosine to it.

    A leak may lose all but `WITH_ANSWER` of the words, the weighted ones first, and `MASS` of those has to stay.  The expected cosine
    is that of a passage of which the rest is text with `common_text` of squared weight per word.
    """
    size = np.array([len(w) for w in items])
    weighted = np.array([np.count_nonzero(weight[w]) for w in items])
    square = np.array([(weight[w] ** 2).sum() for w in items])
    expected = np.sqrt(square / np.maximum(square + np.maximum(0, PASSAGE - size) * common_text, 1e-12))
    return (weighted * (1 - MASS) > (1 - WITH_ANSWER) * size) & (expected >= EXPECTED)


class Marks:
    """A table of words in which those of one text are marked for as long as they are looked up; -1 is no word."""

    def __init__(self, vocabulary: int):
        self.table = np.zeros(vocabulary + 1, bool)

    def held(self, words: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Whether each of `words` is one of `among`."""
        self.table[among] = True
        self.table[-1] = False
        out = self.table[words]
        self.table[among] = False
        return out


class SharedWords:
    """The items of which a document has enough words, by lists of items per word."""

    def __init__(self, items: list[np.ndarray], vocabulary: int):
        word = np.concatenate(items) if items else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(items)), [len(w) for w in items])
        cell, self.times = np.unique(word * max(1, len(items)) + item, return_counts=True)
        self.item = cell % max(1, len(items))
        self.start = np.searchsorted(cell // max(1, len(items)), np.arange(vocabulary + 1))
        self.need = WITH_ANSWER * np.array([len(w) for w in items])

        self.seen = np.zeros(vocabulary + 1, bool)  # the last stands for words of no item

    def enough(self, numbers: np.ndarray) -> list[int]:
        self.seen[:] = False
        self.seen[numbers] = True
        seen = np.flatnonzero(self.seen[:-1])
        size = self.start[seen + 1] - self.start[seen]
        place = np.arange(size.sum()) + np.repeat(self.start[seen] - np.cumsum(size) + size, size)
        return np.flatnonzero(np.bincount(self.item[place], self.times[place], len(self.need)) >= self.need).tolist()


def search(numbered: DataFrame, block: Block, weight: np.ndarray, space: np.ndarray, apart: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, share, answer_share, start (in words) of each document of `numbered(doc_id, numbers)` and item that leak.

    Items that are not `apart` are found by counting words, and their cosine is null.
    """
    ddl = "doc_id long, item_id long, cosine double, share double, answer_share double, start long"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer_share", pa.float64()), ("start", pa.int64())])
    scaled = (space * weight[:, None]).astype(np.float32)
    sought, counted = np.flatnonzero(apart), np.flatnonzero(~apart).tolist()
    of, parts_ = queries([block.words[i] for i in sought], weight)
    sought = sought[of]
    latent = np.stack([scaled[w].sum(0) for w in parts_]) if parts_ else np.zeros((0, space.shape[1]), np.float32)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    mass = np.array([weight[w].sum() for w in parts_])
    least = MASS * mass.min() if len(mass) else np.inf
    shared = SharedWords([block.words[i] for i in counted], len(block.vocabulary))

    def candidates(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(document, item, cell, greatest cosine) to check; a cell is four strides, so that neighbours are checked together."""
        word, stride, _, last = _weighted(docs, weight)
        if not len(word):
            return
        size = np.array([-(-len(numbers) // STRIDE) for numbers in docs])
        doc = np.repeat(np.arange(len(docs)), size)
        where = np.stack([doc, (np.arange(len(doc)) - (np.cumsum(size) - size)[doc]) * STRIDE], 1)
        parts, sums = _stride_sums(word, stride, len(doc), scaled), np.bincount(stride, weight[word], len(doc))
        vectors, weights, places = [], [], []
        behind = np.flatnonzero(~last) + 1
        for two in (False, True):  # single strides, and passages
            if two:
                parts[behind - 1], sums[behind - 1] = parts[behind - 1] + parts[behind], sums[behind - 1] + sums[behind]
            keep = np.flatnonzero((sums >= least) & (sums > 0))
            vectors.append(parts[keep])
            weights.append(sums[keep])
            places.append(where[keep])
        keys, cosines, most = [], [], 1 + max(map(len, docs)) // (4 * STRIDE)
        x, w, where_ = np.concatenate(vectors), np.concatenate(weights), np.concatenate(places)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        for a in range(0, len(x), 4_096):
            for b in range(0, len(latent), 1_024):
                close = x[a : a + 4_096] @ latent[b : b + 1_024].T
                close[w[a : a + 4_096, None] < MASS * mass[None, b : b + 1_024]] = -1
                i, j = np.nonzero(close >= cosine)
                keys.append((where_[a + i, 0] * len(block.words) + sought[b + j]) * most + where_[a + i, 1] // (4 * STRIDE))
                cosines.append(close[i, j])
        if not keys:
            return
        key, close = np.concatenate(keys), np.concatenate(cosines).astype(float)
        order = np.argsort(key, kind="stable")
        key, close = key[order], close[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            return
        pair, cell = np.divmod(key[first], most)
        doc, item = np.divmod(pair, len(block.words))
        yield from zip(doc.tolist(), item.tolist(), cell.tolist(), np.maximum.reduceat(close, first).tolist())

    def stretches(cells: Iterable[tuple[int, int, int, float]]) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, start, end, greatest cosine) of the words to check; those of a long item that meet are one."""
        held: tuple = ()
        for d, j, cell, close in cells:  # in order
            n, start = len(block.words[j]), cell * 4 * STRIDE
            reach = n if n <= PASSAGE else n + n // 4 + 2
            low, high = max(0, start - reach), start + 4 * STRIDE + PASSAGE + reach
            if held and n > PASSAGE and held[:2] == (d, j) and low <= held[3]:
                held = (d, j, held[2], high, max(close, held[4]))
            else:
                if held:
                    yield held
                held = (d, j, low, high, close)
        if held:
            yield held

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        marks = Marks(len(block.vocabulary))
        for batch in batches:
            docs = _numbers_of(batch.column("numbers"), len(block.vocabulary))
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple] = {}
            for d, j, low, high, close in stretches(candidates(docs)) if len(sought) else ():
                item, stretch = block.words[j], docs[d][low:high]
                if np.count_nonzero(marks.held(item, stretch)) < WITH_ANSWER * len(item):  # no subsequence can be long enough
                    continue
                share, answer, at = checked(item, stretch, marks.held(stretch, item))
                if is_leak(share, answer) and (share, answer) > best.get((d, j), (0.0, 0.0)):
                    best[d, j] = (share, answer, low + at, close)
            for d, numbers in enumerate(docs) if counted else ():
                for j in map(counted.__getitem__, shared.enough(numbers)):
                    share, answer, at = checked(block.words[j], numbers, marks.held(numbers, block.words[j]))
                    if is_leak(share, answer):
                        best[d, j] = (share, answer, at, None)
            for (d, j), (share, answer, at, close) in best.items():
                yield ids[d], block.item_ids[j], close, share, answer, at

    return numbered.mapInArrow(lambda it: batches_of(found(it), schema), ddl)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer_share, start: one row per row of `docs` and item found in it.

    Items are rows of `benchmark(item_id, text)`.  Null and empty texts and items match nothing; equal items are
    found each on its own; an item of words too common for the latent space is compared with every document by counting
    words, and its cosine is null.  No rows on either side give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    size = docs.count()
    blocks = max(1, -(-benchmark.count() // ITEMS))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, share double, answer_share double, start long")
    for b in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select(F.col("item_id").cast("long"), "text")
        block = Block.of(sorted(some.collect(), key=lambda r: (r[0] is None, r[0], r[1] or "")))
        if not block.words or not size:
            continue
        with recorded_scratch() as names:
            held = materialize(survey(texts, block), "survey", passages=F.sum("passages"))
            words, numbered = held.df.where("word is not null"), held.df.where("numbers is not null").select("doc_id", "numbers")
            seen = {r["word"]: (r["n"], r["times"]) for r in words.groupBy("word").agg(F.sum("documents").alias("n"), F.sum("times").alias("times")).collect()}
            n, times = np.array([seen.get(w, (0, 0)) for w in range(len(block.vocabulary))]).T
            weight = np.where(n > max(COMMON_LEAST, COMMON * size), 0.0, np.log((size + 1) / (n + 1)) + 0.1)
            apart = told_apart(block.words, weight, float((times * weight**2).sum() / max(1, times.sum())))
            items = queries([w for w, a in zip(block.words, apart) if a], weight)[1]
            space = latent_space(numbered.select("numbers"), held.metrics.get("passages") or 0, items, weight) if items else np.zeros((len(weight), 0), np.float32)
        found = search(numbered, block, weight, space, apart)
        if blocks > 1:  # so that the words of one block at a time take disk
            found = materialize(found, "leaks").df
            drop_scratch(docs.sparkSession, names)
        out = out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` without the documents found to leak.  Rows without an id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
