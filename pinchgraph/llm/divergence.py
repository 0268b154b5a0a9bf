"""Source divergence audit: how far the term mixes of a language's sources lie apart.

Only terms held by enough documents of their language count.  They are found by iceberg refinement of
byte prefixes: level by level terms are cut to a longer prefix, the distinct documents of each prefix are
counted, and terms whose prefix falls below the threshold are not looked at again, since no longer
prefix can be in more documents.  A term that is no longer than the level's width is complete and is
kept if its own count reaches the threshold.

Texts are tokenised once, into blocks that number their own terms; levels and counts run over the blocks.
What a level keeps travels to the next as a bit map of fixed size.  A false hit there only costs work:
every level counts exactly, and kept terms are joined by their names at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pinchgraph.llm.common import batches_of, utf8
from pinchgraph.storage import materialize

LEAST_DOCS = 30
TOP_TERMS = 50
#: Smoothing and scale of a term's share: 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)).
ADDED, SCALE = 5, 1_000_000_000
#: Prefix widths double from here.
FIRST_WIDTH = 4
#: Bits of the map of kept prefixes, 8 MiB whatever the vocabulary.
MAP_BITS = 1 << 26
#: A text is cut up for tokenising in slices of about so many bytes, at white space.
SLICE = 4 << 20
#: Text of a block.
BLOCK_BYTES = 6 << 20
#: Bytes of terms that are worked on at once, and packed counts that leave a task together.
AT_ONCE, TOGETHER = 1 << 18, 64
#: Counts that a task gathers before it adds them up.
HELD = 150_000
#: Fewest and most buckets of the exchange of counts; in between one per block.
BUCKETS = (256, 65_536)
#: Sources and terms of one block of the pairwise sums.
TILE, CHUNK = 128, 2_048

#: Bytes that part terms become a space and A-Z lower case; the other bytes, all those of non-ASCII characters among them, stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BLOCK = pa.schema([("names", pa.list_(pa.string())), ("group", pa.binary()), ("held", pa.binary()), ("blob", pa.binary()), ("sizes", pa.binary()), ("term", pa.binary()), ("n", pa.binary())])
_PART = pa.schema([("bucket", pa.int32()), ("names", pa.list_(pa.string())), ("group", pa.binary()), ("blob", pa.binary()), ("sizes", pa.binary()), ("n", pa.binary())])
_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<string>' if pa.types.is_list(f.type) else {'binary': 'binary', 'int32': 'int', 'int64': 'long', 'string': 'string'}[str(f.type)]}" for f in schema)


def terms_of(text: bytes, slice_bytes: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, slice by slice."""
    at = 0
    while at < len(text):
        end = at + slice_bytes
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut >= at else len(text)  # one word longer than a slice stays whole
        yield text[at:end].translate(_FOLD).split()
        at = end


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 at the narrowest width that holds them all; the first byte tells the width."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _opened(data) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def _squeezed(data: bytes) -> bytes:
    """Compressed, so that Spark moves small rows; the first eight bytes tell the size."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _whole(data) -> pa.Buffer:
    data = memoryview(data)
    return pa.Codec("zstd").decompress(pa.py_buffer(data[8:]), int.from_bytes(data[:8], "little"))


class _Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = at = len(self)
        return at


class _Block:
    """Documents whose terms are numbered together: group number of each document, terms in byte order, and per document its terms and their counts.

    Numbers travel as packed and compressed arrays in binary columns: `held` and `sizes` are the terms of each document and
    the bytes of each term, `term` has the steps from one term of a document to its next, `names` holds lang and source of
    each group in turn.
    """

    def __init__(self):
        self.number = _Numbering()
        self.groups: dict[tuple, int] = {}
        self.group, self.pairs, self.bytes = [], [], 0

    def add(self, text: bytes, group: tuple) -> None:
        seen: Counter = Counter()
        for words in terms_of(text):
            seen.update(words)
        self.pairs.append((np.fromiter(map(self.number.__getitem__, seen), np.int32, len(seen)), np.fromiter(seen.values(), np.int32, len(seen))))
        self.group.append(self.groups.setdefault(group, len(self.groups)))
        self.bytes += len(text)

    def row(self) -> pa.RecordBatch:
        terms = sorted(self.number)
        rank = np.zeros(len(terms), np.int32)
        rank[np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        held = np.array([len(t) for t, _ in self.pairs], np.int64)
        step, n = [], []
        for term, count in self.pairs:
            term = rank[term]
            order = np.argsort(term)
            step.append(np.diff(term[order], prepend=np.int32(0)))
            n.append(count[order])
        numbers = [np.array(self.group), held, np.array([len(t) for t in terms], np.int64), np.concatenate(step), np.concatenate(n)]
        group, held, sizes, term, n = (_squeezed(_packed(x)) for x in numbers)
        names = [x for group in self.groups for x in group]
        packed = (group, held, _squeezed(b"".join(terms)), sizes, term, n)
        return pa.RecordBatch.from_arrays([pa.array([names], _BLOCK.field(0).type), *(pa.array([x], pa.binary()) for x in packed)], schema=_BLOCK)


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents of about BLOCK_BYTES of text each."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                block.add(batch.column("text")[i].as_py(), group)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row()
                    block = _Block()
        if block.group:
            yield block.row()

    read = docs.select(utf8(F.col("text")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return read.mapInArrow(cut, ddl(_BLOCK))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all bytes of the given pieces, one after the other, and each byte's place in its piece."""
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + inside, inside


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pieces(sizes: np.ndarray, at_once: int = AT_ONCE) -> Iterator[slice]:
    """Pieces of the given sizes in turn, about `at_once` bytes together."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right")))
        yield slice(a, b)
        a = b


def _hashes(blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
    """A 64-bit number for each piece of `blob` (none empty) and its seed.  Equal numbers of different pieces only cost work."""
    out = np.zeros(len(starts), np.uint64)
    for some in _pieces(sizes, at_once):
        at, inside = _spans(starts[some], sizes[some])
        part = (blob[at].astype(np.uint64) + np.uint64(1)) * _mixed(inside.astype(np.uint64) + np.uint64(1))
        out[some] = _mixed(np.add.reduceat(part, np.cumsum(sizes[some]) - sizes[some]) ^ seeds[some])
    return out


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)


class _View:
    """A stored block opened again."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c: _opened(_whole(batch.column(c)[i].as_buffer()))
        names = batch.column("names")[i].as_py()
        self.langs, self.sources = names[0::2], names[1::2]
        self.group, held, self.sizes, self.n = get("group").astype(np.int32), get("held").astype(np.int64), get("sizes").astype(np.int64), get("n")
        self.blob = np.frombuffer(_whole(batch.column("blob")[i].as_buffer()), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(held), dtype=np.int32), held)
        first = (np.cumsum(held) - held)[held > 0]
        step = get("term").astype(np.int32)
        step[first[1:]] -= np.add.reduceat(step, first)[:-1] if len(first) else step  # each document starts anew
        self.term = np.cumsum(step, dtype=np.int32)
        self.lang_names = sorted(set(self.langs))
        self.lang = np.array([self.lang_names.index(x) for x in self.langs], np.int32)[self.group][self.doc]  # of each (doc, term)

    def held(self, bits: np.ndarray, width: int | None) -> np.ndarray:
        """Which (doc, term) rows are in the bit map by their language and first `width` bytes, or by the whole term."""
        t = len(self.sizes)
        used = np.zeros((len(self.lang_names), t), bool)
        used[self.lang, self.term] = True
        if width is not None:
            used &= self.sizes > width  # shorter terms are complete since the level before
        lang, term = np.nonzero(used)
        sizes = self.sizes[term] if width is None else np.full(len(term), width)
        keys = _hashes(self.blob, self.starts[term], sizes, _seeds(self.lang_names)[lang]) & np.uint64(64 * len(bits) - 1)
        used[lang, term] = bits[keys >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1)
        return used[self.lang, self.term]


def _parts(names: list[str], group: np.ndarray, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of (group, term) dealt by their hash into packed rows, one per bucket."""
    if not len(group):
        return
    seeds = _seeds([f"{a}\0{b}" for a, b in zip(names[0::2], names[1::2])])
    bucket = (_hashes(blob, starts, sizes, seeds[group]) >> np.uint64(40)).astype(np.int64) & (buckets - 1)
    order = np.argsort(bucket, kind="stable")
    bucket, group, starts, sizes, n = bucket[order], group[order], starts[order], sizes[order], n[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])

    def rows() -> Iterator[tuple]:
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = blob[_spans(starts[a:b], sizes[a:b])[0]]
            yield int(bucket[a]), names, _packed(group[a:b]), here.tobytes(), _packed(sizes[a:b]), _packed(n[a:b])

    yield from batches_of(rows(), _PART, TOGETHER)


def _merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n): the sums of packed counts that reach `least`.

    A bucket is merged as its rows stream by, so a task holds its distinct terms and no more.
    """
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                if bucket != now:
                    yield from done(held)
                    held, size, now = [], 0, bucket
                get = lambda c: _opened(batch.column(c)[i].as_buffer()).astype(np.int64)  # noqa: E731, B023
                names, group, ends = batch.column("names")[i].as_py(), pa.array(get("group")), np.cumsum(get("sizes"))
                offsets = pa.py_buffer(np.r_[0, ends].tobytes())
                terms = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(batch.column("blob")[i].as_buffer())])
                held.append(pa.table([pa.array(names[0::2], pa.string()).take(group), pa.array(names[1::2], pa.string()).take(group), terms, pa.array(get("n"))], names=_COUNT.names))
                size += len(ends)
                if size > HELD:
                    held = [total(held)]
                    size = 2 * held[0].num_rows if 2 * held[0].num_rows > HELD else 0
        yield from done(held)

    def total(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum")])
        return sums.select(["lang", "source", "term", "n_sum"]).rename_columns(_COUNT.names)

    def done(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            sums = total(held)
            yield from sums.filter(pc.greater_equal(sums.column("n"), least)).cast(_COUNT).to_batches(20_000)

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, ddl(_COUNT))


def bit_map(kept: DataFrame, map_bits: int = MAP_BITS) -> np.ndarray:
    """The kept `term`s and their `lang` as bits; `map_bits` is a power of two.  At most map_bits / 64 words reach the driver, 8 MiB and their numbers."""
    out = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, langs = batch.column("term").to_pylist(), batch.column("lang").dictionary_encode()
            sizes = np.array([len(t) for t in terms], np.int64)
            seeds = _seeds(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
            keys = _hashes(np.frombuffer(b"".join(terms), np.uint8), np.cumsum(sizes) - sizes, sizes, seeds) & np.uint64(map_bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (keys & np.uint64(63))).view(np.int64))], schema=out)

    words = kept.select("lang", "term").mapInArrow(mark, ddl(out)).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(map_bits // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return bits


def _level(table: DataFrame, bits, before: int, width: int, buckets: int) -> DataFrame:
    """Packed counts of the distinct documents of each prefix of `width` bytes; a complete term has a space after it."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = _View(batch, i)
                live = v.held(bits.value, before) if bits is not None else np.ones(len(v.term), bool)
                if not live.any():
                    continue
                # terms are in byte order, so those of one prefix follow each other, the complete one first
                cut = np.minimum(v.sizes, width)
                first = np.r_[True, (cut[1:] != cut[:-1]) | (v.sizes[:-1] <= width)]
                same = np.flatnonzero(~first)
                for some in _pieces(cut[same]):
                    here = same[some]
                    a, _ = _spans(v.starts[here], cut[here])
                    b, _ = _spans(v.starts[here - 1], cut[here])
                    first[here] = np.logical_or.reduceat(v.blob[a] != v.blob[b], np.cumsum(cut[here]) - cut[here])
                prefix = np.cumsum(first) - 1
                heads = np.flatnonzero(first)
                pairs = v.doc[live].astype(np.int64) * len(heads) + prefix[v.term[live]]  # ascending
                once = np.r_[True, pairs[1:] != pairs[:-1]]  # a document counts once per prefix
                count_of = np.bincount(v.lang[live][once].astype(np.int64) * len(heads) + pairs[once] % len(heads), minlength=len(v.lang_names) * len(heads))
                at = np.flatnonzero(count_of)
                head = heads[at % len(heads)]
                # the keys' bytes: the prefix, and a space after a complete term
                sizes, ended = np.minimum(v.sizes[head], width), v.sizes[head] <= width
                long = sizes + ended
                starts = np.cumsum(long) - long
                data = np.full(int(long.sum()), 32, np.uint8)
                for some in _pieces(sizes):
                    data[_spans(starts[some], sizes[some])[0]] = v.blob[_spans(v.starts[head[some]], sizes[some])[0]]
                names = [x for lang in v.lang_names for x in (lang, "")]
                yield from _parts(names, at // len(heads), data, starts, long, count_of[at], buckets)

    return table.mapInArrow(count, ddl(_PART))


def frequent_terms(table: DataFrame, buckets: int, least: int = LEAST_DOCS, map_bits: int = MAP_BITS) -> DataFrame:
    """(lang, term): the terms in at least `least` documents of their language, by refinement of prefixes."""
    kept, bits, before, width = [], None, 0, FIRST_WIDTH
    while True:
        sums = _merged(_level(table, bits, before, width, buckets), least)
        ended = F.endswith("term", F.lit(b" "))
        step = materialize(sums.select("lang", "term", ended.alias("complete")), "prefixes", open=F.sum(F.when(~ended, 1).otherwise(0)))
        kept.append(step.df.where("complete").select("lang", F.expr("substring(term, 1, octet_length(term) - 1)").alias("term")))
        if not step.metrics.get("open"):
            break
        if bits is not None:
            bits.unpersist()
        bits = table.sparkSession.sparkContext.broadcast(bit_map(step.df.where("not complete"), map_bits))
        before, width = width, 2 * width
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return materialize(out, "kept").df


def _occurrences(table: DataFrame, kept: DataFrame, buckets: int, map_bits: int) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in each group that has any."""
    bits = table.sparkSession.sparkContext.broadcast(bit_map(kept, map_bits))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = _View(batch, i)
                use = v.held(bits.value, None)
                if not use.any():
                    continue
                key = v.group[v.doc[use]].astype(np.int64) * len(v.sizes) + v.term[use]
                order = np.argsort(key, kind="stable")
                key, n = key[order], v.n[use][order].astype(np.int64)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                group, term = np.divmod(key[first], len(v.sizes))
                names = [x for pair in zip(v.langs, v.sources) for x in pair]
                yield from _parts(names, group, v.blob, v.starts[term], v.sizes[term], np.add.reduceat(n, first), buckets)

    sums = _merged(table.mapInArrow(count, ddl(_PART)), 1)
    return sums.join(kept, ["lang", "term"], "left_semi")  # by name: a false hit of the bit map ends here


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)) in whole numbers."""
    above = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + ADDED * terms).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _tile_pair(key: tuple, rows: pa.Table, tile: int) -> pa.Table:
    """(lang, a, b, value, known) of one chunk of terms and two tiles of sources; rows without a term give each source's least share."""
    lang, x, y, _ = (k.as_py() for k in key)
    no, p = rows.column("no").to_numpy(), rows.column("p").to_numpy()
    named = rows.column("term").is_valid().to_numpy()
    term = rows.column("term").filter(pa.array(named)).combine_chunks().dictionary_encode()
    at = term.indices.to_numpy(zero_copy_only=False) if len(term) else np.zeros(0, np.int64)
    sources, least = np.unique(no[~named], return_index=True)
    shares = np.repeat(p[~named][least][:, None], max(1, len(term.dictionary)), 1)
    shares[np.searchsorted(sources, no[named]), at] = p[named]
    of_x, of_y = np.flatnonzero(sources // tile == x), np.flatnonzero(sources // tile == y)
    a, b, value = [], [], []
    for i in of_x:
        later = of_y[of_y > i]
        a.append(np.full(len(later), sources[i]))
        b.append(sources[later])
        value.append(np.abs(shares[later] - shares[i]).sum(1) if len(term) else np.zeros(len(later), np.int64))
    joined = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, b, value)]
    known = pa.array(np.full(len(joined[0]), len(term.dictionary) if len(term) else 0))
    return pa.table([pa.array([lang] * len(joined[0]), pa.string()), *map(pa.array, joined), known], names=["lang", "a", "b", "value", "known"])


def _pair_sums(counts: DataFrame, groups: DataFrame, tile: int, chunk: int) -> DataFrame:
    """(lang, a, b, value, known) for numbers a < b of a language's sources: the sum of |p_a - p_b| over `known` kept terms, all that a source of either tile has.

    Terms go through in chunks and sources in tiles, so a group holds chunk x 2 tile shares at most whatever
    the numbers of both; the work is one subtraction per term and pair that the result asks for.
    """
    bits = tile.bit_length() - 1
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / chunk))
    mine = F.shiftright("no", bits).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.shiftright(F.col("sources") - 1, bits).cast("int")), lambda t: F.struct(F.least(t, mine).alias("x"), F.greatest(t, mine).alias("y")))
    of = groups.select("lang", "source", "no", "least", "terms", F.explode(others).alias("tiles"))
    rows = counts.select("lang", "source", "term", "p").join(of, ["lang", "source"]).select(
        "lang", "tiles.x", "tiles.y", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"), "no", "term", "p")
    bases = of.select("lang", "tiles.x", "tiles.y", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("chunk"), "no", F.lit(None).cast("binary").alias("term"), F.col("least").alias("p"))
    parts = rows.unionByName(bases).groupBy("lang", "x", "y", "chunk").applyInArrow(lambda key, rows: _tile_pair(key, rows, tile), "lang string, a long, b long, value long, known long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("known").alias("known"))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, tile: int = TILE, chunk: int = CHUNK, map_bits: int = MAP_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ.

    Part `pair` has each other source of the language with the summed difference of shares over all kept terms,
    part `term` the kept terms that are more frequent in the source than in its language, the `top` largest.
    Each row counts as a document of its own, repeated rows and rows with null ids too.  Null text, lang and
    source are empty.  A language without kept terms has pairs of value 0; one with a single source has
    none.  Ties are ranked by item in UTF-8 order.  No rows give no rows; other columns are ignored.
    `tile`, `chunk` and `map_bits` (powers of two) change the work of a task, not the result.
    """
    step = materialize(blocks(docs.select("text", "lang", "source")), "blocks")
    buckets = min(BUCKETS[1], max(BUCKETS[0], 1 << max(0, step.rows - 1).bit_length()))
    kept = frequent_terms(step.df, buckets, least, map_bits)
    counts = materialize(_occurrences(step.df, kept, buckets, map_bits), "counts").df
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    seen = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = seen.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", zero)).withColumn("total", F.coalesce("total", zero))
    groups = groups.withColumn("least", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero))
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialize(groups.withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups").df
    shares = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))

    sums = materialize(_pair_sums(shares, groups, tile, chunk), "pairs").df
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "known"))
    name = lambda no, to: groups.select("lang", F.col("no").cast("long").alias(no), F.col("source").alias(to), F.col("least").alias(f"least_{no}"), F.col("terms").alias(f"terms_{no}"))
    lacked = (F.col("terms_a") - F.col("known")) * F.abs(F.col("least_a") - F.col("least_b"))  # terms that neither source has
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + lacked).alias("value"))

    over = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    usual = over.join(whole, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    terms = shares.join(usual, ["lang", "term"]).where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
