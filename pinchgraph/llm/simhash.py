"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made per document and compared once per distinct value.  Two values at most
two bits apart agree on at least two of four 16-bit segments, so six tables keyed by a pair of
segments hold every link.  A table's bucket is compared with its members stored vertically: plane p
holds bit p of 64 members per machine word, each query is XORed with all planes, and differences
are added in carry-save counters for 64 members at a time; entries of which every member exceeds the
radius are abandoned before the next planes are read.

`similar_groups` looks further, for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
These are about 19 of 128 bits apart, too far for exact keys, so its tables are keyed by random bits, as many
tables as find 99 of 100 pairs at 0.8 and more of closer ones, and candidates are checked on their shingle sets.

A bucket above `SPLIT` members is keyed once more by pairs of the four 8-bit segments of the 32 bits
that are not shared.  That is exact by the same argument, and bounds a bucket by 65,536 values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.llm.common import rows_of, utf8
from pinchgraph.operators.contraction import components
from pinchgraph.storage import Step, materialize

SEED = 42
RADIUS = 2
#: Members above which a bucket is keyed a second time.
SPLIT = 2_048
#: Comparison entries (query, word of 64 members) held at once.
ENTRIES = 1 << 18
SEGMENTS = list(combinations(range(4), 2))


def fingerprint(text: bytes, words: int = 3, digest=lambda s: xxhash.xxh64_digest(s, SEED)) -> bytes:
    """As long as a digest, most significant bit first: a bit is set when set in over half of the shingle hashes."""
    tokens = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes
    size = len(digest(b""))
    if not tokens:
        return bytes(size)
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(8 * size, np.int64)
    for start in range(0, n, 16_384):
        stop = min(n, start + 16_384)
        hashes = b"".join([digest(b" ".join(tokens[i : i + words])) for i in range(start, stop)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, size), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long.  A null text has no words, thus zero."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join(fingerprint(t, words) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _first_keys(fp: Column) -> Column:
    keys = [F.struct(F.lit(t).alias("t"), (F.shiftleft(_segment(fp, i, 16), 16).bitwiseOR(_segment(fp, j, 16))).alias("key")) for t, (i, j) in enumerate(SEGMENTS)]
    return F.array(*keys)


def _second_keys(fp: Column, t: Column) -> Column:
    """Keys of a crowded bucket: its table and key stay, pairs of 8-bit segments of the open bits follow."""
    per_table = []
    for i, j in SEGMENTS:
        k, m = (x for x in range(4) if x not in (i, j))
        rest = F.shiftleft(_segment(fp, k, 16), 16).bitwiseOR(_segment(fp, m, 16))
        pick = [F.struct(F.lit(s).alias("s"), F.shiftleft(_segment(rest, a, 8), 8).bitwiseOR(_segment(rest, b, 8)).alias("sub")) for s, (a, b) in enumerate(SEGMENTS)]
        per_table.append(F.array(*pick))
    return F.element_at(F.array(*per_table), t + 1)


def _owns(x: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether the pair with difference `x` is reported here: in the first table and sub-table that hold it."""
    def first(value: np.ndarray, bits: int) -> np.ndarray:
        same = [((value >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)) == 0 for i in range(4)]
        found = np.full(len(value), 9, np.int64)
        for n, (i, j) in reversed(list(enumerate(SEGMENTS))):
            found[same[i] & same[j]] = n
        return found

    own = first(x, 16) == t
    deep = np.flatnonzero(own & (s >= 0))
    if len(deep):
        rest = np.zeros(len(deep), np.uint64)
        for n, (i, j) in enumerate(SEGMENTS):
            k, m = (q for q in range(4) if q not in (i, j))
            y = x[deep]
            both = (((y >> np.uint64(16 * k)) & np.uint64(0xFFFF)) << np.uint64(16)) | ((y >> np.uint64(16 * m)) & np.uint64(0xFFFF))
            rest = np.where(t[deep] == n, both, rest)
        own[deep] = first(rest, 8) == s[deep]
    return own


def sliced_links(fp: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of values of one run at most `radius` bits apart; `run` is ascending.

    `fp` has a column per 64 bits.  Runs start at a word of their own, an entry is a query and a word of its run.
    Counters start at 2**k - 1 - radius, so a carry out of bit k - 1 says that a member exceeds the radius.
    """
    fp = fp if fp.ndim == 2 else fp[:, None]
    n, bits = len(fp), max(1, int(radius).bit_length())
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    word_at = np.r_[0, np.cumsum(words)]
    of = np.repeat(np.arange(len(starts)), sizes)
    rank = np.arange(n) - starts[of]
    place = word_at[of] * 64 + rank
    member = np.full(word_at[-1] * 64, -1, np.int64)
    member[place] = np.arange(n)
    pack = lambda b: np.packbits(b, bitorder="little").view(np.uint64)
    live = pack(member >= 0)

    def plane(p: int) -> np.ndarray:
        spread = np.zeros(word_at[-1] * 64, bool)
        spread[place] = (fp[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1) == 1
        return pack(spread)

    planes = [plane(p) for p in range(64 * fp.shape[1])]
    need = np.flatnonzero(sizes[of] > 1)  # a query looks at its own word and those after it
    per_query = words[of[need]] - rank[need] // 64
    found_i, found_j = [], []
    ends = np.cumsum(per_query)
    every, at = ~np.uint64(0), 0
    while at < len(need):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
        q = np.repeat(need[at:stop], per_query[at:stop])
        ahead = np.arange(len(q)) - np.repeat(np.cumsum(per_query[at:stop]) - per_query[at:stop], per_query[at:stop])
        w = word_at[of[q]] + rank[q] // 64 + ahead
        at = stop
        later = np.where(ahead == 0, every << (rank[q] % 64).astype(np.uint64) << np.uint64(1), every)
        later[(ahead == 0) & (rank[q] % 64 == 63)] = 0
        over = ~(live[w] & later)
        first = (1 << bits) - 1 - radius
        counter = [np.full(len(q), every if first >> i & 1 else np.uint64(0)) for i in range(bits)]
        for p, members in enumerate(planes):
            carry = members[w] ^ (np.uint64(0) - ((fp[q, p // 64] >> np.uint64(p % 64)) & np.uint64(1)))
            for i in range(bits):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            over |= carry
            if p % 8 == 7 and p > radius:
                keep = over != every
                if not keep.all():
                    q, w, over, *counter = (v[keep] for v in (q, w, over, *counter))
                    if not len(q):
                        break
        if len(q):
            hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            e, bit = np.nonzero(hits)
            found_i.append(q[e])
            found_j.append(member[w[e] * 64 + bit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _runs(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, run numbers) of batches sorted by the first `keys` of `columns`, longs all; the last, open run is held over."""
    held = np.zeros((0, len(columns)), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in columns], 1)])
        if not len(rows):
            continue
        new = np.r_[True, (rows[1:, :keys] != rows[:-1, :keys]).any(1)]
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield rows[:cut], np.cumsum(new[:cut])
        held = rows[cut:]
    if len(held):
        yield held, np.ones(len(held), np.int64)


def _compare(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows, run in _runs(batches, ("t", "key", "s", "sub", "fp"), 4):
        fp = rows[:, 4].copy().view(np.uint64)
        i, j = sliced_links(fp, run, radius)
        own = _owns(fp[i] ^ fp[j], rows[i, 0], rows[i, 2])
        yield pa.RecordBatch.from_arrays([pa.array(rows[i[own], 4]), pa.array(rows[j[own], 4])], schema=out)


def linked_values(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of the distinct fingerprints in `values(fp)` at most `radius` bits apart, each pair once."""
    keyed = values.select("fp", F.inline(_first_keys(F.col("fp"))))
    crowded = materialize(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("t", "key"), "crowded")
    flat = keyed.select("t", "key", F.lit(-1).alias("s"), F.lit(0).cast("long").alias("sub"), "fp")
    if crowded.rows:
        deep = keyed.join(crowded.df, ["t", "key"], "left_semi").select("t", "key", "fp", F.inline(_second_keys(F.col("fp"), F.col("t"))))
        flat = flat.join(crowded.df, ["t", "key"], "left_anti").unionByName(deep.select("t", "key", "s", "sub", "fp"))
    sorted_ = flat.repartition("t", "key", "s", "sub").sortWithinPartitions("t", "key", "s", "sub")
    return sorted_.mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of fingerprints at most `radius` bits apart.
    Null and empty texts have fingerprint zero and link like any other; repeated rows stay; rows with a
    null doc_id are kept, and have a null component where nothing else is linked.  Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "prints").df
    values = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "values").df
    links = materialize(linked_values(values.select("fp"), radius), "links").df
    roots = components(links, "a", "b").withColumnRenamed("node", "fp")
    joined = materialize(values.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots").df
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(joined.join(least, "root").select("fp", "component_id"), "labels").df
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """`docs` without those whose group has a smaller id.  Rows without an id cannot be addressed and stay."""
    gone = groups.where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)  # ids grow with the documents


#: Shingle words and Jaccard similarity of near copies.
WORDS, SIMILAR = 5, 0.8
#: Bits of 128 that candidates differ in at most: three standard deviations over the mean at `SIMILAR`.
FAR = 32
#: Members of a bucket up to which all its pairs are taken.
ALL_PAIRS = 16
#: Chance that a pair at `SIMILAR` shares a key, from which the number of tables follows.
FOUND = 0.99


def key_masks(rows: int, similar: float = SIMILAR, seed: int = 1) -> list[tuple[int, int]]:
    """(high, low) masks of the key bits of each table: as many bits as make buckets of random rows small."""
    bits = min(28, max(16, math.ceil(math.log2(max(2, rows))) - 2))
    agree = 1 - math.acos(2 * similar / (1 + similar)) / math.pi
    tables = math.ceil(math.log(1 - FOUND) / math.log(1 - agree**bits))
    rng, masks = np.random.default_rng(seed), []
    for _ in range(tables):
        mask = sum(1 << int(b) for b in rng.choice(128, bits, replace=False))
        masks.append(tuple((x ^ (1 << 63)) - (1 << 63) for x in (mask >> 64, mask & (1 << 64) - 1)))  # as signed longs
    return masks


def _hashes(text: bytes, words: int) -> np.ndarray:
    """A row of 16 bytes per shingle."""
    tokens = text.lower().split()
    n = max(1, len(tokens) - words + 1) if tokens else 0
    parts = [b"".join([xxhash.xxh3_128_digest(b" ".join(tokens[i : i + words])) for i in range(at, min(n, at + 16_384))]) for at in range(0, n, 16_384)]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 16)


def _long_prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hi, lo, set_hi, set_lo: the fingerprint of 128 bits, and a digest, of the set of shingles: repeats count once."""
    names = ["doc_id", "hi", "lo", "set_hi", "set_lo"]
    out = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for text in batch.column("text").to_pylist():
                raw = np.unique(_hashes(text, words).reshape(-1).view("S16")).tobytes()
                distinct = np.frombuffer(raw, np.uint8).reshape(-1, 16)
                counts = sum((np.unpackbits(distinct[i : i + 16_384], axis=1).sum(0, dtype=np.int64) for i in range(0, len(distinct), 16_384)), np.zeros(128, np.int64))
                prints += [np.packbits(2 * counts > len(distinct)).tobytes(), xxhash.xxh3_128_digest(raw)]
            columns = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[:, c]) for c in range(4))], schema=out)

    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id with the sorted hashes of its distinct shingles."""
    out = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column("text").to_pylist():
                tokens = text.lower().split()
                n = max(1, len(tokens) - words + 1) if tokens else 0
                hashes = np.frombuffer(b"".join(xxhash.xxh64_digest(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), ">i8")
                sets.append(np.unique(hashes).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], schema=out)

    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


#: Pairs that a task of `_connecting` holds at once, and the fewest tasks.
TASK_PAIRS, FEW_TASKS = 1 << 18, 4


def _connecting(pairs: Step) -> DataFrame:
    """(a, b): pairs that connect the same nodes as `pairs(a, b)`; a task hands on one pair for each of its nodes at most.

    A member of a large group has a pair in each table, most with another centre; what is connected takes one.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.stack([np.asarray(batch.column(c)) for c in ("a", "b")], 1) for batch in batches if batch.num_rows]
        if not rows:
            return
        nodes, place = np.unique(np.concatenate(rows), return_inverse=True)
        ends, label = place.reshape(-1, 2), np.arange(len(nodes))
        while True:
            roots = label[ends]
            roots = roots[roots[:, 0] != roots[:, 1]]
            if not len(roots):
                break
            np.minimum.at(label, roots.max(1), roots.min(1))
            while (label[label] != label).any():
                label = label[label]
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]], pa.int64()), pa.array(nodes[moved], pa.int64())], schema=out)

    tasks = max(FEW_TASKS, math.ceil(pairs.rows / TASK_PAIRS))
    return materialize(pairs.df.select("a", "b").repartition(tasks).mapInArrow(run, "a long, b long"), "connecting").df


def _similar(docs: DataFrame, pairs: DataFrame, words: int, similar: float) -> Step:
    """The pairs (a, b) whose shingle sets are similar enough.  Only texts in pairs are read into sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(_shingle_sets(docs.join(ids, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "sets").df
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.where(common >= similar * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "similar")


def _near_pairs(rows: np.ndarray, run: np.ndarray) -> np.ndarray:
    """(key, a, b, star) of rows (key, node, hi, lo) of equal run.

    A small bucket gives all its pairs within `FAR`.  In a larger one the member nearest to the majority of
    each bit is the centre; members within reach of it give one pair, with the centre, and the others all
    their pairs.
    """
    fp = rows[:, 2:4].copy().view(np.uint64)
    sizes = np.bincount(run)
    large = sizes[run] > ALL_PAIRS
    out = []
    small = np.flatnonzero(~large)
    i, j = sliced_links(fp[small], run[small], FAR)
    out.append(np.stack([rows[small[i], 0], rows[small[i], 1], rows[small[j], 1], np.zeros(len(i), np.int64)], 1))
    for r in np.unique(run[large]):
        at = np.flatnonzero(run == r)
        bits = np.unpackbits(fp[at].view(np.uint8), axis=1)
        middle = 2 * bits.sum(0, dtype=np.int64) > len(at)
        centre = int((bits != middle).sum(1).argmin())
        reach = (bits != bits[centre]).sum(1) <= FAR
        star, rest = at[reach & (np.arange(len(at)) != centre)], at[~reach]
        out.append(np.stack([rows[star, 0], np.full(len(star), rows[at[centre], 1]), rows[star, 1], np.ones(len(star), np.int64)], 1))
        if len(rest):
            i, j = sliced_links(fp[at], np.zeros(len(at), np.int64), FAR)
            open_ = ~reach[i] | ~reach[j]
            out.append(np.stack([rows[at[i[open_]], 0], rows[at[i[open_]], 1], rows[at[j[open_]], 1], np.zeros(int(open_.sum()), np.int64)], 1))
    return np.concatenate(out)


#: Shingles of members, and of members to compare them with, that a task holds at once.
MEMBER_SHINGLES, LEFT_SHINGLES = 1 << 20, 1 << 18


def _links_between(left: pa.Table, right: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (a, b) of rows (node, root, shingles) of both sides that are similar enough and of unequal root; one for a and each root."""
    flat = lambda t: np.asarray(t.column("shingles").combine_chunks().flatten())
    size = lambda t: np.asarray(t.column("shingles").combine_chunks().value_lengths()).astype(np.int64)
    n, (lsize, rsize) = left.num_rows, (size(left), size(right))
    of = np.repeat(np.arange(n), lsize)
    order = np.argsort(flat(left), kind="stable")
    values, start, times = np.unique(flat(left)[order], return_index=True, return_counts=True)
    of, shingles, row = of[order], flat(right), np.repeat(np.arange(right.num_rows), rsize)
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
    hit = values[at] == shingles
    at, row = at[hit], row[hit]
    common = np.zeros(right.num_rows * n, np.int64)
    ends, done = np.cumsum(times[at]), 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 22), "right")))
        t = times[at[done:stop]]
        place = np.arange(t.sum()) + np.repeat(start[at[done:stop]] - np.cumsum(t) + t, t)
        common += np.bincount(np.repeat(row[done:stop], t) * n + of[place], minlength=len(common))
        done = stop
    common = common.reshape(right.num_rows, n)
    lroot, rroot = (np.asarray(t.column("root")) for t in (left, right))
    j, i = np.nonzero((common >= similar * (rsize[:, None] + lsize[None, :] - common)) & (rroot[:, None] != lroot[None, :]))
    _, first = np.unique(np.stack([i, rroot[j]], 1), axis=0, return_index=True)
    return np.asarray(left.column("node"))[i[first]], np.asarray(right.column("node"))[j[first]]


def _links_of_rest(docs: DataFrame, members: DataFrame, words: int, similar: float) -> DataFrame:
    """(a, b): links of the open ones among `members(family, node, root, open)` with members of their family of another root.

    Both sides are dealt into chunks of bounded size that meet in tasks; no pair of members is a row, and a task gives
    one link for an open member and each root.
    """
    sets = _shingle_sets(docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), words).dropDuplicates(["doc_id"])
    rows = materialize(members.join(sets.withColumnRenamed("doc_id", "node"), "node"), "members").df
    size = F.size("shingles").cast("long")
    shape = rows.groupBy("family").agg(F.ceil((F.sum(size) + 1) / MEMBER_SHINGLES).cast("int").alias("chunks"), F.ceil((F.sum(F.when(F.col("open"), size)) + 1) / LEFT_SHINGLES).cast("int").alias("tiles"))
    dealt = rows.join(shape, "family").select("family", "node", "root", "open", "shingles", "chunks", "tiles")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("open").select("family", part("tiles").alias("i"), every("chunks").alias("j"), "node", "root", "shingles")
    right = dealt.select("family", every("tiles").alias("i"), part("chunks").alias("j"), "node", "root", "shingles")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own beside those of `left`

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _links_between(a, b, similar)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    keys = ["family", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """doc_id, component_id of every row with an id: groups linked by shingle sets of Jaccard similarity `similar` or more.

    Rows of equal shingle sets are one class; those of equal fingerprint alone are candidates like others.  Large buckets of copies are compared with their central member
    first, which joins them with as many pairs as members; members that fail there are then compared with all others
    that candidates join them to (`_links_of_rest`).  Texts without words are copies of one another.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(_long_prints(known, words), "prints").df
    values = materialize(prints.groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("v")).select("set_hi", "set_lo", F.col("v.doc_id").alias("node"), "v.hi", "v.lo"), "values")
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h"), F.lit(low).alias("l")) for i, (h, low) in enumerate(key_masks(values.rows, similar))])
    keys = F.transform(masks, lambda m: F.xxhash64(m["i"], F.col("hi").bitwiseAND(m["h"]), F.col("lo").bitwiseAND(m["l"])))
    keyed = values.df.select(F.explode(keys).alias("key"), "node", "hi", "lo")
    out = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("star", pa.int64())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run in _runs(batches, ("key", "node", "hi", "lo"), 1):
            found = _near_pairs(rows, run)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(4)], schema=out)

    near = materialize(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(compare, "key long, a long, b long, star long"), "near").df
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = materialize(ordered(near), "pairs")
    links = _connecting(_similar(known, first.df, words, similar))
    groups = components(links, "a", "b")
    # a member that is not like its centre may still be like another member of what its candidates join
    rooted = lambda side: groups.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    stars = near.where("star = 1").select("a", "b").distinct().join(rooted("a"), "a", "left").join(rooted("b"), "b", "left")
    failed = materialize(stars.where("ra is null or rb is null or ra <> rb").select(F.col("b").alias("node")).distinct(), "failed")
    if failed.rows:
        families = components(_connecting(first), "a", "b").withColumnRenamed("root", "family")
        wanted = families.join(failed.df, "node", "left_semi").select("family").distinct()
        members = families.join(wanted, "family", "left_semi").join(groups, "node", "left").join(failed.df.withColumn("open", F.lit(True)), "node", "left")
        members = members.select("family", "node", F.coalesce("root", "node").alias("root"), F.coalesce("open", F.lit(False)).alias("open"))
        more = materialize(_links_of_rest(known, members, words, similar), "rest")
        if more.rows:
            groups = components(links.unionByName(more.df), "a", "b")
    grouped = values.df.join(groups, "node", "left").select("set_hi", "set_lo", F.coalesce("root", "node").alias("component_id"))
    labels = materialize(grouped, "labels").df  # a root is the smallest node of its group
    return prints.join(labels, ["set_hi", "set_lo"]).select("doc_id", "component_id")
