"""Exact deduplication and source divergence against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from pinchgraph.llm import copies, divergence


def brute_groups(rows):
    of = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        of[digest].append((doc_id is None, doc_id if doc_id is not None else 0, i))
    out = []
    for digest, members in of.items():
        none, first, _ = min(members)
        for n, (is_none, doc_id, _) in enumerate(sorted(members)):
            out.append((None if is_none else doc_id, None if none else first, len(members), n == 0, digest))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("counters", [16, 4_096])
def test_groups_equal_brute_force(docs_of, odd, prose, counters):
    """A text that a third of the rows share, one in upper case and with other spaces, and many of their own."""
    rows = [*odd, *[(100 + i, "hot  text\n" if i % 2 else "hot text ") for i in range(400)], *[(1000 + i, prose(5, i % 700)) for i in range(800)],
            *[(3000 + i, "Hot text ") for i in range(3)]]
    got = copies.exact_groups(docs_of(rows).repartition(7), counters)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert order([tuple(r) for r in got.collect()]) == order(brute_groups(rows))
    kept = copies.without_copies(docs_of(rows).repartition(7), counters)
    assert "_rank" in kept.columns
    assert order([(r["doc_id"],) for r in kept.collect()]) == order([(r[0],) for r in brute_groups(rows) if r[3]])


def test_every_frequent_digest_is_a_candidate(llm, docs_of, prose):
    rows = [(i, f"often {i % 5}" if i % 3 == 0 else f"once {i}") for i in range(6_000)]
    from pyspark.sql import functions as F
    keyed = docs_of(rows).repartition(9).select("doc_id", copies.digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    found = [r["digest"] for r in copies.frequent(keyed, 64).collect()]
    assert len(found) <= 64
    assert {hashlib.sha256(f"often {k}".encode()).hexdigest() for k in range(5)} <= set(found)


def test_groups_without_python_and_without_rows(llm, docs_of):
    got = copies.exact_groups(docs_of([(1, "a")]))
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    none = docs_of([(1, "a")]).limit(0)
    assert copies.exact_groups(none).count() == 0 and copies.without_copies(none).count() == 0


def brute_divergence(rows, least, top):
    """rows: (text, lang, source)."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold)), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        held = Counter(w for words, g, _ in docs if g == lang for w in set(words))
        kept = {w for w, n in held.items() if n >= least}
        groups = {s: Counter() for _, g, s in docs if g == lang}
        for words, g, s in docs:
            if g == lang:
                groups[s].update(w for w in words if w in kept)
        whole = sum(groups.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (c.total() + 5 * len(kept))
        for s, c in groups.items():
            parts = {"pair": [(sum(abs(share(c, w) - share(o, w)) for w in kept), t) for t, o in groups.items() if t != s],
                     "term": [(share(c, w) - share(whole, w), w) for w in kept if c[w] and share(c, w) > share(whole, w)]}
            for part, found in parts.items():
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(found) if part == "pair" or n < top]
    return out


def test_slices_cut_no_term():
    text = b"Ab cd\xc3\xa9f--" + b"x" * 50 + b"\nG h" * 20
    whole = [w for words in divergence.terms_of(text) for w in words]
    assert whole[:3] == [b"ab", b"cd\xc3\xa9f", b"x" * 50]
    for size in (1, 7, 30):
        assert [w for words in divergence.terms_of(text, size) for w in words] == whole


@pytest.mark.parametrize("least,tile,map_bits", [(3, 128, 1 << 26), (2, 2, 64), (10_000, 128, 1 << 26)])
def test_divergence_equals_brute_force(llm, prose, odd, least, tile, map_bits):
    """Terms that share long prefixes, terms of one and of 4,000 bytes, hot sources, null groups, groups without terms, a full bit map."""
    rows = [(prose(60, i % 9) + f" Éclair{'x' * (i % 5)} {'prefix' * 12}{i % 3}q ſt'A_b-c", ["en", "de", None][i % 3], ["hot", "hot", None, "s1", "s2", "s3"][i % 6]) for i in range(120)]
    rows += [("z" * 4_000, "en", "s1")] * 4 + [("123 ... \n", "en", "bare"), (None, "xx", "only"), ("", "xx", "other"), ("eins", "yy", "alone")]
    rows += [(t, "odd", f"o{i % 3}") for i, (_, t) in enumerate(odd)]
    df = llm.createDataFrame([(1, *r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, rank string, terms long").repartition(5)
    got = divergence.divergence(df, least, 4, tile, 16, map_bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_divergence(rows, least, 4))


def test_divergence_of_no_rows(llm):
    assert divergence.divergence(llm.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def _one_block(prose):
    block = divergence._Block()
    texts = ["", *(prose(120, seed) for seed in range(3_000)), " 12 "]
    for i, text in enumerate(texts):
        block.add(text.encode(), ("ab"[i % 2], "xyz"[i % 3]))
    return texts, block.row()


def test_stored_blocks_are_small_and_open_again(prose):
    texts, row = _one_block(prose)
    view = divergence._View(row, 0)
    names = [bytes(view.blob[a : a + n]).decode() for a, n in zip(view.starts, view.sizes)]
    found = [{} for _ in texts]
    for doc, term, n in zip(view.doc.tolist(), view.term.tolist(), view.n.tolist()):
        found[doc][names[term]] = n
    assert found == [{w: t.split().count(w) for w in t.split() if w.isalpha()} for t in texts]
    assert names == sorted(names) and row.nbytes < 4 * len(view.term)  # 8 bytes a term of a document before
    nothing = divergence._Block()
    nothing.add(b"", ("a", "x"))
    assert not len(divergence._View(nothing.row(), 0).term)


def test_hashes_in_pieces_are_those_at_once(prose):
    words = [w.encode() for w in prose(500, 1).split()]
    sizes = np.array([len(w) for w in words])
    given = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes, np.arange(len(words), dtype=np.uint64)
    whole = divergence._hashes(*given)
    for at_once in (1, 7, 100):
        assert (divergence._hashes(*given, at_once) == whole).all()


def test_counting_a_block_needs_little_memory(prose):
    """Peak of the arrays of the last count: 41 bytes for each byte of terms before, 10 now."""
    texts, row = _one_block(prose)
    view = divergence._View(row, 0)
    group, names = view.group[view.doc].astype(np.int64), [x for pair in zip(view.langs, view.sources) for x in pair]
    size, given = int(view.sizes[view.term].sum()), (view.starts[view.term], view.sizes[view.term], view.n)
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in divergence._parts(names, group, view.blob, *given, 256))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 256 and size > 2_000_000 and peak < 24 * size
