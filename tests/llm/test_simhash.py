import random

import numpy as np
import pytest
import xxhash

from pinchgraph.llm import simhash


def brute_fingerprint(text):
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.setdefault((doc_id, prints[i]), []).append(min(ids) if ids else None)
    return out


@pytest.mark.parametrize("radius,width", [(0, 1), (1, 1), (2, 1), (32, 2)])
def test_sliced_links_equals_brute_force(radius, width):
    rng = np.random.default_rng(radius)
    n = 300
    base = rng.integers(0, 2**64 - 1, (5, width), dtype=np.uint64, endpoint=True)
    fp = base[rng.integers(0, 5, n)].copy()
    for i in range(n):
        for bit in rng.integers(0, 64 * width, rng.integers(0, radius + 2)):
            fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    run = np.sort(rng.integers(0, 4, n))
    i, j = simhash.sliced_links(fp, run, radius)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if run[a] == run[b] and sum(int(x).bit_count() for x in fp[a] ^ fp[b]) <= radius}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def test_groups_equal_brute_force(docs_of, prose, odd):
    rng = random.Random(3)
    rows = list(odd)
    for i in range(60):
        words = prose(rng.choice([3, 40, 400]), i % 20).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "other"
        rows.append((100 + i, " ".join(words)))
    got = {}
    for r in simhash.near_duplicates(docs_of(rows)).collect():
        got.setdefault((r["doc_id"], r["fp"] % 2**64), []).append(r["component_id"])
    assert got == brute_components(rows)


def test_crowded_buckets_lose_no_link(llm, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 3)
    rng = random.Random(1)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    signed = [v - 2**64 if v >> 63 else v for v in values]
    got = [tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.linked_values(llm.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    want = {tuple(sorted((a, b))) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.similar_groups(docs_of([])).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_similar_groups(docs_of, prose, odd):
    """Every pair at similarity 0.8 with some margin is grouped, no group holds a text unlike all others of it."""
    rng = random.Random(5)
    rows = [r for r in odd if len(r[1] or "") < 5_000 and r[0] not in (5, None)]
    for i in range(120):
        words = prose(rng.choice([60, 300]), 1000 + i % 30).split()
        for _ in range(rng.randint(0, max(1, len(words) // 60))):
            words[rng.randrange(len(words))] = "other"
        rows.append((100 + i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs_of(rows)).collect()}
    links = [(a, b) for a, s in rows for b, t in rows if a < b and jaccard(s, t) >= 0.8]
    assert set(got) == {i for i, _ in rows}
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links) and len(links) > 50
    neighbours = {a for pair in links for a in pair}
    assert all(got[i] == i for i in got if i not in neighbours)


def test_hot_group_of_near_copies(docs_of, prose):
    words = prose(200, 9).split()
    rows = [(i, " ".join([*words[:i], "changed", *words[i + 1 :]])) for i in range(150)]
    got = simhash.similar_groups(docs_of(rows)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_equal_fingerprints_of_unlike_texts(docs_of, prose):
    """One line that makes up most of a text fixes every bit: such texts are no copies, and each keeps its own near copies."""
    line = "see our terms of use "
    texts = [line * 60 + prose(45, 70 + i) for i in range(3)]
    rows = list(enumerate(texts)) + [(10, texts[0].upper()), (11, texts[1])]
    assert jaccard(texts[0], texts[1]) < 0.2
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs_of(rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 10: 0, 11: 1}


def test_near_copies_that_repeat_a_line(docs_of, prose):
    """Similarity is that of sets: how often a line repeats does not matter."""
    rows = [(10 * i + k, prose(300, 600 + i) + " see our terms of use" * times) for i in range(12) for k, times in enumerate((1, 80))]
    assert all(jaccard(a[1], b[1]) > 0.95 for a, b in zip(rows[::2], rows[1::2]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs_of(rows)).collect()}
    assert got == {i: i - i % 10 for i, _ in rows}


def test_keep_one_keeps_columns_and_unaddressed_rows(docs_of, odd):
    docs = docs_of(odd)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and {1, 4, 6} <= set(ids) and 2 not in ids and 9 not in ids


def test_only_large_buckets(llm):
    """A batch whose buckets are all large: none is left for the comparison of small ones."""
    rng = np.random.default_rng(1)
    n = simhash.ALL_PAIRS + 20
    base = rng.integers(0, 2**63, 2)
    rows = np.stack([np.full(n, 7), np.arange(n), np.full(n, base[0]), base[1] ^ (np.int64(1) << rng.integers(0, 60, n))], 1).astype(np.int64)
    found = simhash._near_pairs(rows, np.zeros(n, np.int64))
    assert len(found) == n - 1 and set(found[:, 3]) == {1}


def test_open_members_are_linked_without_pairs_as_rows(docs_of, llm, monkeypatch, prose):
    """Members unlike their centre meet all others of their family in chunks; a task gives one link per open member and root."""
    monkeypatch.setattr(simhash, "MEMBER_SHINGLES", 2_000)
    monkeypatch.setattr(simhash, "LEFT_SHINGLES", 500)
    rng, base = random.Random(3), prose(300, 44).split()
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(300), i % 7):
            words[at] = f"w{i % 11}"
        texts.append(" ".join(words))
    docs = docs_of(list(enumerate(texts)))
    members = llm.createDataFrame([(1, i, 0 if i % 7 < 2 else i, i % 7 >= 2) for i in range(60)], "family long, node long, root long, open boolean")
    root = {r["node"]: r["root"] for r in members.collect()}
    found = simhash._links_of_rest(docs, members, 5, 0.8).collect()
    assert all(jaccard(texts[r["a"]], texts[r["b"]]) >= 0.8 and root[r["a"]] != root[r["b"]] for r in found)
    want = {(a, root[b]) for a in range(60) if a % 7 >= 2 for b in range(60) if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8}
    assert {(r["a"], root[r["b"]]) for r in found} == want and len(want) > 50
    whole = sum(jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b] for a in range(60) if a % 7 >= 2 for b in range(60))
    assert len(found) < whole


def test_what_connects_is_one_pair_a_node(llm, monkeypatch):
    """Members with a pair for each of many centres: the components stay, the pairs handed on no longer grow with the centres."""
    monkeypatch.setattr(simhash, "FEW_TASKS", 2)
    pairs = [(c, 1_000 + m) for m in range(300) for c in range(40) if (m + c) % 3] + [(5_000 + i, 5_001 + i) for i in range(50)] + [(9_000, 9_001)]
    step = simhash.materialize(llm.createDataFrame(pairs, "a long, b long"), "pairs")
    found = simhash._connecting(step)
    assert found.count() <= 2 * (340 + 51 + 2) < len(pairs) / 9
    roots = lambda df: {(r["node"], r["root"]) for r in simhash.components(df, "a", "b").collect()}
    assert roots(found) == roots(step.df)
    assert simhash._connecting(simhash.materialize(step.df.limit(0), "pairs")).count() == 0
