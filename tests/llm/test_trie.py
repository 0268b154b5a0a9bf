"""The prefix trie of conversations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pinchgraph.llm import trie


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            item = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0, item), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = (*own.get(lender, [])[:h], *turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = {p: [0, 0] for p in members}
    inner = {p[:-1] for p in members if p}
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in inner
            below[p[:d]][1] += (len(m) - 1) * words
    out = []
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def family(seed):
    """Conversations that share prefixes of many lengths, a deep one with copies, absent lenders, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), *range(-45, -30)]:
        if c % 40 == 20:
            continue  # a lender that is absent
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t, ["user", "assistant", None, ""][(t + rng.randint(0, 1)) % 4], rng.choice(["a b", "c", "", None, " x\ty z "])) for t in range(n)]
    deep = [("user", f"step {i % 7}") for i in range(60)]
    for c in (200, 220, 240, 260, 300):
        rows += [(c, t, *x) for t, x in enumerate(deep[: 60 if c < 260 else 40])]
    rows += [(301, None, "user", "no turn"), (301, None, "user", "no turn"), (301, 1, "user", "x"), (301, 1, "user", "y"), (None, 0, "user", "lost"), (302, 5, None, None)]
    rows += [(303, 0, "user", "tail " * 5_000)] * 30
    rng.shuffle(rows)
    return rows


def frame(llm, rows):
    from pyspark.sql import functions as F
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "owner", "salt", "place", "weight"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(6)


@pytest.mark.parametrize("small,salt_bits", [(32_768, 12), (40, 3)])
def test_trie_equals_brute_force(llm, monkeypatch, small, salt_bits):
    """Whole in a task, and by rounds over components with conversations cut into salts of eight turns."""
    monkeypatch.setattr(trie, "SALT_BITS", salt_bits)
    rows = family(small)
    got = trie.prefix_trie(frame(llm, rows), small)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_no_conversations(llm):
    assert trie.prefix_trie(frame(llm, [(1, 0, "user", "x")]).limit(0)).count() == 0
    assert trie.prefix_trie(frame(llm, [(None, 0, "user", "x")])).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "single"])
def test_decompose_equals_plain_sums(shape):
    rng = np.random.default_rng(5)
    n = 1 if shape == "single" else 400
    parent = np.array([-1] + [{"chain": i - 1, "star": 0}.get(shape, int(rng.integers(0, i)) if i else 0) for i in range(1, n)])
    values = rng.integers(0, 9, n)
    want = values.copy()
    for v in range(n - 1, 0, -1):
        want[parent[v]] += want[v]
    assert (trie.decompose(parent, rng.integers(1, 5, n), values)[0] == want).all()
