import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from pinchgraph.llm import bm25, chat

LEGAL = re.compile(r"(1?(23)+)?$")


def legal(path):
    """Whether a sequence of emitted roles is legal: system at most once and first, then user and assistant in turns."""
    return bool(LEGAL.match("".join(map(str, path))))


def brute_cost(roles):
    """Least cost over every labelling, every merge and every insertion of up to two empty turns before each turn and at the end."""
    fills = [()] + [(a,) for a in (1, 2, 3)] + [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    states = {(): 0}
    for role in roles:
        new = {}
        for path, cost in states.items():
            for label in (1, 2, 3):
                named = cost + (chat.RELABEL if label != role else 0)
                options = [(path + f + (label,), named + chat.INSERT * len(f)) for f in fills]
                if path and path[-1] == label:
                    options.append((path, named + chat.MERGE))
                for p, c in options:
                    if re.match(r"1?(23)*2?$", "".join(map(str, p))) and c < new.get(p, 99):
                        new[p] = c
        states = new
    return min(c + chat.INSERT * len(f) for p, c in states.items() for f in fills if legal(p + f) and (p + f or not roles))


def test_costs_equal_brute_force():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            path = chat.repair(roles)
            emitted = []
            for role, merged, before, after, _ in path:
                emitted += [*before] + ([] if merged else [role]) + [*after]
                assert not merged or emitted[-1 - len(after)] == role
            assert legal(emitted) and emitted, roles
            assert sum(s[4] for s in path) == brute_cost(roles), roles


def test_blocks_equal_the_whole():
    rng = random.Random(1)
    for _ in range(40):
        roles = [rng.randrange(4) for _ in range(rng.randint(2, 40))]
        cuts = sorted(rng.sample(range(1, len(roles)), min(3, len(roles) - 1)))
        blocks = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)])]
        ends = chat.between_blocks([chat.transfer(b) for b in blocks])
        parts = [s for b, (entry, exit_) in zip(blocks, ends) for s in chat.repair(b, entry, exit_)]
        assert sum(s[4] for s in parts) == sum(s[4] for s in chat.repair(roles))


def turns_of(llm, rows):
    return llm.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")


def test_repaired_and_rendered(llm, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rng = random.Random(2)
    roles = ["system", "user", "assistant", " Human ", "GPT", None, "tool", "USER"]
    rows = [(c, t, rng.choice(roles), rng.choice(["hi", None, "", "x <|user|> y", "z" * 5_000])) for c in (1, 2, None) for t in range(9)]
    rows += [(3, 0, "assistant", "a"), (4, 0, "user", "q"), (5, None, "user", "q"), (5, 1, "assistant", "r"), (6, 0, "user", "same"), (6, 0, "user", "same")]
    turns = turns_of(llm, rows)
    got = chat.repaired(turns).collect()
    assert Counter((r["conv_id"], r["turn"], r["role"]) for r in got) == Counter(r[:3] for r in rows)
    for conv in (1, 2, 3, 4, 5, 6, None):
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["seq"])
        text = "".join(r["piece"] for r in mine)
        emitted = [chat.ROLES.index(x) for x in re.findall(r"<\|(system|user|assistant)\|>\n", text)]
        assert legal(emitted) and emitted and text.count("<|end|>") == len(emitted)
        codes = [{"system": 1, "user": 2, "assistant": 3, " Human ": 2, "GPT": 3, "USER": 2}.get(r["role"], 0) for r in mine]
        assert sum(r["cost"] for r in mine) == sum(s[4] for s in chat.repair(codes))
    whole = {r["conv_id"]: r["text"] for r in chat.rendered(turns).collect()}
    assert whole[4] == "<|user|>\nq<|end|>\n<|assistant|>\n<|end|>\n"
    assert whole[3] == "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n"
    assert whole[6] == "<|user|>\nsame\n\nsame<|end|>\n<|assistant|>\n<|end|>\n"


def test_long_conversation_in_many_partitions(llm, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(500)]
    turns = turns_of(llm, [(1, i, r, "t") for i, r in enumerate(roles)] + [(2, 0, "user", "u")])
    got = sorted((r for r in chat.repaired(turns).collect() if r["conv_id"] == 1), key=lambda r: r["seq"])
    assert [r["turn"] for r in got] == list(range(500))
    codes = [{"system": 1, "user": 2, "assistant": 3}.get(r, 0) for r in roles]
    assert sum(r["cost"] for r in got) == sum(s[4] for s in chat.repair(codes))


def test_no_turns(llm):
    assert chat.repaired(turns_of(llm, [])).count() == 0


def brute_search(docs, queries, k):
    words = [(t or "").encode().lower().split() for _, t in docs]
    n, mean = len(docs), max(1.0, sum(map(len, words)) / max(1, len(docs)))
    df = Counter(w for ws in words for w in set(ws))
    tf = [Counter(ws) for ws in words]
    out = {}
    for q, text in queries:
        scores = []
        for (doc_id, _), counts, ws in zip(docs, tf, words):
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * counts[w] * 2.2 / (counts[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set((text or "").encode().lower().split()) if w in counts)
            if s > 0:
                scores.append((-round(s, 6), doc_id))
        out[q] = sorted(scores, key=lambda x: (x[0], x[1] is not None, x[1]))[:k]
    return {q: s for q, s in out.items() if s}


@pytest.mark.parametrize("documents,postings", [(16_384, 6_000_000), (7, 900)])
def test_top_k_equals_brute_force(llm, docs_of, prose, odd, monkeypatch, documents, postings):
    monkeypatch.setattr(bm25, "SHARD_DOCUMENTS", documents)
    monkeypatch.setattr(bm25, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 500)
    rows = list(odd) + [(100 + i, prose(5 + i % 90, i) + " ka lo mi" * (i % 3)) for i in range(160)]
    asked = [(q, t) for q, t in rows if q is not None and q % 20 == 0] + [(1, "ka LO\tunknown"), (2, ""), (3, None), (4, "nowhere")]
    got = {}
    for r in bm25.top_k(docs_of(rows), llm.createDataFrame(asked, "query_id long, text string"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_search(rows, asked, 10)
    assert set(got) == set(want)
    for q in want:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=2e-6)
        assert [d for _, d in got[q]] == [d for _, d in want[q]] or any(abs(a[0] - b[0]) < 2e-6 for a, b in itertools.pairwise(want[q]))


def test_pruning_opens_few_documents(prose):
    texts = [prose(60, i) for i in range(2_000)]
    terms, counts = zip(*(bm25.term_counts(t.encode()) for t in texts))
    row = dict(zip([f.name for f in bm25._INDEX], bm25._shard("s", list(range(2_000)), list(terms), list(counts))))
    df = Counter(w for t in terms for w in t.tolist())
    asked = [terms[i] for i in range(0, 2_000, 100)]
    idfs = bm25.idf(np.array([df[w] for t in asked for w in t.tolist()]), 2_000)
    opened = []
    found = list(bm25.search_shard(row, bm25.Queries(np.arange(20), np.cumsum([len(t) for t in asked]), np.concatenate(asked), idfs), 10, 60.0, opened))
    assert len(found) == 200 and sum(opened) < 0.25 * 20 * 2_000


def test_nothing_to_search(llm, docs_of):
    none = llm.createDataFrame([], "query_id long, text string")
    assert bm25.top_k(docs_of([]), none).count() == 0
    assert bm25.top_k(docs_of([(1, "a")]), none).count() == 0
    assert bm25.top_k(docs_of([]), llm.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_thresholds_carried_over_shards(prose):
    """Shards searched one after the other, each knowing the best before, give the k best of all, and read a part of their lists."""
    texts = [prose(30 + i % 200, i) + " the of and" * (i % 9) for i in range(1_500)] + [prose(60, i % 5) for i in range(40)] + [prose(30_000, 3), "", "alone"]
    parsed = [bm25.term_counts(t.encode()) for t in texts]
    df = Counter(w for t, _ in parsed for w in t.tolist())
    mean = sum(int(c.sum()) for _, c in parsed) / len(texts)
    asked = [parsed[i][0] for i in range(0, len(texts), 25)] + [parsed[1_540][0], parsed[1_542][0]]
    idfs = bm25.idf(np.array([df[w] for t in asked for w in t.tolist()]), len(texts))
    queries = bm25.Queries(np.arange(len(asked)), np.cumsum([len(t) for t in asked]), np.concatenate(asked), idfs)
    known, found, counts = np.zeros((len(asked), 10)), {}, []
    for first in range(0, len(texts), 400):
        terms, tfs = zip(*parsed[first : first + 400])
        ids = list(range(first, first + len(terms)))
        row = dict(zip([f.name for f in bm25._INDEX], bm25._shard("s", ids, list(terms), list(tfs))))
        for q, d, s in bm25.search_shard(row, queries, 10, mean, None, known, counts):
            found.setdefault(q, []).append((-s, d))
    for q, terms in enumerate(asked):
        weight = dict(zip(terms.tolist(), bm25.idf(np.array([df[w] for w in terms.tolist()]), len(texts))))
        scores = []
        for d, (t, c) in enumerate(parsed):
            s = sum(weight[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * c.sum() / mean)) for w, n in zip(t.tolist(), c.tolist()) if w in weight)
            if s > 0:
                scores.append((-round(s, 6), d))
        want = sorted(scores)[:10]
        got = sorted(found.get(q, []))[:10]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert {d for s, d in want if s < want[-1][0] - 2e-6} <= {d for _, d in got}
        assert np.sort(known[q])[::-1][: len(want)] == pytest.approx([-s for s, _ in want], abs=2e-6)
    read, held = np.sum(counts, 0)
    assert read < 0.7 * held


@pytest.mark.parametrize("together,cells,postings,columns", [(128, 1 << 20, 2_500_000, 1_024), (1, 1 << 20, 2_500_000, 1_024), (50, 3_000, 40, 3), (50, 1 << 20, 2_500_000, 0)])
def test_queries_taken_together(prose, monkeypatch, together, cells, postings, columns):
    """However queries are grouped and lists are laid out, the best are the same, and little more than they are scored in full."""
    for name, value in (("TOGETHER", together), ("TOGETHER_CELLS", cells), ("TOGETHER_POSTINGS", postings), ("COLUMNS", columns), ("BLOCK", 16)):
        monkeypatch.setattr(bm25, name, value, raising=False)
    texts = [prose(20 + i % 150, i) + " the of" * (i % 5) for i in range(500)] + ["", "alone"] + [prose(40, 7)] * 30
    parsed = [bm25.term_counts(t.encode()) for t in texts]
    row = dict(zip([f.name for f in bm25._INDEX], bm25._shard("s", list(range(len(texts))), *map(list, zip(*parsed)))))
    asked = [parsed[i][0] for i in range(0, 500, 12)] + [parsed[500][0], parsed[501][0], parsed[502][0], np.array([1], np.int64)]
    df = Counter(w for t, _ in parsed for w in t.tolist())
    mean = sum(int(c.sum()) for _, c in parsed) / len(texts)
    queries = bm25.Queries(np.arange(len(asked)), np.cumsum([len(t) for t in asked]), np.concatenate(asked), bm25.idf(np.array([df[w] for t in asked for w in t.tolist()]), len(texts)))
    words = [(t.tolist(), c.tolist()) for t, c in parsed]
    got, opened = {}, []
    for q, d, s in bm25.search_shard(row, queries, 10, mean, opened):
        got.setdefault(q, []).append((-s, d))
    for q, terms in enumerate(asked):
        scores, weight = [], {w: bm25.idf(df[w], len(texts)) for w in terms.tolist()}
        for d, (t, c) in enumerate(words):
            norm = 1.2 * (0.25 + 0.75 * sum(c) / mean)
            s = sum(weight[w] * n * 2.2 / (n + norm) for w, n in zip(t, c) if w in weight)
            if s > 0:
                scores.append((-round(s, 6), d))
        want = sorted(scores)[:10]
        assert [s for s, _ in got.get(q, [])] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert {d for s, d in want if s < want[-1][0] - 2e-6} <= {d for _, d in got.get(q, [])}
    assert sum(opened) < 11 * len(asked) + 30


def test_shards_searched_ahead_give_the_others_their_thresholds(llm, docs_of, prose, monkeypatch):
    texts = {i: prose(40, i % 90) for i in range(400)}
    docs = docs_of(list(texts.items())).repartition(24, "doc_id")
    queries = llm.createDataFrame([(i, texts[i]) for i in range(0, 400, 20)], "query_id long, text string")
    written = []

    def path_of(spark, tag, of=bm25.scratch_path):
        written.append((tag, of(spark, tag)))
        return written[-1][1]

    monkeypatch.setattr(bm25, "scratch_path", path_of)
    got = [tuple(r) for r in bm25.top_k(docs, queries, 3).orderBy("query_id", "rank").collect()]
    found = llm.read.parquet(dict(written)["best"]).count()
    monkeypatch.setattr(bm25, "EARLY", 1_000)
    assert got == [tuple(r) for r in bm25.top_k(docs, queries, 3).orderBy("query_id", "rank").collect()]
    assert found < 0.75 * llm.read.parquet(dict(written)["best"]).count()
    first = llm.createDataFrame([(7, 1, 2.0), (7, 2, 3.0), (5, 1, 1.0), (7, 3, 9.0)], "query_id long, doc_id long, score double")
    assert bm25.so_far(first, np.array([9, 7, 5]), 2).tolist() == [0.0, 3.0, 0.0]


def test_texts_of_like_words_lie_together():
    rng = np.random.default_rng(0)
    of = np.arange(120) % 2  # two languages in turn
    terms = [np.sort(rng.choice(np.arange(100 * x, 100 * x + 20), 12, replace=False)).astype(np.int64) for x in of]
    ids, ends, asked, dfs = bm25.alike(np.arange(120), np.cumsum([12] * 120), np.concatenate(terms), np.concatenate(terms) + 1)
    assert sorted(ids.tolist()) == list(range(120)) and (asked + 1 == dfs).all() and ends.tolist() == list(range(12, 1_441, 12))
    assert all((asked[e - 12 : e] == terms[i]).all() for i, e in zip(ids.tolist(), ends.tolist()))
    assert np.count_nonzero(np.diff(of[ids])) == 1
    row = dict(zip([f.name for f in bm25._INDEX], bm25._shard("s", list(range(120)), terms, [np.ones(12, np.int32)] * 120)))
    assert np.count_nonzero(np.diff(of[np.frombuffer(row["ids"], np.int64)])) == 1
    assert not len(bm25.kinds(np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
