import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinchgraph.llm import linkgraph, queries, shards


def test_shard_laws(docs_of, odd, prose):
    rows = list(odd) + [(100 + i, prose(i % 7, i)) for i in range(500)] + [(700 + i, "copy") for i in range(300)]
    got = shards.shard_rows(docs_of(rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_few_and_no_rows(docs_of):
    assert shards.shard_rows(docs_of([])).count() == 0
    assert [(r["slot"], 0 <= r["shard"] < 16) for r in shards.shard_rows(docs_of([(1, "a")])).collect()] == [(0, True)]


def test_shuffle_is_stable_and_spreads(docs_of):
    docs = docs_of([(i, "t") for i in range(1600)])
    a, b = (sorted(map(tuple, shards.shard_rows(docs).collect())) for _ in range(2))
    assert a == b
    other = sorted(map(tuple, shards.shard_rows(docs, seed=12).collect()))
    assert a != other
    first_half = Counter(r[3] for r in a if r[0] < 800)
    assert all(20 < first_half[s] < 80 for s in range(16))


def test_hypergeometric_law(llm):
    cases = [(400, 600, 100), (5, 3, 4), (0, 10, 5), (10, 0, 4), (1, 1, 1), (50_000, 950_000, 200_000)]
    for good, bad, draws in cases:
        u = (F.col("id") + 0.5) / 2000
        long = lambda v: F.lit(v).cast("long")
        got = [r[0] for r in llm.range(2000).select(shards.hypergeometric(u, long(good), long(bad), long(draws))).collect()]
        n = good + bad
        mean = draws * good / n
        var = mean * (bad / n) * (n - draws) / (n - 1)
        assert min(got) >= max(0, draws - bad) and max(got) <= min(good, draws)
        assert abs(np.mean(got) - mean) < 0.02 * (1 + var**0.5) and abs(np.var(got) - var) <= 0.05 * var + 0.01
        assert got == sorted(got)


def test_matrix_sums(llm):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 7, 300]) for _ in range(16)]
    total = sum(sizes)
    capacity = [total // 5 + (s < total % 5) for s in range(5)]
    given = llm.createDataFrame([(b, n) for b, n in enumerate(sizes) if n], "block long, n long")
    matrix = {r["block"]: r["counts"] for r in shards.communication_matrix(llm, given, 4, capacity, 1).collect()}
    assert [sum(matrix[b]) for b in range(16)] == sizes
    assert [sum(c) for c in zip(*matrix.values())] == capacity


def test_write_shards(docs_of, tmp_path, llm):
    docs = docs_of([(i, f"t{i}") for i in range(200)]).drop("shard", "slot")
    shards.write_shards(docs, str(tmp_path / "out"), 4)
    back = llm.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {s: 50 for s in range(4)}


URLS = [
    ("https://WWW.Example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/de/1?q=/en/", "example.net", "/de/1", "net/", "block"),
    ("http://a.example.com/de/x#y", "a.example.com", "/de/x", "example.com/de/", "block"),
    ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
    ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://b.org/frx", "b.org", "/frx", None, "allow"),
    ("x://y.net", "y.net", "", None, None),
    ("x://y.net?a=b://c/d", "y.net", "", None, None),
    ("a://b://c/d#e", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http://ÉÄ.NET/en/", "ÉÄ.net", "/en/", "net/", "block"),
]


def test_url_rules(llm):
    pages = llm.createDataFrame([(i, u, None, "clash") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in linkgraph.judge(pages, queries.URL_RULES, rounds=3).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if verdict:
            assert got[i]["verdict"] == verdict
        assert got[i]["verdict"] in ("allow", "block")


def brute_walk(edges, seeds, rounds, damping=linkgraph.DAMPING):
    out = defaultdict(float)
    for s, _, n in edges:
        out[s] += n
    score = {s: 1.0 for s in seeds}
    for _ in range(rounds):
        new = defaultdict(float, {s: 1 - damping for s in seeds})
        for s, d, n in edges:
            new[d] += damping * score.get(s, 0) * n / out[s]
        score = new
    total = sum(score.values()) or 1
    return {h: v / total for h, v in score.items()}


def test_propagation_equals_brute_force(llm):
    rng = random.Random(4)
    hosts = [f"h{i}" for i in range(12)]
    edges = list({(a, b): (a, b, rng.randint(1, 3)) for a, b in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(40)) if a != b}.values())
    seeds = [("h0", "trust"), ("h1", "trust"), ("h2", "distrust")]
    got = linkgraph.propagate(llm.createDataFrame(edges, "src string, dst string, n long"), llm.createDataFrame(seeds, "host string, kind string"), 6)
    trust, distrust = brute_walk(edges, ["h0", "h1"], 6), brute_walk([(d, s, n) for s, d, n in edges], ["h2"], 6)
    for r in got.collect():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0), abs=1e-9) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0), abs=1e-9)


def test_links_carry_distrust_and_trust(llm):
    """A farm that links to a blocked host is blocked; a page that a trusted host links to is not."""
    link = lambda u: f'<A class=x HREF="{u}">t</a>'
    pages = [
        (1, "http://bad.net/x", None), (2, "http://farm.com/a", link("http://bad.net/x") + link("//bad.net/y")),
        (3, "http://good.org/fr/a", link("https://fine.com/p")), (4, "http://fine.com/p", link("/local") + link("http://bad.net/")), (5, "http://lone.com/", "<a href=>"),
    ]
    got = {r["page_id"]: r["verdict"] for r in linkgraph.judge(llm.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got[1] == "block" and got[2] == "block" and got[3] == "allow" and got[5] == "allow"


def test_no_pages(llm):
    none = llm.createDataFrame([], "page_id long, url string, html string")
    assert linkgraph.judge(none, queries.URL_RULES).count() == 0


def test_too_many_rules(llm):
    with pytest.raises(ValueError):
        linkgraph.best_rule(F.lit("a"), F.lit("/"), [("a", "/", "block")] * 1_001)


def test_domains_join_their_hosts(llm):
    """Parent domains are nodes without pages; suffixes, addresses and overlong names have none."""
    hosts = [("a.b.example.net",), ("c.example.net",), ("example.com",), ("10.0.0.1",), ("10.0.0.2:80",), (".".join(["x"] * 200),), ("net",), ("b:",)]
    got = {(r["src"], r["dst"]) for r in linkgraph.domain_links(llm.createDataFrame(hosts, "host string")).collect()}
    up = {("a.b.example.net", "b.example.net"), ("b.example.net", "example.net"), ("c.example.net", "example.net")}
    assert got == up | {(d, s) for s, d in up}


def test_walk_ends_on_its_change(llm):
    rng = random.Random(8)
    edges = [(f"h{rng.randrange(9)}", f"g{rng.randrange(9)}", 1) for _ in range(30)] + [(f"g{i}", f"h{i}", 1) for i in range(9)]
    seeds = [("h0", "trust", 0.5), ("h1", "trust", 0.25), ("g2", "distrust", 1.0)]
    got = linkgraph.propagate(llm.createDataFrame(edges, "src string, dst string, n long"), llm.createDataFrame(seeds, "host string, kind string, weight double")).collect()
    weights = {"h0": 2 / 3, "h1": 1 / 3}
    alone = {h: brute_walk(edges, [h], 200) for h in weights}
    raw = defaultdict(float)
    total = 0.0
    for h, w in weights.items():  # the walk is linear in its seeds; undo the single walks' scaling by their sums
        out = defaultdict(float)
        for s, _, n in edges:
            out[s] += n
        score = {h: 1.0}
        for _ in range(200):
            new = defaultdict(float, {h: 1 - linkgraph.DAMPING})
            for s, d, n in edges:
                new[d] += linkgraph.DAMPING * score.get(s, 0) * n / out[s]
            score = new
        assert set(score) == set(alone[h])
        for g, v in score.items():
            raw[g] += w * v
            total += w * v
    assert max(abs(r["trust"] - raw.get(r["host"], 0) / total) for r in got) < 2 * linkgraph.TOLERANCE


def test_shares_seed_and_domains_carry(llm):
    """Sister hosts of a trusted host get trust, those of a blocked one distrust; shares count, majorities do not."""
    pages = [(i, f"http://a.example.org/{'fr' if i else 'x'}/{i}", None) for i in range(5)]
    pages += [(10, "http://b.example.org/x", None), (10, "http://b.example.org/x", "y" * 500_000)]
    pages += [(20 + i, f"http://{'cd'[i % 2]}.example.com/{'de' if i < 6 else 'en'}/{i}", None) for i in range(12)]
    pages += [(40, "http://e.example.com/en/", None), (41, "http://f.other.org/x", None)]
    df = llm.createDataFrame(pages, "page_id long, url string, html string").withColumns({"trust": F.lit("x"), "rule": F.lit(1), "pages": F.lit(None)})
    rows = linkgraph.judge(df, queries.URL_RULES).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r for r in rows}
    assert got[10]["trust"] > 0 == got[10]["distrust"] and got[10]["verdict"] == "allow"
    assert got[40]["distrust"] > 0 == got[40]["trust"] and got[31]["verdict"] == "block"
    assert got[41]["trust"] == got[41]["distrust"] == 0 and got[41]["verdict"] == "allow"
    hosts = {r["host"]: (r["trust"], r["distrust"]) for r in rows}
    assert sum(t for t, _ in hosts.values()) == pytest.approx(1) == sum(d for _, d in hosts.values())
    none = linkgraph.judge(df, []).collect()
    assert len(none) == len(pages) and {r["verdict"] for r in none} == {"allow"}
    tie = [("a.com", "/x/y", "block"), ("a.com", "/x/", "allow"), ("b.a.com", "/x", "allow")]
    host, path = F.lit("b.a.com"), F.lit("/x/yz")
    name, verdict = linkgraph.best_rule(host, path, tie)
    assert tuple(llm.range(1).select(name, verdict).first()) == ("b.a.com/x", "allow")
