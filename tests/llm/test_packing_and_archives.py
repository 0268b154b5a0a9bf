import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pinchgraph.llm import archives, packing
from pinchgraph.llm.queries import vocabulary


@pytest.fixture(scope="module")
def coder():
    return packing.WordCoder(vocabulary())


TEXTS = [
    "", " ", "it's DON'T 'tis x'll!! a=́b İstanbul ΣΑΣ 42abc #1 \x1c y\x85z a b", "<|endoftext|> end<|startoftext|>.", "<|ENDOFTEXT|>.",
    "…... ¿que? ñandú,", "é é. ́x", "a b, c.d e.,f 1,000 x--", "你好, 世界! \U0001f600\U0001f600.", "Ä̈ .́ ́. word.́", "don't. it's, 's 'S",
]


def test_ids_equal_the_tokenizer(coder, prose):
    rng = random.Random(1)
    pool = [w for t in TEXTS for w in t.split(" ")] + prose(50, 1).split()
    texts = TEXTS + [rng.choice([" ", "\n", "  "]).join(rng.choices(pool, k=12)) for _ in range(300)]
    for text in texts:
        assert coder.encode(text.encode()) == np.array(coder.coder.encode(text, add_special_tokens=False).ids, np.uint32).tobytes(), text


def test_cache_starts_anew(coder, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    for text in ("one two, three four", "five six seven, one", "one two, three four"):
        assert coder.encode(text.encode()) == np.array(coder.coder.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        values = rng.random(5).round(2)
        worth, counts = packing.best_pattern(values, 11)
        best = np.full(12, 0.0)
        for r in range(1, 12):
            best[r] = max([best[r - 1]] + [best[r - c] + values[c - 1] for c in range(1, 6) if c <= r])
        assert worth == pytest.approx(best[11]) and counts @ values == pytest.approx(worth) and counts @ np.arange(1, 6) <= 11


def first_fit(demand, room):
    spaces = []
    for c in range(len(demand), 0, -1):
        for _ in range(int(demand[c - 1])):
            at = next((i for i, s in enumerate(spaces) if s >= c), None)
            if at is None:
                spaces.append(room - c)
            else:
                spaces[at] -= c
    return len(spaces)


def test_plan_is_exact_and_near_the_bound():
    rng = np.random.default_rng(1)
    for demand in (rng.integers(0, 300, 64), np.r_[np.zeros(63, int), 5], np.r_[7, np.zeros(63, int)], np.zeros(64, int), rng.integers(0, 2, 64)):
        made = packing.plan(demand, 64)
        assert (made.copies @ made.counts == demand).all() if demand.any() else made.sequences == 0
        if demand.any():
            assert ((made.counts @ np.arange(1, 65)) <= 64).all()
            least = packing.patterns(demand, 64)[1].sum()
            assert demand @ np.arange(1, 65) / 64 <= least + 1e-6 and made.sequences <= least + 40
            assert made.sequences <= first_fit(demand, 64) * 1.01 + 2


def test_pack(docs_of, odd, coder, prose):
    rows = list(odd) + [(100 + i, prose(i * 11 % 700, i)) for i in range(150)] + [(400 + i, "copy of a text") for i in range(60)]
    parts = packing.pieces(docs_of(rows), vocabulary(), length=256, with_ids=True)
    got = packing.pack(parts, 256, 8).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = coder.encode((text or "").encode()) + b"\x01\0\0\0"
        want[doc_id, len(ids) // 4].append(ids)
    assert set(by_doc) == set(want)
    for key, texts in want.items():
        starts = defaultdict(list)
        for r in by_doc[key]:
            starts[r["start"]].append(r["ids"])
        assert b"".join(b"".join(sorted(starts[s])) for s in sorted(starts)) == b"".join(
            b"".join(sorted(t[4 * s : 4 * (s + 256)] for t in texts)) for s in sorted(starts))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts_ in by_sequence.values():
        end = 0
        for r in sorted(parts_, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 256
    tokens = sum(r["length"] for r in got)
    assert len(by_sequence) * 256 <= 1.05 * tokens + 12 * 256


def test_sequences_hold_their_documents(docs_of):
    packed = packing.pack(packing.pieces(docs_of([(1, "a b"), (2, "c")]), vocabulary(), 64, with_ids=True), 64)
    rows = packing.sequences(packed).collect()
    assert len(rows) == 1 and sorted(rows[0]["doc_ids"]) == [1, 2] and len(rows[0]["ids"]) == 4 * 5


def test_pack_nothing(docs_of):
    assert packing.pack(packing.pieces(docs_of([]), vocabulary())).count() == 0


ARC1 = b"""filedesc://a.arc 0.0.0.0 19970101000000 text/plain 77
1 0 someone
URL IP-address Archive-date Content-type Archive-length
12345678

http://a.com/ 1.2.3.4 199701020304 text/html 31
HTTP/1.0 200 OK\r\nX-Y: z\r\n\r\nbody
\nhttp://b.com/ 1.2.3.4 19970102030405 image/gif 4
GIF8
dns:c.com 1.2.3.4 1997010203 text/dns 0

"""


def test_arc_version_1():
    records = list(archives.read_arc(io.BytesIO(ARC1)))
    assert [r.fields["URL"] for r in records] == ["http://a.com/", "http://b.com/", "dns:c.com"]
    assert [len(r.block) for r in records] == [31, 4, 0]
    a, b, c = (archives.to_warc(r) for r in records)
    assert a[1] == "response" and a[3] == "1997-01-02T03:04:00Z" and a[8] == hashlib.sha1(records[0].block.partition(b"\r\n\r\n")[2]).hexdigest()
    assert b[1] == "resource" and b[3] == "1997-01-02T03:04:05Z" and b[5] == "image/gif" and b[7] == b"GIF8"
    assert c[3] == "1997-01-02T03:00:00Z" and c[7] == b""
    assert archives.to_warc(records[0])[0] == a[0] != b[0]


def test_arc_version_2_and_faults():
    about = f"2 0 someone\n{archives.ARC_FIELDS[2]}\n".encode()
    head = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 a.arc %d\n" % len(about) + about
    good = head + b"\nhttp://a.com/ 1.2.3.4 19970102030405 text/html 200 - - 9 a.arc 5\nab\ncd\n"
    (record,) = archives.read_arc(io.BytesIO(good))
    assert record.block == b"ab\ncd" and record.fields["Result-code"] == "200"
    for bad in (good[:-4], head + b"http://a.com/ 1.2.3.4 19970102030405 text/html 2\nab\n", b"http://a.com/ x\n"):
        with pytest.raises(ValueError):
            list(archives.read_arc(io.BytesIO(bad)))


def pages_of(llm, rows):
    return llm.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(llm, prose):
    long = prose(300, 1)
    assert len(long) >= 1000
    rows = [
        (1, "http://a.com/x y", long), (2, None, long), (9, "http://b.com/", long), (9, "http://b.com/", long), (None, "http://n.com/", long), (3, "http://c.com/é", "short"), (4, "", "short"),
        (5, "http://d.com/", None), (6, "http://e.com/", ""), (7, "http://f.com/", "WARC/1.1\r\n\r\n\r\nfiledesc:// é \n"), (8, "http://g.com/", prose(30_000, 2)), (10, "http://h.com/", "HTTP/1.1 200 OK\r\n\r\nx"),
    ]
    got = archives.round_trip(pages_of(llm, rows)).collect()
    key = lambda *v: tuple((x is None, x) for x in v)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = html == long and page != 9
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None))
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(found, key=lambda r: key(*r)) == sorted(want, key=lambda r: key(*r))
    assert len({r["record_id"] for r in got}) >= len(rows) - 1


def test_payloads_survive(llm, tmp_path):
    bodies = {1: "a\r\n\r\nb\n", 2: "é" * 700, 3: "\x00 nul"}
    archives.write_arcs(pages_of(llm, [(i, f"http://x.com/{i}", b) for i, b in bodies.items()]), str(tmp_path / "arc"), files=2)
    archives.convert(llm, str(tmp_path / "arc"), str(tmp_path / "warc"), files=1)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in archives.read_warcs(llm, str(tmp_path / "warc")).collect()} == bodies
    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "warc").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_no_pages(llm):
    assert archives.round_trip(pages_of(llm, [])).count() == 0
