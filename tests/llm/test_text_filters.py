import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinchgraph.llm import chunks, decontaminate, resample


def cut(text):
    ends = chunks.cut_points(text).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def test_chunks_cover_the_text(prose):
    for text in [b"", b"a", b"a" * 1_000, "é".encode() * 500, prose(2_000, 1).encode(), b"\x00\xff" * 200]:
        parts = cut(text)
        assert b"".join(parts) == text and all(0 < len(p) <= chunks.MOST + 3 for p in parts)
    for part in cut("äöü".encode() * 400):
        part.decode()


def test_chunks_are_the_same_for_any_stride(prose, monkeypatch):
    text = prose(3_000, 2).encode()
    whole = cut(text)
    for stride in (100, 1_000, 4_097):
        monkeypatch.setattr(chunks, "STRIDE", stride)
        assert cut(text) == whole


def test_insertions_move_few_chunks(prose):
    text = prose(2_000, 3)
    before, after = set(cut(text.encode())), set(cut((text[:5_000] + "INSERTED" + text[5_000:]).encode()))
    assert len(before - after) <= 6


def brute_first_places(rows):
    """Chunks that repeat: (doc, number) unless the document is the smallest that holds the digest and it is its first place there."""
    place = {}
    for doc_id, text in rows:
        for no, c in enumerate(cut((text or "").encode())):
            place.setdefault(c, []).append((doc_id, no))
    return {(d, n) for at in place.values() for d, n in at if len(at) > 1 and not (d == min(at)[0] and n == min(m for x, m in at if x == d))}


def test_spans_equal_brute_force(docs_of, prose):
    rng = random.Random(4)
    passages = [prose(rng.randint(51, 120), 50 + i) for i in range(6)]
    rows = [(1, None), (2, ""), (3, "short line"), (4, "short line")]
    for i in range(40):
        parts = [prose(rng.randint(5, 60), 200 + i)] + rng.sample(passages, rng.randint(0, 2)) + [prose(rng.randint(0, 30), 300 + i), "Released under the same licence."]
        rows.append((10 + i, "\n".join(parts)))
    rows += [(60, rows[12][1]), (61, prose(30, 7) + " x " + (prose(80, 8) + "\n") * 3)]
    docs = docs_of(rows)
    spans = chunks.repeated_spans(docs)
    got = {(r["doc_id"], r["start"], r["length"]): r for r in spans.collect()}
    repeats, want = brute_first_places(rows), set()
    for doc_id, text in rows:
        raw, at, run = (text or "").encode(), 0, None
        marks = [(doc_id, n) in repeats for n in range(len(cut(raw)))] + [False]
        for part, mark in zip([*cut(raw), b""], marks):
            if mark and run is None:
                run = at
            if not mark and run is not None:
                words = sum(1 for i in range(run, at) if not raw[i : i + 1].isspace() and (i == 0 or raw[i - 1 : i].isspace()))
                if words >= chunks.MIN_WORDS:
                    want.add((doc_id, run, at - run))
                run = None
            at += len(part)
    assert set(got) == want and len(want) > 10
    kept = {r["doc_id"]: r["text"] for r in chunks.without_spans(docs, spans).collect()}
    assert kept[1] is None and kept[2] == "" and kept[3] == kept[4] == "short line" and (kept[60] == "" or len(kept[60]) < 60)
    for passage in passages:
        assert sum(passage in (t or "") for t in kept.values()) <= 1
    for doc_id, text in rows:
        raw = (text or "").encode()
        for _, start, length in sorted((s for s in want if s[0] == doc_id), reverse=True):
            raw = raw[:start] + raw[start + length :]
        assert (kept[doc_id] or "").encode() == raw


def test_odd_rows_and_empty_table(docs_of, odd):
    docs = docs_of(odd)
    out = chunks.without_spans(docs, chunks.repeated_spans(docs))
    assert out.columns == docs.columns and out.count() == len(odd)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (None, "null id") in kept and (None, None) in kept and dict(kept)[9] == "" and kept.count((5, "a")) == 2
    assert chunks.repeated_spans(docs_of([])).count() == 0


def test_rows_that_share_an_id(docs_of, prose):
    """Equal rows count a run once; different texts of one id keep their own spans."""
    short = prose(20, 1)
    rows = [(1, short), (2, prose(40, 2) + "\n" + short), (3, prose(80, 3) + "\n" + prose(80, 4)), (4, prose(80, 3)), (4, prose(80, 5))]
    single, docs = docs_of(rows), docs_of(rows + [rows[1], rows[3]])
    facts = lambda df: {(r["doc_id"], r["start"], r["length"], r["words"]) for r in chunks.repeated_spans(df).collect()}
    assert facts(docs) == facts(single) and {f[0] for f in facts(docs)} == {4}
    kept = sorted((r["doc_id"], r["text"]) for r in chunks.without_spans(docs, chunks.repeated_spans(docs)).collect())
    assert [t for i, t in kept if i == 2] == [rows[1][1]] * 2
    fours = [t for i, t in kept if i == 4]
    assert len(fours) == 3 and rows[4][1] in fours and sum(len(t) < len(rows[3][1]) // 3 for t in fours) == 2


def test_common_subsequence_equals_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(-1, 6) for _ in range(rng.randint(1, 14))] for _ in range(2))
        a = [abs(x) for x in a]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate._masks(np.array(a)), len(a), b).bit_count() == table[-1, -1]


def test_randomised_svd_finds_the_leading_space(llm):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 60, 12) for _ in range(300)]
    weight = rng.random(60) + 0.2
    passages = llm.createDataFrame([(p.tolist(),) for p in parts], "numbers array<int>")
    space = decontaminate.latent_space(passages, 300, parts[:1], weight, dimensions=50)
    dense = np.zeros((301, 60))
    for i, p in enumerate(parts + [parts[0]]):
        np.add.at(dense[i], p, weight[p])
        dense[i] /= np.linalg.norm(dense[i])
    dense[300] *= 300**0.5
    values = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(space.T @ space, np.eye(50), atol=1e-4)
    assert np.linalg.norm(dense @ space) ** 2 >= 0.97 * (values[:50] ** 2).sum()


def test_words_are_counted_over_all_documents(docs_of, prose):
    """Weights and thresholds rest on every document, and the space on every item; no document is picked."""
    items = [(1, prose(20, 1)), (2, prose(30, 2))]
    block = decontaminate.Block.of(items)
    texts = [prose(40, 100 + i) + (" " + items[i % 2][1] if i % 3 == 0 else "") for i in range(50)]
    docs = docs_of(list(enumerate(texts))).select("doc_id", F.encode("text", "utf-8").alias("text"))
    got = {r["word"]: (r["n"], r["times"]) for r in decontaminate.survey(docs, block).groupBy("word").agg(F.sum("documents").alias("n"), F.sum("times").alias("times")).collect()}
    split = [t.split() for t in texts]
    for word, number in block.vocabulary.items():
        w = word.decode()
        assert got.get(number, (0, 0)) == (sum(w in t for t in split), sum(t.count(w) for t in split))


def dense_passages(texts, weight):
    """Unit TF-IDF rows of all passages of texts of word numbers, one by one."""
    rows = []
    for numbers in texts:
        for s in decontaminate._starts(len(numbers)).tolist():
            row = np.zeros(len(weight))
            for w in numbers[s : s + decontaminate.PASSAGE]:
                if w >= 0:
                    row[w] += weight[w]
            if row.any():
                rows.append(row / np.linalg.norm(row))
    return np.array(rows).reshape(-1, len(weight))


def test_gram_of_passages_equals_brute_force():
    rng = np.random.default_rng(2)
    weight = np.where(rng.random(40) < 0.3, 0.0, rng.random(40) + 0.2)
    texts = [rng.integers(-1, 40, n) for n in (0, 1, 31, 32, 33, 64, 65, 96, 97, 700, 5)] + [np.full(90, -1), np.full(200, 3), np.flatnonzero(weight == 0)]
    basis = rng.standard_normal((40, 7))
    a = dense_passages(texts, weight)
    for at_once in (1, 2, 3, 4_096):
        assert np.allclose(decontaminate._gram(texts, weight, basis, at_once), a.T @ (a @ basis), atol=1e-4)
    assert not decontaminate._gram([], weight, basis).any() and not decontaminate._gram(texts[:1], weight, basis).any()
    table, pick = rng.integers(0, 9, (50, 3)), rng.integers(0, 50, 5_000)
    begin = np.unique(np.r_[0, rng.integers(0, 40, 9), rng.integers(0, 5_000, 30)])
    assert (decontaminate._segment_sums(table, pick, begin) == np.add.reduceat(table[pick], begin, axis=0)).all()


def test_space_holds_the_passages_of_all_documents(llm, docs_of, prose, monkeypatch):
    """The latent space is that of every passage of every document and of all items, not of the items or of some documents."""
    items = [(i, prose(40, i)) for i in range(12)]
    texts = [" ".join(prose(30, 100 + i * 7 + k) + " " + items[(i + k) % 12][1] for k in range(i % 4)) for i in range(60)]
    seen = {}
    fitted, searched = decontaminate.latent_space, decontaminate.search
    monkeypatch.setattr(decontaminate, "DIMENSIONS", 20)
    monkeypatch.setattr(decontaminate, "latent_space", lambda passages, rows, own, weight: seen.update(rows=rows, own=own) or fitted(passages, rows, own, weight, dimensions=20))
    monkeypatch.setattr(decontaminate, "search", lambda numbered, block, weight, space, apart: seen.update(block=block, weight=weight, space=space) or searched(numbered, block, weight, space, apart))
    decontaminate.leaks(docs_of([(None, texts[0]), *enumerate(texts)]).repartition(5), llm.createDataFrame(items, "item_id long, text string")).count()
    weight, space = seen["weight"], seen["space"].astype(float)
    docs = dense_passages([seen["block"].numbers(t.encode()) for t in [texts[0], *texts]], weight)
    assert seen["rows"] == len(docs)
    own = dense_passages(seen["own"], weight) * max(1.0, len(docs) / len(seen["own"])) ** 0.5
    both = np.concatenate([docs, own])
    values = np.linalg.svd(both, compute_uv=False)
    assert space.shape[1] == 20 and np.linalg.norm(both @ space) ** 2 >= 0.999 * (values[:20] ** 2).sum()
    assert np.linalg.norm(docs @ space) ** 2 > 1.02 * np.linalg.norm(docs @ np.linalg.svd(own)[2][:20].T) ** 2


def test_stage_fits_on_all_documents(llm, docs_of, prose, tmp_path, monkeypatch):
    """The pipeline's stage hands every document with a word of the benchmark to the latent space, and drops what it wrote."""
    import corpus_pipeline
    from pinchgraph.storage import recorded_scratch

    item = prose(40, 1)
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, fitted = docs_of([(i, f"{item.split()[i]} {prose(70, 200 + i)}") for i in range(30)] + [(99, prose(20, 5) + " " + item)]), []
    monkeypatch.setattr(decontaminate, "latent_space", lambda passages, *rest, f=decontaminate.latent_space: fitted.append(passages.count()) or f(passages, *rest))
    with recorded_scratch() as outer:
        with recorded_scratch() as inner:  # holds the same names as the outer one
            kept = dict(corpus_pipeline.STAGES)["decontamination"](llm, docs, str(tmp_path))
        assert {r["doc_id"] for r in kept.collect()} == set(range(30)) and fitted == [31]
        decontaminate.leaks(docs, llm.read.parquet(str(tmp_path / "benchmark.parquet"))).count()
        assert inner and set(inner) < set(outer)


def brute_leaks(rows, items):
    """Every document against every item on words alone, without the latent space."""
    out = set()
    for item_id, item in items:
        block = decontaminate.Block.of([(item_id, item)])
        if block.words:
            for doc_id, text in rows:
                share, answer, _ = decontaminate.checked(block.words[0], block.numbers((text or "").encode()))
                if decontaminate.is_leak(share, answer):
                    out.add((doc_id, item_id))
    return out


def test_scattered_words_cost_no_masks(monkeypatch):
    """A text whose stretches hold too few words of the item is turned down by counts alone; what is known of its words changes nothing."""
    made = []
    monkeypatch.setattr(decontaminate, "_masks", lambda words, f=decontaminate._masks: made.append(len(words)) or f(words))
    item = np.arange(20)
    scattered = np.full(600, -1)
    scattered[::30] = item
    assert decontaminate.checked(item, scattered) == (0.0, 0.0, 0) and not made
    marks, rng = decontaminate.Marks(50), random.Random(5)
    for _ in range(200):
        item, text = (np.array([rng.randint(low, 49) for _ in range(rng.randint(1, 60))]) for low in (0, -1))
        own = marks.held(text, item)
        assert own.tolist() == np.isin(text, item).tolist() and marks.held(item, text).tolist() == np.isin(item, text).tolist()
        assert decontaminate.checked(item, text, own) == decontaminate.checked(item, text)


def test_leaks_against_brute_force(llm, docs_of, prose, odd):
    rng = random.Random(8)
    items = [(i, prose(rng.randint(15, 59), 500 + i)) for i in range(25)] + [(30, None), (31, "")]
    rows = [r for r in odd if len(r[1] or "") < 5_000]
    for i in range(150):
        words = prose(rng.choice([0, 30, 200]), 900 + i).split()
        if i % 3:
            item = items[i % 25][1].split()
            for _ in range(rng.randint(0, len(item) // 4)):  # swap, drop and insert words
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["other"], [item[at], "other"]])
            at = rng.randint(0, len(words))
            words[at:at] = item
        rows.append((100 + i, " ".join(words)))
    bench = llm.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    want = brute_leaks(rows, items)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 80
    assert not {d for d, _ in got if d is not None and d >= 100 and (d - 100) % 3 == 0}


def test_item_in_every_document_and_blocks(llm, docs_of, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    a, b = prose(20, 1), prose(30, 2)
    bench = llm.createDataFrame([(1, a), (2, b), (3, a)], "item_id long, text string")
    rows = [(1, a), (2, a + " " + b), (3, prose(40, 3))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}
    assert decontaminate.leaks(docs_of([]), bench).count() == 0 and decontaminate.leaks(docs_of(rows), bench.limit(0)).count() == 0
    kept = decontaminate.without_leaks(docs_of(rows), decontaminate.leaks(docs_of(rows), bench))
    assert [r["doc_id"] for r in kept.collect()] == [3]


def test_item_in_a_third_of_the_documents(llm, docs_of, prose):
    """A hot group makes all words of its item common: its copies are found all the same, and those of an item of the same words."""
    hot, rare = prose(30, 1), prose(30, 2)
    words = hot.split()
    items = [(1, hot), (2, rare), (3, " ".join(words[::-1]))]
    rows = []
    for i in range(1_000):
        text = prose(40, 5_000 + i).split()
        if i % 3 == 0:
            text[i % 40 : i % 40] = words if i % 2 else [*words[:5], "other", *words[7:]]
        rows.append((i, " ".join(text)))
    rows += [(2_000, rows[1][1] + " " + rare), (2_001, rows[2][1] + " " + items[2][1])]
    bench = llm.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert got == {(i, 1) for i in range(0, 1_000, 3)} | {(2_000, 2), (2_001, 3)}


def test_long_items(llm, docs_of, prose):
    rng = random.Random(2)
    items = [(n, prose(n, n)) for n in (30, 65, 150, 300, 1_000)]
    rows = [(i, prose(rng.choice([50, 400, 2_000]), 7_000 + i)) for i in range(60)]
    want = set()
    for n, item in items:
        for k in range(4):
            words = item.split()
            for _ in range(k * n // 20):  # none to 15 in 100 are changed
                words[rng.randrange(n)] = "other"
            rows.append((1_000 * k + n, prose(37 * k, 100 * n + k) + " " + " ".join(words) + " " + prose(80, 100 * n + k + 50)))
            want.add((1_000 * k + n, n))
    rows.append((9_000, " ".join(items[4][1].split()[:500])))  # half of an item is none
    bench = llm.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert got == want == brute_leaks(rows, items)


def labels_of(llm, rows):
    return llm.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(prose, n):
    """Clean, junk and rude texts in turn, with labels for two thirds."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randint(20, 120), i).split()
        kind = i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["rudeword", "vileword", "badword"]))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_held_out_quality(llm, docs_of, prose):
    rows, labels = corpus(prose, 900)
    got = {r["doc_id"] for r in resample.resample(docs_of(rows), labels_of(llm, labels)).collect()}
    unseen = [i for i, _ in rows if i % 3 == 0]
    of = lambda kinds: [i in got for i in unseen if i % 10 in kinds]
    assert np.mean(of(range(2, 10))) >= 0.95 and np.mean(of([0])) <= 0.05 and np.mean(of([1])) <= 0.15


def test_log_ratios_equal_brute_force(docs_of, prose):
    rows = [(i, prose(30, i)) for i in range(40)]
    found = resample.log_ratios(docs_of(rows), np.arange(10))
    features = resample.Features()
    raw, good = np.zeros(len(found)), np.zeros(len(found))
    for i, text in rows:
        for _, buckets in features(text.encode()):
            np.add.at(raw, buckets, 1)
            if i < 10:
                np.add.at(good, buckets, 1)
    for f in range(resample.FAMILIES):
        at = slice(f * resample.BUCKETS, (f + 1) * resample.BUCKETS)
        want = np.log((good[at] + 5) / (raw[at] * good[at].sum() / raw[at].sum() + 5))
        assert np.allclose(found[at], np.clip(want, -3, 3), atol=1e-5)


def test_odd_rows_and_no_labels(llm, docs_of, odd):
    got = [r["doc_id"] for r in resample.resample(docs_of(odd), labels_of(llm, [])).collect()]
    assert len(got) == len(odd)
    some = labels_of(llm, [(1, 1, 0), (4, 1, 0), (4, 0, 1), (6, 1, 0), (8, None, 0), (None, 1, 0), (77, 1, 0), (2, 1, 0), (3, 0, 0)])
    assert {r["doc_id"] for r in resample.resample(docs_of(odd), some).collect()} >= {6, 9}
    assert resample.resample(docs_of([]), some).count() == 0


def test_kth_largest(llm):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, 1e9, -3.0]) for _ in range(500)]
    df = llm.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 250, 499, 500):
        assert resample.kth_largest(df, "key", k, bins=4, few=3) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "key", 0) is None and resample.kth_largest(df, "key", 501) is None


def test_gumbel_top_k_follows_the_weights(llm):
    scored = llm.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.0).alias("score"))
    kept = resample.gumbel_top_k(scored, "score", 500, temperature=1.0)
    heavy = kept.where("doc_id % 2 = 0").count()
    assert kept.count() == 500 and heavy / 500 == pytest.approx(np.exp(2) / (1 + np.exp(2)), abs=0.05)
