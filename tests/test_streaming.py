"""Streams equal their batch twins, over several micro-batches and under replay."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pinchgraph.sources.documents import dedup_insert
from pinchgraph.streaming import jobs
from pinchgraph.streaming.batches import BatchKey, BatchTable, KeyIndex

NOW = datetime(2024, 1, 31, 12)
DOC = jobs.STORED_DOCUMENT + ", arrival int"


def landed(spark, tmp_path, parts, schema):
    path = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part{i}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def doc(uid, arrival, title="t"):
    return (uid, title, "text", "u", "s", 1, NOW - timedelta(minutes=arrival), "{}", arrival)


def test_ingest_equals_batch(spark, tmp_path):
    parts = [[doc("a", 1), doc("b", 2), doc("a", 3)], [doc("b", 4), doc("c", 5)], [doc("a", 6), doc("d", 7), doc("d", 8)]]
    table = BatchTable(spark, str(tmp_path / "table"), jobs.STORED_DOCUMENT)
    jobs.ingest(landed(spark, tmp_path, parts, DOC), table, "arrival", str(tmp_path / "cp"), available_now=True).awaitTermination()
    stored = table.read()
    assert sorted(r.uid for r in stored.collect()) == ["a", "b", "c", "d"]
    every = spark.createDataFrame([r for p in parts for r in p], DOC)
    batch = dedup_insert(spark.createDataFrame([], DOC), every, "arrival")
    assert sorted(r.uid for r in batch.collect()) == sorted(r.uid for r in stored.collect())


def test_replayed_batch_changes_nothing(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "table"), jobs.STORED_DOCUMENT)
    rows = spark.createDataFrame([doc("a", 1), doc("b", 2)], DOC)
    for _ in range(2):
        key = BatchKey("q", 0)
        table.write(dedup_insert(table.read(before=key), rows, "arrival"), key)
    assert sorted(r.uid for r in table.read().collect()) == ["a", "b"]


def test_new_checkpoint_keeps_the_table(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "table"), jobs.STORED_DOCUMENT)
    for n, rows in enumerate([[doc("a", 1)], [doc("b", 2), doc("a", 3)], [doc("c", 4), doc("b", 5)]]):
        (tmp_path / str(n)).mkdir()
        jobs.ingest(landed(spark, tmp_path / str(n), [rows], DOC), table, "arrival", str(tmp_path / f"cp{n}"), available_now=True).awaitTermination()
    assert sorted(r.uid for r in table.read().collect()) == ["a", "b", "c"]


def test_same_checkpoint_goes_on(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "table"), jobs.STORED_DOCUMENT)
    for rows in ([doc("a", 1)], [doc("a", 2), doc("b", 3)]):
        spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], DOC).schema).parquet(str(tmp_path / "in"))
        jobs.ingest(stream, table, "arrival", str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r.uid for r in table.read().collect()) == ["a", "b"]


def test_alert_is_not_repeated_after_a_lost_ledger(spark, tmp_path, monkeypatch):
    schema = "uid string, title string, url string, source string, first_seen timestamp"
    watched = spark.createDataFrame([("h", "claim", 0.8, 0.7, 2, ["ABF"])], "id string, statement string, confidence double, ops_score double, awareness_layer int, keywords array<string>")
    alerts = BatchTable(spark, str(tmp_path / "alerts"), jobs.ALERT)
    ledger = BatchTable(spark, str(tmp_path / "ledger"), jobs.LEDGER)
    write = ledger.write
    monkeypatch.setattr(ledger, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    for n, at in enumerate((NOW, NOW + timedelta(hours=1))):
        (tmp_path / str(n)).mkdir()
        stream = landed(spark, tmp_path / str(n), [[(f"u{n}", "ABF short", "u", "S", at)]], schema)
        query = jobs.alert(stream, watched, alerts, ledger, jobs.newest_of("first_seen"), str(tmp_path / f"cp{n}"), available_now=True)
        if n == 0:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination()
            monkeypatch.setattr(ledger, "write", write)
        else:
            query.awaitTermination()
    assert alerts.read().count() == 1


def resolving(spark, tmp_path, n, parts, mentions, applied):
    (tmp_path / str(n)).mkdir()
    schema = "uid string, title string, text string, published_at timestamp, embedding array<float>"
    nodes = spark.createDataFrame([("N1", "Company", [1.0, 0.0]), ("N2", "Company", [0.0, 1.0])], "node_id string, label string, embedding array<float>")
    hyps = spark.createDataFrame([("H1", "N1", "active", 0.5), ("H2", "N2", "active", 0.5)], "id string, node_id string, status string, confidence double")
    stream = landed(spark, tmp_path / str(n), parts, schema)
    return jobs.resolve(stream, nodes, hyps, mentions, applied, jobs.newest_of("published_at"), str(tmp_path / f"cp{n}"), available_now=True)


def test_resolve_over_batches_and_a_failure_between_its_writes(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}", "t", "shortage of supply" if i % 2 else "", NOW - timedelta(hours=i), [1.0, 0.1 * i] if i < 3 else [0.1, 1.0]) for i in range(6)]
    parts = [rows[:2] + rows[:1], rows[2:4], rows[4:] + rows[3:4]]
    mentions = BatchTable(spark, str(tmp_path / "mentions"), jobs.MENTION)
    applied = BatchTable(spark, str(tmp_path / "applied"), jobs.EVIDENCE)
    write, calls = applied.write, []

    def failing(df, key):
        calls.append(key)
        if len(calls) == 2:
            raise OSError("lost between the writes")
        write(df, key)

    monkeypatch.setattr(applied, "write", failing)
    with pytest.raises(StreamingQueryException):
        resolving(spark, tmp_path, 0, parts, mentions, applied).awaitTermination()
    resolving(spark, tmp_path, 1, parts, mentions, applied).awaitTermination()  # a new checkpoint reads everything again
    pairs = [(r.doc_uid, r.node_id) for r in mentions.read().collect()]
    evidence = [(r.hypothesis_id, r.doc_uid) for r in applied.read().collect()]
    assert len(pairs) == len(set(pairs)) and {u for u, _ in pairs} == {f"d{i}" for i in range(6)}
    assert sorted(evidence) == sorted(set(evidence)) and {u for _, u in evidence} == {f"d{i}" for i in range(6)}


def test_alerts_fire_once_over_batches(spark, tmp_path):
    schema = "uid string, title string, url string, source string, first_seen timestamp"
    parts = [[("u1", "ABF short", "u", "S", NOW)], [("u2", "ABF again", "u", "S", NOW)], [("u3", "Neon news", "u", "S", NOW)]]
    watched = spark.createDataFrame([("h", "claim", 0.8, 0.7, 2, ["ABF"]), ("g", "claim", 0.8, 0.7, 1, ["Neon"]), ("z", "claim", 0.8, 0.7, 4, ["ABF"])],
                                    "id string, statement string, confidence double, ops_score double, awareness_layer int, keywords array<string>")
    alerts = BatchTable(spark, str(tmp_path / "alerts"), jobs.ALERT)
    ledger = BatchTable(spark, str(tmp_path / "ledger"), jobs.LEDGER)
    jobs.alert(landed(spark, tmp_path, parts, schema), watched, alerts, ledger, F.lit(NOW), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r.hypothesis_id for r in alerts.read().collect()) == ["g", "h"]
    assert sorted((r.hypothesis_id, r.layer) for r in ledger.read().collect()) == [("g", 4), ("h", 4)]


def test_index_reads_only_touched_buckets(spark, tmp_path):
    """Over many batches: every stored key is known, only buckets of the asked keys are read, and segments stay few."""
    table = BatchTable(spark, str(tmp_path / "table"), "uid string, n int")
    index = KeyIndex(table, "uid", buckets=8, every=2, fan=2)
    for b in range(9):
        key = BatchKey("q", b)
        index.gather(key)
        table.write(spark.createDataFrame([(f"u{b}-{i}", i) for i in range(6)], table.schema), key)
    segments = index.segments()
    assert len(segments) <= 3 and max(s.level for s in segments) == 2  # 8 of 9 batches gathered, merged twice
    asked = spark.createDataFrame([("u0-0",), ("u8-1",), ("new",)], "uid string")
    known = index.known(asked, BatchKey("q", 9))
    own = {r.bucket for r in asked.select(index._bucket()).collect()}
    read = {r.bucket for r in spark.createDataFrame([(r.uid,) for r in known.collect() if not r.uid.startswith("u8")], "uid string").select(index._bucket()).collect()}
    assert {"u0-0", "u8-1"} <= {r.uid for r in known.collect()} and read <= own
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    every = spark.createDataFrame([(f"u{b}-{i}",) for b in range(9) for i in range(6)], "uid string")
    assert {r.uid for r in index.known(every, BatchKey("q", 9)).collect()} == {r.uid for r in every.collect()}
    assert {r.uid for r in index.known(every, BatchKey("q", 3)).collect()} == {f"u{b}-{i}" for b in range(3) for i in range(6)}
    assert index.known(every, BatchKey("other", 0)).count() == 54


def test_index_survives_a_lost_manifest_and_half_written_batches(spark, tmp_path, monkeypatch):
    table = BatchTable(spark, str(tmp_path / "table"), "uid string")
    index = KeyIndex(table, "uid", buckets=4, every=2, fan=2)
    for b in range(4):
        table.write(spark.createDataFrame([(f"u{b}",), (None,)], table.schema), BatchKey("q", b))
    (tmp_path / "table/run=q/batch=3/_SUCCESS").unlink()
    index.gather(BatchKey("q", 4))
    assert [s.covers for s in index.segments()] == [{"q": [[0, 2]]}]
    every = spark.createDataFrame([(f"u{b}",) for b in range(5)], "uid string")
    want = {f"u{b}" for b in range(4)} | {None}
    assert {r.uid for r in index.known(every, BatchKey("q", 4)).collect()} | {None} == want
    drop = str(tmp_path / "table_keys/manifests")
    import shutil

    shutil.move(drop, str(tmp_path / "lost"))
    assert index.segments() == [] and {r.uid for r in index.known(every, BatchKey("q", 4)).collect()} == want


def test_ingest_over_many_batches_and_a_restart(spark, tmp_path):
    parts = [[doc(f"u{(3 * b + i) % 11}", 10 * b + i) for i in range(4)] for b in range(6)]
    table = BatchTable(spark, str(tmp_path / "table"), jobs.STORED_DOCUMENT)
    index = KeyIndex(table, "uid", buckets=4, every=2, fan=2)
    for n in range(2):
        (tmp_path / str(n)).mkdir()
        half = parts[:4] if n == 0 else parts[2:]
        jobs.ingest(landed(spark, tmp_path / str(n), half, DOC), table, "arrival", str(tmp_path / f"cp{n}"), available_now=True, index=index).awaitTermination()
    stored = [r.uid for r in table.read().collect()]
    assert sorted(stored) == sorted({r[0] for p in parts for r in p}) and index.segments()
