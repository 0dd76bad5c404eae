import json

import pytest
from pyspark.sql import functions as F

from haulmark.schemas import EVENT
from haulmark.service import Service
from haulmark.streaming import tail


def test_end_to_end(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/store")
    s.restart(30, 300)
    assert s.files.read().count() == 30 and not s.reconcile().first().clean
    assert s.backfill().where("outcome = 'done'").count() == 30
    row = s.reconcile().first()
    assert row.clean and row.rows_examined == 30
    assert s.backfill().count() == 0
    new = s.add_files(2).collect()
    log = [(i, json.dumps({"op": "c", "after": {"id": r.id}, "ts_ms": 5})) for i, r in enumerate(new)]
    log += [(5, json.dumps({"op": "u", "after": {"id": 3}, "ts_ms": 9})), (6, json.dumps({"op": "d", "before": {"id": 4}})), (7, None), (8, "junk")]
    assert s.apply_changes(spark.createDataFrame(log, "seq long, value string")).where("outcome = 'done'").count() == 3
    ledger = {r.source_id: r for r in s.ledger.read().collect()}
    assert 4 not in ledger and ledger[3].attempts == 2 and ledger[3].source_version == 9 and ledger[31].lane == "cdc"
    assert {r.kind for r in _defects(s)} == {"missing_document", "missing_ledger"}
    path = ["CDC_CAPTURED", "QUEUED", "CLAIMED", "OCR_DONE", "STORED"]
    assert [r.stage for r in s.trace("3").collect()] == path * 2
    assert s.events().where("source_id is null and stage = 'QUEUED' and detail like '%rangeStart%'").count() == 1
    assert s.checkpoint.read().where("status = 'DONE'").count() == 1 and s.messages.read().count() == 0
    assert len(s.recent("5").collect()) == 5
    stats = s.stats().first()
    assert stats.by_status["DONE"] == 31 and stats.source == 32 and stats.breaker_state == "CLOSED"
    assert s.vendor_mode("slow") == "slow" and s.health() == {"status": "ok"}
    s.vendor_mode("healthy")
    assert s.add_file("  note.txt ", "hello") == 33 and s.add_file(None, None) == 34
    rows = {r.id: r for r in s.files.read().where("id > 32").collect()}
    assert rows[33].filename == "note.txt" and bytes(rows[33].content) == b"hello" and rows[34].filename.startswith("upload-") and rows[34].byte_size == 0
    last = s.events().agg({"id": "max"}).first()[0]
    s.restart(2, 100)
    assert s.events().count() == s.objects.read().count() == s.ledger.read().count() == 0 and s.files.read().count() == 2
    assert s.backfill().count() == 2 and s.events().agg({"id": "min"}).first()[0] > last
    with pytest.raises(ValueError):
        s.vendor_mode("odd")
    with pytest.raises(ValueError):
        s.add_files(0)


def _defects(s):
    from haulmark.operators.reconcile import defects

    return defects(s.files.read(), s.document.read(), s.ledger.read(), s.objects.read()).collect()


def replay(ledger, files, changes, down=False):
    """The ledger after each change in turn; ledger: id -> [status, attempts, failures, version, kept result]."""
    for i, op, version in changes:
        if op == "d":
            ledger.pop(i, None)
            continue
        row = ledger.setdefault(i, ["PENDING", 0, 0, 0, False])
        if op == "u":
            row[:] = ["PENDING", row[1], 0 if version > row[3] else row[2], version, False]
        if row[0] not in ("PENDING", "FAILED_RETRYABLE"):
            continue
        if row[2] >= 5:
            row[0] = "FAILED_PERMANENT"
            continue
        row[1] += 1
        if i not in files:
            row[0], row[2] = "FAILED_RETRYABLE", row[2] + 1
        elif row[4]:
            row[0], row[2] = "DONE", 0
        elif down:
            row[0] = "FAILED_RETRYABLE"
        elif not files[i]:
            row[0] = "FAILED_PERMANENT"
        else:
            row[:] = ["DONE", row[1], 0, row[3], True]
    return ledger


def ledger_rows(s):
    return {r.source_id: [r.status, r.attempts, r.consecutive_failures, r.source_version, r.ocr_payload is not None] for r in s.ledger.read().collect()}


def test_changes_equal_a_replay(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/store")
    texts = {1: "one", 2: "two", 3: "three", 4: "", 5: "five"}
    for i in texts:
        assert s.add_file(f"f{i}", texts[i]) == i
    s.backfill()
    want = replay({}, texts, [(i, "c", 0) for i in texts])
    assert ledger_rows(s) == want
    batches = [
        [(3, "d", 0), (3, "c", 0), (4, "r", 1), (2, "u", 7), (2, "r", 8), (9, "c", 1), (9, "u", 2), (9, "u", 1), (5, "u", 3), (5, "d", 0), (1, "c", 0)],
        [(9, "u", 2)] * 6 + [(8, "u", 4), (8, "d", 0), (5, "r", 1), (5, "u", 9), (5, "u", 4), (4, "u", 5)],
        [(9, "c", 0), (9, "u", 5), (2, "d", 0), (2, "u", 1), (2, "u", 2)],
    ]
    for n, batch in enumerate(batches):
        log = []
        for seq, (i, op, version) in enumerate(batch):
            image = {"before" if op == "d" else "after": {"id": i}}
            log.append((seq, json.dumps({"op": op, **image, "ts_ms": version})))
        s.apply_changes(spark.createDataFrame(log, "seq long, value string").repartition(3))
        want = replay(want, texts, batch)
        assert ledger_rows(s) == want, n
        done = {i for i, row in want.items() if row[0] == "DONE"}
        assert {r.source_id for r in s.document.read().collect()} == done
        assert {r.object_key for r in s.objects.read().collect()} == {f"files/{i}" for i in done}
        assert {r.message for r in s.messages.read().collect()} == {f"cdc:{i}" for i, row in want.items() if row[0] not in ("DONE", "FAILED_PERMANENT")}
    stages = [r.stage for r in s.trace("9").collect()]
    assert stages.count("DLQ") >= 1 and "RETRY" in stages and "STORED" not in stages
    letter = json.loads(s.trace("9").where("stage = 'DLQ'").collect()[0].detail)
    assert letter["errorClass"] == "MAX_RETRY_ATTEMPTS_EXCEEDED" and letter["lastError"] == "" and letter["attempts"] >= 5  # an update clears the error


def test_vendor_trouble_is_redelivered(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/store")
    for i in (1, 2):
        s.add_file(None, f"text {i}")
    s.vendor_mode("down")
    assert {r.reason for r in s.backfill().collect()} == {"TRANSIENT"}
    assert {tuple(row[:3]) for row in ledger_rows(s).values()} == {("FAILED_RETRYABLE", 1, 0)} and s.messages.read().count() == 1
    assert s.consume("backfill").count() == 2 and s.messages.read().count() == 1
    s.vendor_mode("healthy")
    assert s.consume("backfill").where("outcome = 'done'").count() == 2 and s.messages.read().count() == 0
    assert {tuple(row[:3]) for row in ledger_rows(s).values()} == {("DONE", 3, 0)}
    assert s.backfill().count() == 0


def test_objects(spark, tmp_path):
    from haulmark.sources.objects import Missing, Objects, fetched

    store = Objects(spark, f"file://{tmp_path}/objects")
    assert store.read().count() == 0
    store.put(spark.createDataFrame([(f"files/{i}", bytearray(b"x" * i)) for i in range(1, 6)], "object_key string, bytes binary").repartition(3))
    store.put(spark.createDataFrame([("files/1", bytearray(b"again"))], "object_key string, bytes binary"))
    assert {r.object_key: bytes(r.bytes) for r in store.read().collect()} == {f"files/{i}": b"again" if i == 1 else b"x" * i for i in range(1, 6)}
    store.delete(spark.createDataFrame([("files/2",), ("files/77",)], "object_key string"))
    assert store.read().count() == 4
    with pytest.raises(Missing):
        store.store.get("files/2")
    get = store.store.get

    def flaky(key):
        if key == "files/3":
            raise OSError("timed out")
        return get(key)

    rows = fetched(spark.createDataFrame([(f"files/{i}",) for i in range(1, 6)], "object_key string").repartition(2), flaky).collect()
    assert {r.object_key: (r.bytes is None, r.error) for r in rows} == {"files/1": (False, None), "files/3": (True, "OSError: timed out"), "files/4": (False, None), "files/5": (False, None)}


def test_versions_keep_a_few_and_refuse_a_second_writer(spark, tmp_path):
    from haulmark.sources.sinks import Versions

    v = Versions(spark, f"file://{tmp_path}/t", "a long")
    for n in range(6):
        v.replace(spark.range(n).select(F.col("id").alias("a")))
    assert v.read().count() == 5 and v._numbers() == [3, 4, 5]


def test_tail_by_ids(spark):
    rows = [(i, 1, "STORED", "cdc", None, None) for i in range(1, 701)]
    df = spark.createDataFrame(rows, EVENT).repartition(4)
    t = tail.Tailer(lambda: df)
    first, second, third, fourth, fifth = (t.tick() for _ in range(5))
    assert [r.id for r in first] == list(range(1, 201)) and [r.id for r in second] == list(range(201, 401))
    assert [r.id for r in third] == list(range(401, 601)) and [r.id for r in fourth] == list(range(601, 701)) and fifth == [] and t.mark == 700


def test_event_stream(spark, tmp_path):
    rows = [(i, i % 7, "STORED" if i % 2 else "QUEUED", "cdc", None) for i in range(100)]
    made = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))
    df = spark.createDataFrame(rows, "id long, source_id long, stage string, lane string, detail string").withColumn("created_at", made)
    assert [f.name for f in df.schema] == [c.split()[0] for c in EVENT.split(", ")]
    df.repartitionByRange(3, "id").write.parquet(f"{tmp_path}/events")
    seen = []
    tail.follow(tail.read_events(spark, f"{tmp_path}/events", 1), f"{tmp_path}/check", lambda batch, n: seen.append([r.id for r in batch.select("id").collect()]))
    assert sorted(x for b in seen for x in b) == list(range(100)) and len(seen) == 3
    assert all(b == sorted(b) for b in seen)
    out = tail.throughput(tail.read_events(spark, f"{tmp_path}/events"))
    q = out.writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select max(files_per_second) from rates").first()[0] == 0.5
