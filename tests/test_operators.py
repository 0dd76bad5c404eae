import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulmark import schemas
from haulmark.functions import limits
from haulmark.functions import text as fn
from haulmark.operators import access, analytics, cdc, enrich, governor, ledger, planning, reconcile
from haulmark.operators.enrich import VendorError
from haulmark.operators.governor import Breaker, LaneLimiter, delay_ms, governed
from haulmark.streaming import changes
from haulmark.streaming.changes import advance


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a  b", "A B"), ("a\t\tb", "A B"), ("a\n\r\nb", "A B"), ("  a ", "A"), ("", ""), ("   ", ""), ("a b", "A B"), ("﻿a", "A"), ("a  b", "A B"), ("a　b", "A B"),
        (" ", ""), ("﻿", ""), ("café  über\t日本語", "CAFÉ ÜBER 日本語"), ("abc \u0085", "ABC \u0085"), ("straße", "STRASSE"), ("Mixed CASE", "MIXED CASE"),
    ],
)
def test_extract_text(spark, raw, want):
    df = spark.createDataFrame([(bytearray(raw.encode()),)], "content binary")
    assert df.select(fn.extract_text(F.col("content"))).first()[0] == want


def test_malformed_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff b\xc3"),)], "content binary")
    assert df.select(fn.extract_text(F.col("content"))).first()[0] == b"A\xff B\xc3".decode(errors="replace")


@pytest.mark.parametrize(("top", "size", "want"), [(3000, 1000, [(1, 1000), (1001, 2000), (2001, 3000)]), (2500, 1000, [(1, 1000), (1001, 2000), (2001, 3000)]), (500, 1000, [(1, 1000)]), (0, 1000, []), (-5, 1000, [])])
def test_ranges(spark, top, size, want):
    assert sorted(map(tuple, planning.ranges(planning.max_of(spark, top), size).collect())) == want


@given(st.lists(st.integers(), max_size=200), st.integers(1, 40))
@settings(max_examples=50, deadline=None)
def test_chunks_cover(ids, size):
    parts = planning.chunked(ids, size)
    assert [x for p in parts for x in p] == ids and all(len(p) == size for p in parts[:-1]) and all(parts)


def test_batches_hold_each_id_once(spark):
    for bad in (0, -1):
        with pytest.raises(ValueError):
            planning.chunked([1], bad)
    rows = planning.batches(spark.range(1, 102), 1000, 25).orderBy("batch").collect()
    assert [len(r.sourceIds) for r in rows] == [25, 25, 25, 25, 1] and [x for r in rows for x in r.sourceIds] == list(range(1, 102))


def test_limits():
    assert [limits.clamp_limit(x) for x in (None, "", "abc", "0", "-3", "12abc", 7, "1000")] == [8, 8, 8, 8, 8, 12, 7, 50]
    assert limits.bulk_count("1000") == 1000 and limits.bulk_count(1) == 1
    for bad in (0, -1, 1.5, 1001, "x", None, "nan"):
        with pytest.raises(ValueError):
            limits.bulk_count(bad)
    with pytest.raises(ValueError):
        limits.source_id("12x")


def test_to_finite_number(spark):
    df = spark.createDataFrame([("1.5",), (None,), ("x",), ("NaN",), ("Infinity",)], "v string")
    assert [r[0] for r in df.select(fn.to_finite_number(F.col("v"), -1)).collect()] == [1.5, 0.0, -1.0, -1.0, -1.0]


def test_formatters(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0004,), (0.25,), (59.96,), (61.4,), (3_725.0,)], "s double")
    assert [r[0] for r in df.select(fn.format_duration(F.col("s"))).collect()] == ["unknown", "unknown", "0ms", "250ms", "60.0s", "1m 1s", "62m 5s"]
    assert [r[0] for r in df.select(fn.format_seconds(F.col("s"))).collect()] == ["0s", "0s", "0s", "0s", "1m 0s", "1m 1s", "1h 2m"]
    sizes = spark.createDataFrame([(None,), (0,), (1023,), (1024,), (1536,), (1 << 20,)], "b long")
    assert [r[0] for r in sizes.select(fn.format_bytes(F.col("b"))).collect()] == ["unknown size", "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB"]


@pytest.mark.parametrize("size", [0, 1, 32, 500, 2048, 10_000])
def test_generated_documents(spark, size):
    names = ["ACME SUPPLY CO", "NORTHWIND TRADING", "GLOBEX INDUSTRIES", "INITECH LLC"]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 5, 37, 999, 123_456, 123_456_789)], "id long")
    for r in ids.select("id", fn.generated_text(F.col("id"), F.lit(size)).alias("t"), fn.generated_name(F.col("id")).alias("n")).collect():
        head = f"INVOICE {r.id:08d}\nVENDOR {names[r.id % 4]}\nAMOUNT DUE {r.id * 37 % 100_000 / 100:.2f}\n"
        body = head + f"LINE ITEM REFERENCE {r.id} " * max(0, -(-(size - len(head)) // 24))
        assert r.t == body[: max(len(head), size)] and r.n == f"invoice-{r.id:08d}.txt"


def state(spark, *rows):
    wide = [(i, "cdc", s, a, cf, v, None, None, None, None, None) for i, s, a, cf, v in rows]
    return spark.createDataFrame(wide, schemas.STATE).withColumn("updated_at", F.timestamp_seconds(F.lit(1000)))


class _Now:
    """Built when a session is there."""

    def __get__(self, *_):
        return F.timestamp_seconds(F.lit(1100))


class At:
    now = _Now()


AT = At()


def test_versions_and_failures(spark):
    s = state(spark, (1, "DONE", 1, 2, 100), (2, "FAILED_PERMANENT", 1, 2, 100), (3, "IN_FLIGHT", 1, 2, 100))
    ids = spark.createDataFrame([(1, 100), (2, 101), (3, 99)], "source_id long, version long")
    out = {r.source_id: r for r in ledger.reset_for_update(s, ids, AT.now).collect()}
    assert [(out[i].status, out[i].consecutive_failures, out[i].source_version) for i in (1, 2, 3)] == [("PENDING", 2, 100), ("PENDING", 0, 101), ("PENDING", 2, 99)]


def test_claims_and_leases(spark):
    s = state(spark, (1, "PENDING", 0, 0, 0), (2, "IN_FLIGHT", 1, 0, 0), (3, "DONE", 1, 0, 0), (4, "FAILED_RETRYABLE", 1, 9, 0))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "source_id long")
    late = {r.source_id: (r.status, r.attempts) for r in ledger.claim(s, ids, AT.now).collect()}
    assert late == {1: ("IN_FLIGHT", 1), 2: ("IN_FLIGHT", 2), 3: ("DONE", 1), 4: ("IN_FLIGHT", 2)}
    early = {r.source_id: r.attempts for r in ledger.claim(s, ids, F.timestamp_seconds(F.lit(1050))).collect()}
    assert early[2] == 1
    assert {r.source_id for r in ledger.condemn(s, ids, AT.now).where("status = 'FAILED_PERMANENT'").collect()} == {4}
    assert [r.source_id for r in ledger.seed(s, ids, "backfill", AT.now).collect()] == [9]


def test_outcomes_sum_to_what_was_asked(spark):
    rng = random.Random(6)
    s = state(spark, *((i, rng.choice(schemas.STATUSES), 0, rng.randint(0, 7), 0) for i in range(100)))
    asked = [rng.randint(0, 130) for _ in range(300)]
    files = spark.createDataFrame([(i, bytearray(b"x" * (i % 4))) for i in range(0, 100, 2)], "id long, content binary")
    out = enrich.outcomes(spark.createDataFrame([(i,) for i in asked], "source_id long"), s, files, ledger.claimable(AT.now), ledger.at_cap())
    assert sum(r.n for r in enrich.tally(out).collect()) == 300


def test_vendor_isolates_poison(spark):
    files = spark.createDataFrame([(i, bytearray(b"x")) for i in (40, 41, 42)], "id long, content binary").coalesce(1)

    def vendor(rows):
        if any(i == 41 for i, _ in rows):
            raise VendorError("PERMANENT")
        return {i: "T" for i, _ in rows}

    out = {r.source_id: r.outcome for r in enrich.call_vendor(files, vendor).collect()}
    assert out == {40: "done", 41: "permanent", 42: "done"}

    def down(rows):
        raise VendorError("TRANSIENT")

    assert {r.outcome for r in enrich.call_vendor(files, down).collect()} == {"retryable"}
    assert {r.reason for r in enrich.call_vendor(files, lambda rows: {}).collect()} == {"omitted"}


def test_lanes():
    a = LaneLimiter(100, 20)
    assert sum(a.try_acquire("backfill", 0.1) for _ in range(100)) == 80 and sum(a.try_acquire("cdc", 0.2) for _ in range(100)) == 20
    b = LaneLimiter(100, 20)
    assert sum(b.try_acquire("cdc", 5) for _ in range(80)) == 80 and sum(b.try_acquire("backfill", 5.9) for _ in range(50)) == 20
    assert b.try_acquire("backfill", 6)
    with pytest.raises(ValueError):
        b.try_acquire("other", 6)


def test_breaker_opens_and_recovers():
    b = Breaker()
    for i in range(5):
        assert b.permits(i)
        b.record(True, i)
    assert b.state == "OPEN" and not b.permits(5) and b.permits(14) and b.state == "HALF_OPEN"
    b.record(True, 14)
    assert b.state == "OPEN" and b.permits(24)
    b.record(False, 24)
    assert b.state == "CLOSED" and [e for _, e in b.events] == ["BREAKER_OPEN", "BREAKER_OPEN", "BREAKER_CLOSED"]


def test_governed_retries():
    def failing(times, kind, after=None):
        left = [times]

        def call():
            if left[0]:
                left[0] -= 1
                raise VendorError(kind, retry_after_ms=after)
            return "ok"

        return call

    waits = []
    run = lambda call, n=5: governed(call, Breaker(), lambda: 0.0, waits.append, n)
    assert run(failing(2, "TRANSIENT")) == "ok" and len(waits) == 2 and 0.1 <= waits[0] <= 0.15 and 0.2 <= waits[1] <= 0.3
    with pytest.raises(VendorError):
        run(failing(1, "PERMANENT"))
    waits.clear()
    with pytest.raises(VendorError):
        run(failing(9, "TRANSIENT"), 3)
    assert len(waits) == 2
    waits.clear()
    assert run(failing(1, "RATE_LIMITED", 100)) == "ok" and waits == [0.1]
    assert delay_ms(VendorError("TRANSIENT"), 3, 0, random.Random(1)) == 0


CASES = [
    ('{"op":"c","before":null,"after":{"id":1,"filename":"invoice-1.txt","content_type":"text/plain","byte_size":10},"ts_ms":1700000000000,"source":{"table":"files"}}', "c"),
    ('{"op":"d","before":{"id":4},"after":{"id":999}}', "d"), (None, "tombstone"), ("this is not json", "malformed"), ('{"op":"c","after":null}', "no_id"), ('{"op":"t"}', "no_id"), ('{"op":"t","after":{"id":3}}', "unknown_op"), ("", "malformed"),
]


def test_routes(spark):
    log = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "seq long, value string")
    rows = cdc.routed(log).orderBy("seq").collect()
    assert [r.route for r in rows] == [w for _, w in CASES] and rows[1].id == 4 and rows[0].version == 1_700_000_000_000 and rows[1].version == 0


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 12), rng.choice("cruuud"), rng.randint(1, 50)) for i in range(300)]
    want: dict = {}
    for seq, key, op, version in rows:
        want[key] = advance(want.get(key), seq, op, version)
    df = spark.createDataFrame(rows, "seq long, id long, op string, version long")
    got = {r.source_id: (r.attempts, r.source_version, r.last_seq) for r in cdc.fold(df).collect()}
    assert got == {k: (a, v, s) for k, (a, v, s, alive) in want.items() if alive}


def test_reconcile_finds_compensating_faults(spark):
    files = spark.createDataFrame([(i, bytearray(f"text {i}".encode())) for i in range(1, 6)], "id long, content binary")
    good = files.select(F.col("id").alias("source_id"), fn.object_key(F.col("id")).alias("object_key"), fn.sha256_hex(F.col("content")).alias("checksum_sha256"), fn.extract_text(F.col("content")).alias("ocr_text"))
    objects = files.select(fn.object_key(F.col("id")).alias("object_key"), F.col("content").alias("bytes"))
    rows = good.select("source_id", F.lit("DONE").alias("status"))
    assert reconcile.summary(files, good, rows, objects).first().clean
    swapped = good.withColumn("source_id", F.when(F.col("source_id") == 2, 77).otherwise(F.col("source_id")))
    found = {tuple(r) for r in reconcile.defects(files, swapped, rows.withColumn("source_id", F.when(F.col("source_id") == 3, 88).otherwise(F.col("source_id"))), objects).collect()}
    assert found == {("missing_document", 2), ("orphan_document", 77), ("missing_ledger", 3), ("orphan_ledger", 88)}
    broken = objects.withColumn("error", F.when(F.col("object_key") == "files/4", "io")).withColumn("bytes", F.when(F.col("error").isNull(), F.col("bytes")))
    assert {tuple(r) for r in reconcile.defects(files, good, rows, broken).collect()} == {("unreadable_object", 4)}
    upper = good.withColumn("checksum_sha256", F.upper("checksum_sha256"))
    assert reconcile.defects(files, upper, rows, objects).count() == 0


def test_breaker_state_and_tail(spark):
    events = lambda rows: spark.createDataFrame(rows, "id long, stage string")
    assert analytics.breaker_state(events([])).first()[0] == "CLOSED"
    assert analytics.breaker_state(events([(2, "BREAKER_OPEN"), (1, "BREAKER_CLOSED"), (3, "STORED")])).first()[0] == "OPEN"
    tail = analytics.tail(events([(i, "STORED") for i in range(1, 501)]), 0).collect()
    assert [r.id for r in tail] == list(range(1, 201))
    assert analytics.tail(events([(i, "STORED") for i in range(1, 501)]), 200).first().id == 201


def test_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, "e", 1)], "k long, v string, n long")
    assert sorted(map(tuple, access.upsert_latest(old, new, "k", F.col("n")).collect())) == [(1, "a"), (2, "c"), (3, "e")]


def _calls(spark, n, seconds):
    rng = random.Random(4)
    rows = [(i, rng.choice(["cdc", "backfill", "backfill"]), rng.randrange(seconds * 1_000_000), rng.randrange(3), rng.random() < 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, lane string, t long, vendor long, transient boolean")
    return rows, df.withColumn("at", F.timestamp_micros("t"))


def test_limited_equals_the_limiter(spark):
    rows, df = _calls(spark, 1500, 12)
    for rate, share in ((100, 20), (30, 0), (7, 100), (1000, 50)):
        limiter = governor.LaneLimiter(rate, share)
        want = {i: limiter.try_acquire(lane, t / 1e6) for i, lane, t, *_ in sorted(rows, key=lambda r: (r[2], r[0]))}
        assert {r.id: r.granted for r in governor.limited(df, rate, share).collect()} == want


def test_broken_equals_the_breaker(spark):
    rows, df = _calls(spark, 600, 90)
    want, breakers = {}, {v: governor.Breaker() for v in range(3)}
    for i, _, t, vendor, transient in sorted(rows, key=lambda r: (r[2], r[0])):
        b = breakers[vendor]
        if permitted := b.permits(t / 1e6):
            b.record(transient, t / 1e6)
        want[i] = (permitted, b.state)
    assert {r.id: (r.permitted, r.state) for r in governor.broken(df).collect()} == want
    assert {s for _, s in want.values()} == {"OPEN", "CLOSED", "HALF_OPEN"} or {s for _, s in want.values()} == {"OPEN", "CLOSED"}


def test_governor_waits_for_permits_and_pauses_lanes():
    now, waits, told = [100.25], [], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    class Lane:
        def __init__(self):
            self.on = True

        def stop(self):
            self.on = False

    lanes = []
    control = governor.LaneControl({lane: lambda: lanes.append(Lane()) or lanes[-1] for lane in ("cdc", "backfill")}, told.append)
    g = governor.Governor(governor.LaneLimiter(2, 20), governor.Breaker(told=control), lambda: now[0], sleep, attempts=3, base_ms=0)
    assert [g.execute("cdc", lambda: 1) for _ in range(3)] == [1, 1, 1] and waits == [0.75]

    def fail():
        raise enrich.VendorError("TRANSIENT")

    for _ in range(3):
        with pytest.raises(enrich.VendorError):
            g.execute("cdc", fail)
    assert g.breaker.state == "OPEN" and told == ["BREAKER_OPEN"] and control.running == {} and not any(x.on for x in lanes)
    with pytest.raises(enrich.VendorError):
        g.execute("cdc", lambda: 1)
    now[0] += governor.OPEN_S
    assert g.execute("backfill", lambda: 2) == 2
    assert told == ["BREAKER_OPEN", "BREAKER_CLOSED"] and sorted(control.running) == ["backfill", "cdc"] and sum(x.on for x in lanes) == 2


def test_lanes_of_streaming_queries(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")

    def begin():
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        return rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").start()

    control = governor.LaneControl({"cdc": begin}, lambda _: None)
    control.running["cdc"].processAllAvailable()
    control("OPEN")
    assert not spark.streams.active
    spark.range(10, 15).write.mode("append").parquet(f"{tmp_path}/in")
    control("HALF_OPEN")
    control.running["cdc"].processAllAvailable()
    control("OPEN")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(15))


def test_vendor_calls_through_a_governor(spark):
    files = spark.createDataFrame([(i, bytearray(f"text {i}".encode())) for i in range(1, 9)], "id long, content binary").coalesce(1)

    def make():
        calls = []

        def vendor_fails_once(call):
            def attempt():
                calls.append(1)
                if len(calls) == 1:
                    raise enrich.VendorError("TRANSIENT")
                return call()

            return governor.Governor(governor.LaneLimiter(), governor.Breaker(), lambda: 0.0, lambda _: None).execute("cdc", attempt)

        return vendor_fails_once

    rows = enrich.call_vendor(files, lambda batch: {i: c.decode() for i, c in batch}, 4, make).collect()
    assert {r.outcome for r in rows} == {"done"} and len(rows) == 8
    real = enrich.call_vendor(files, lambda batch: {i: c.decode() for i, c in batch}, 4, governor.for_lane("backfill", 2)).collect()
    assert {(r.source_id, r.text) for r in real} == {(i, f"text {i}") for i in range(1, 9)}


def test_plans_of_ranges(spark):
    empty = spark.createDataFrame([], schemas.CHECKPOINT)
    first = planning.plan(empty, planning.max_of(spark, 2500))
    assert sorted((r.range_start, r.range_end, r.status) for r in first.collect()) == [(1, 1000, "PENDING"), (1001, 2000, "PENDING"), (2001, 3000, "PENDING")]
    done = planning.mark_range_done(first, first.where("range_start = 1"))
    again = planning.plan(done, planning.max_of(spark, 3001))
    assert sorted((r.range_start, r.status) for r in again.collect()) == [(1, "DONE"), (1001, "PENDING"), (2001, "PENDING"), (3001, "PENDING")]
    assert planning.plan(empty, planning.max_of(spark, 0)).collect() == []
    files = spark.range(1, 3002)
    assert planning.in_ranges(files, again.where("range_start = 3001")).collect() == [(3001,)]


def folded(spark, folder, *parts):
    """The streaming job run after each part; a job that goes on with nothing to read is stopped, and fails the test."""
    for part in parts:
        spark.createDataFrame(part, changes.LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        job = threading.Thread(target=changes.run, args=(spark, f"{folder}/log", f"{folder}/out"), daemon=True)
        job.start()
        job.join(60)
        busy = job.is_alive()
        for query in spark.streams.active:
            query.stop()
        assert not busy


def envelope(op, key, at):
    image = f'{{"id": {key}, "filename": "f{key}", "byte_size": 10}}'
    return f'{{"op": "{op}", "before": {image if op == "d" else "null"}, "after": {"null" if op == "d" else image}, "ts_ms": {at}}}'


def test_streaming_fold_ends_when_the_log_is_read(spark, tmp_path):
    held = spark.conf.get(changes.EMPTY_BATCHES)
    first = [(1, envelope("c", 1, 10)), (2, envelope("c", 2, 20)), (3, "this is not json")]
    folded(spark, tmp_path, first, [(4, envelope("u", 1, 40)), (5, envelope("d", 2, 50))])
    assert [(r.source_id, r.attempts, r.source_version, r.last_seq) for r in changes.ledger_of(spark, f"{tmp_path}/out").collect()] == [(1, 2, 40, 4)]
    assert sorted(p.name for p in (tmp_path / "out/ledger").glob("batch=*")) == ["batch=0", "batch=1"]
    assert spark.conf.get(changes.EMPTY_BATCHES) == held


def test_streaming_fold_forgets_old_tombstones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "TOMBSTONE_DAYS", 1 / 86_400_000)
    folded(spark, tmp_path, [(5, envelope("d", 1, 10))], [(6, envelope("c", 2, 20))], [(4, envelope("c", 1, 30))])
    rows = spark.read.parquet(f"{tmp_path}/out/ledger/batch=2").collect()
    assert [(r.source_id, r.last_seq, r.deleted, r.late) for r in rows] == [(1, 4, False, 0)]


def test_a_filter_on_envelopes_parses_each_text_once(spark):
    log = spark.createDataFrame([(1, envelope("c", 1, 10)), (2, envelope("d", 1, 20)), (3, "this is not json"), (4, None)], changes.LOG)
    for rows in (cdc.changes(log), cdc.routed(log).where("route in ('tombstone', 'malformed')")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert sorted((r.seq, r.id, r.op, r.version) for r in cdc.changes(log).collect()) == [(1, 1, "c", 10), (2, 1, "d", 20)]
    assert sorted((r.seq, r.route) for r in cdc.routed(log).collect()) == [(1, "c"), (2, "d"), (3, "malformed"), (4, "tombstone")]


def test_streaming_fold_keeps_a_stretch_of_keys_in_one_state(spark, tmp_path):
    ids = [*range(-3, 96), 2**60 + 1, 2**60 + 2]
    first = [(n, envelope("c", i, n)) for n, i in enumerate(ids, 1)]
    second = [(1_000 + n, envelope("d" if n % 3 == 0 else "u", i, 1_000 + n)) for n, i in enumerate(ids) if n % 2]
    third = [(2_000 + n, envelope("r" if n % 2 else "u", i, 2_000 + n)) for n, i in enumerate(ids) if n % 5 == 0]
    folded(spark, tmp_path, first, second, [*third, second[0], second[1]])
    want = cdc.fold(cdc.changes(spark.createDataFrame([*first, *second, *third], changes.LOG)))
    columns = ["source_id", "lane", "status", "attempts", "source_version", "last_seq"]
    assert sorted(changes.ledger_of(spark, f"{tmp_path}/out").select(columns).collect()) == sorted(want.select(columns).collect())
    late = spark.read.parquet(f"{tmp_path}/out/ledger/batch=2").where("late > 0").collect()
    assert sorted((r.source_id, r.last_seq, r.late) for r in late) == [(-2, 1_001, 1), (0, 1_003, 1)]
    states = spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint/ledger")
    assert states.count() == len({i >> 5 for i in ids})


def test_streaming_fold_forgets_a_tombstone_beside_live_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "TOMBSTONE_DAYS", 1 / 86_400_000)
    away = [(9, envelope("c", 1_000, 30))]
    folded(spark, tmp_path, [(5, envelope("d", 1, 10)), (6, envelope("c", 2, 20))], away, [(4, envelope("c", 1, 30)), (8, envelope("u", 2, 40)), (6, envelope("c", 2, 20))])
    rows = spark.read.parquet(f"{tmp_path}/out/ledger/batch=2").collect()
    assert sorted((r.source_id, r.attempts, r.last_seq, r.deleted, r.late) for r in rows) == [(1, 1, 4, False, 0), (2, 2, 8, False, 1)]


def test_answers_of_many_calls_come_in_one_frame():
    import pandas as pd

    class Taken:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return run

    def sizes(n, vendor, batch):
        frames = (pd.DataFrame({"id": range(at, at + 1_000), "content": [b"text"] * 1_000}) for at in range(0, n, 1_000))
        found = list(enrich.call_vendor(Taken(), vendor, batch)(frames))
        assert pd.concat(found)["source_id"].tolist() == list(range(n))
        return [len(f) for f in found]

    def down(rows):
        raise VendorError("TRANSIENT")

    assert sizes(1_000, lambda rows: {i: c.decode() for i, c in rows}, 25) == [1_000]
    assert sizes(25_000, down, 1) == [enrich.OUT_ROWS, enrich.OUT_ROWS, 5_000]
    long = "x" * (enrich.OUT_CHARS // 100)
    assert sizes(1_000, lambda rows: {i: long for i, _ in rows}, 25) == [100] * 10
