"""The whole system over one folder: what its HTTP endpoints answer, as methods that return rows.

Tables live under the root as versions (files, document, ledger, checkpoint, messages) or appended rows (events); objects are
files of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark import schemas
from haulmark.functions import limits
from haulmark.functions import text as fn
from haulmark.operators import access, analytics, cdc, enrich, ledger, planning, reconcile
from haulmark.sources.objects import Objects
from haulmark.sources.sinks import Versions, append, events_for, remove

OUTCOME = "source_id long, outcome string, reason string"


class Service:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.mode, self.busy = spark, root.rstrip("/"), "healthy", False
        make = lambda name, schema: Versions(spark, f"{self.root}/{name}", schema)
        self.files, self.document = make("files", schemas.FILES), make("document", schemas.DOCUMENT)
        self.ledger, self.checkpoint = make("ledger", schemas.STATE), make("checkpoint", schemas.CHECKPOINT)
        self.messages = make("messages", "message string, lane string, sourceIds array<long>")
        self.objects = Objects(spark, f"{self.root}/objects")

    def health(self) -> dict:
        return {"status": "ok"}

    def events(self) -> DataFrame:
        empty = self.spark.createDataFrame([], schemas.EVENT)
        return self.spark.read.schema(schemas.EVENT).parquet(f"{self.root}/events") if self._has_events() else empty

    def _has_events(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/events")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _tell(self, ids: DataFrame, stage: str, lane: str | None, detail: str | None = None) -> None:
        append(events_for(ids, stage, lane, detail, F.current_timestamp()), f"{self.root}/events")

    def _told(self, rows: DataFrame) -> None:
        """Events (source_id, stage, lane, detail) that have a detail each."""
        now = F.current_timestamp()
        stamp = F.unix_micros(now) * 1024 + F.monotonically_increasing_id() % 1024
        append(rows.select(stamp.alias("id"), "source_id", "stage", "lane", "detail", now.alias("created_at")), f"{self.root}/events")

    def stats(self) -> DataFrame:
        snap = analytics.snapshot(self.files.read(), self.ledger.read(), self.document.read(), self.events(), F.current_timestamp())
        return snap.withColumn("vendor_mode", F.lit(self.mode))

    def trace(self, raw_id) -> DataFrame:
        return analytics.trace(self.events().where(F.col("source_id") == limits.source_id(raw_id))).orderBy("id")

    def recent(self, raw_limit=None) -> DataFrame:
        return analytics.shaped(analytics.recent_documents(self.document.read(), self.events(), limits.clamp_limit(raw_limit)))

    def vendor_mode(self, mode: str | None = None) -> str:
        if mode is not None:
            if mode not in schemas.VENDOR_MODES:
                raise ValueError(f"mode must be one of {', '.join(schemas.VENDOR_MODES)}")
            self.mode = mode
        return self.mode

    def add_files(self, raw_count=1, target_bytes: int = 0) -> DataFrame:
        """New generated files after the greatest id; returns them."""
        count = limits.bulk_count(raw_count)
        old = self.files.read()
        first = (old.agg(F.max("id")).first()[0] or 0) + 1
        text = fn.generated_text(F.col("id"), F.lit(target_bytes))
        new = self.spark.range(first, first + count).select(
            "id", fn.generated_name(F.col("id")).alias("filename"), F.lit("text/plain").alias("content_type"), F.encode(text, "UTF-8").alias("content"), F.octet_length(text).alias("byte_size"),
            F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
        )
        self.files.replace(old.unionByName(new))
        return self.files.read().where(F.col("id") >= first)

    def add_file(self, filename: str | None = None, text: str | None = None) -> int:
        """One file with this text; returns its id."""
        old = self.files.read()
        new = (old.agg(F.max("id")).first()[0] or 0) + 1
        now = F.current_timestamp()
        row = self.spark.createDataFrame([(new, filename, text)], "id long, name string, text string")
        self.files.replace(old.unionByName(row.select("id", *fn.upload(F.col("name"), F.col("text"), now), now.alias("created_at"), now.alias("updated_at"))))
        return new

    def top_up(self, target: int, target_bytes: int = 2048) -> int:
        """Generated files until there are target; returns how many were missing."""
        missing = max(0, target - self.files.read().count())
        for at in range(0, missing, limits.MAX_BULK):
            self.add_files(min(limits.MAX_BULK, missing - at), target_bytes)
        return missing

    def _seed(self, ids: DataFrame, lane: str) -> None:
        """Ledger rows for ids (source_id, source_created_at) that have none."""
        state = self.ledger.read()
        self.ledger.replace(state.unionByName(ledger.seed(state, ids, lane, F.current_timestamp())))

    def _migrate(self, ids: DataFrame, lane: str) -> DataFrame:
        """Condemns what has failed too often, claims what it can of the rest, and brings those that can be to DONE;
        (source_id, outcome, reason) for every id asked for."""
        now = F.current_timestamp()
        state, files = self.ledger.read(), self.files.read()
        found = enrich.outcomes(ids.select("source_id"), state, files, ledger.claimable(now), ledger.at_cap())
        if trouble := enrich.TROUBLE.get(self.mode):  # the vendor answers nobody; results that are kept need no answer
            asked = F.col("reason").isin("fresh", "PERMANENT")
            found = found.withColumns({"outcome": F.when(asked, "retryable").otherwise(F.col("outcome")), "reason": F.when(asked, trouble).otherwise(F.col("reason"))})
        told = self._kept("outcomes", OUTCOME, found)
        over = told.where("reason = 'MAX_RETRY_ATTEMPTS_EXCEEDED'").select("source_id")
        claimed = told.where("reason not in ('MAX_RETRY_ATTEMPTS_EXCEEDED', 'not claimed', 'repeated')")
        done, fresh = (claimed.where(c).select("source_id") for c in ("outcome = 'done'", "reason = 'fresh'"))
        failed = claimed.where("outcome in ('permanent', 'retryable')")
        self._told(enrich.dead_letters(state.join(over, "source_id", "left_semi").select("source_id", F.lit(lane).alias("lane"), F.lit("MAX_RETRY_ATTEMPTS_EXCEEDED").alias("reason"), "attempts", "last_error")))
        self._tell(claimed.select("source_id"), "CLAIMED", lane)
        self._tell(fresh, "OCR_DONE", lane)

        chosen = files.join(done.select(F.col("source_id").alias("id")), "id", "left_semi")
        self.objects.put(chosen.select(fn.object_key(F.col("id")).alias("object_key"), F.col("content").alias("bytes")))
        self.document.upsert(enrich.extracted(chosen).withColumn("migrated_at", now), "source_id", F.lit(1).cast("long"))

        read = chosen.join(fresh.select(F.col("source_id").alias("id")), "id", "left_semi")
        counts = ~F.col("reason").isin(*enrich.TROUBLE.values())
        state = ledger.claim(ledger.condemn(state, over, now), claimed.select("source_id"), now)
        state = ledger.save_payload(state, read.select(F.col("id").alias("source_id"), fn.ocr_payload(F.col("id"), F.col("content")).alias("payload")), now)
        state = ledger.mark_done(state, chosen.select(F.col("id").alias("source_id"), fn.sha256_hex(F.col("content")).alias("checksum")), now)
        state = ledger.mark_failed(state, failed.select("source_id", (F.col("outcome") == "permanent").alias("permanent"), counts.alias("counts"), F.col("reason").alias("error")), now)
        self.ledger.replace(state)

        self._tell(done, "STORED", lane)
        self._tell(failed.where("outcome = 'retryable'").select("source_id"), "RETRY", lane)
        bad = failed.where("outcome = 'permanent'").select("source_id", "reason")
        self._told(enrich.dead_letters(self.ledger.read().drop("lane").join(bad, "source_id").select("source_id", F.lit(lane).alias("lane"), "reason", "attempts", "last_error")))
        return told

    def _kept(self, name: str, schema: str, rows: DataFrame) -> DataFrame:
        """rows as they are now, whatever is written to the tables they come from."""
        table = Versions(self.spark, f"{self.root}/{name}", schema)
        table.replace(rows)
        return table.read()

    def backfill(self) -> DataFrame:
        """Plans ranges up to the greatest id, claims those that are free, queues their files in batches and migrates these; a
        range is DONE once it is queued."""
        now = F.current_timestamp()
        planned = planning.plan(self.checkpoint.read(), access.max_id(self.files.read()))
        self.checkpoint.replace(planning.claim_all(planning.reap_expired(planned, now), now))
        mine = self.checkpoint.read().where("status = 'CLAIMED'")
        files = planning.in_ranges(self.files.read(), mine)
        ids = files.select(F.col("id").alias("source_id"), F.col("created_at").alias("source_created_at"))
        self._tell(ids, "CDC_CAPTURED", "backfill")
        self._seed(ids, "backfill")
        queued = planning.batches(files).select(F.concat_ws(":", F.lit("backfill"), "range_start", "batch").alias("message"), "lane", "sourceIds")
        self.messages.replace(self.messages.read().unionByName(queued))
        self._tell(ids, "QUEUED", "backfill")
        self._told(planning.range_events(mine))
        self.checkpoint.replace(planning.mark_range_done(self.checkpoint.read(), mine))
        return self.consume("backfill")

    def consume(self, lane: str) -> DataFrame:
        """Migrates the ids of the lane's messages. A message goes once none of its ids is unresolved; the others come again with
        the next call."""
        messages = self.messages.read()
        asked = messages.where(F.col("lane") == lane)
        told = self._migrate(asked.select(F.explode("sourceIds").alias("source_id")).distinct(), lane)
        over = enrich.acknowledged(asked, self.ledger.read()).where("ack").select("message")
        self.messages.replace(messages.join(over, "message", "left_anti"))
        return told

    def apply_changes(self, log: DataFrame) -> DataFrame:
        """log (seq, value): what its changes in turn come to. Any deletion takes document, ledger row and object away; of what
        comes after an id's last one, each update resets it and runs it again, and a create or read runs it if it isn't done.

        Changes are coalesced: an id runs once, and the attempts of the runs before are added to its row, as each of them
        would have ended like the last. An id that may not end well (no source, nothing in it, the vendor down, too many
        failures) is taken through its changes one by one, so that failures in a row count."""
        now = F.current_timestamp()
        rows = self._kept("changes", "seq long, id long, op string, version long, created_at timestamp", cdc.changes(log))
        self._tell(rows.select(F.col("id").alias("source_id")), "CDC_CAPTURED", "cdc")
        last = rows.where("op = 'd'").groupBy("id").agg(F.max("seq").alias("gone"))
        gone = last.select(F.col("id").alias("source_id"))
        self.ledger.replace(ledger.tombstone(self.ledger.read(), gone))
        self.document.replace(self.document.read().join(gone, "source_id", "left_anti"))
        self.objects.delete(gone.select(fn.object_key(F.col("source_id")).alias("object_key")))

        files = self.files.read().select("id", F.col("created_at").alias("own"), (F.octet_length("content") > 0).alias("full"))
        tired = self.ledger.read().select(F.col("source_id").alias("id"), (F.col("consecutive_failures") >= ledger.MAX_FAILURES).alias("tired"))
        live = rows.join(last, "id", "left").where("gone is null or seq > gone").join(files, "id", "left").join(tired, "id", "left")
        good = F.coalesce("full", F.lit(False)) & ~F.coalesce("tired", F.lit(False)) & F.lit(self.mode not in enrich.TROUBLE)
        step = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
        live = live.select(F.col("id").alias("source_id"), "seq", "op", "version", F.coalesce("created_at", "own").alias("source_created_at"), good.alias("good"), step.alias("step"))
        live = self._kept("live", "source_id long, seq long, op string, version long, source_created_at timestamp, good boolean, step int", live)

        update = F.col("op") == "u"
        well = live.where("good").groupBy("source_id").agg(
            F.count_if(update).cast("int").alias("updates"), F.min_by("op", "seq").alias("first"), F.min_by("source_created_at", "seq").alias("source_created_at"),
            F.max_by(F.when(update, F.col("version")), F.when(update, F.col("seq"))).alias("version"),
        )
        self._seed(well.select("source_id", "source_created_at"), "cdc")
        state = self.ledger.read()
        before = F.col("updates") + F.when(F.col("first").isin("c", "r") & ledger.claimable(now), 1).otherwise(0) - 1
        runs = state.join(well.drop("source_created_at"), "source_id").select("source_id", "version", "updates", before.alias("before"))
        more = ledger.change(state, runs.where("before > 0").select("source_id", "before"), F.lit(True), F.col("updated_at"), attempts=F.col("attempts") + F.col("before"))
        self.ledger.replace(ledger.reset_for_update(more, runs.where("updates > 0").select("source_id", "version"), now))
        told = [self._deliver(well.select("source_id"), 0)]
        ill = live.where("not good")
        for n in range(1, (ill.agg(F.max("step")).first()[0] or 0) + 1):
            one = ill.where(F.col("step") == n)
            self._seed(one.select("source_id", "source_created_at"), "cdc")
            self.ledger.replace(ledger.reset_for_update(self.ledger.read(), one.where(update).select("source_id", "version"), now))
            told.append(self._deliver(one.select("source_id"), n))
        return self._kept("applied", OUTCOME, reduce(DataFrame.unionByName, told))

    def _deliver(self, ids: DataFrame, step: int) -> DataFrame:
        """Migrates ids, each a message of its own; those that stay unresolved come again with consume()."""
        self._tell(ids, "QUEUED", "cdc")
        told = self._kept(f"steps/{step}", OUTCOME, self._migrate(ids, "cdc"))
        key = F.concat_ws(":", F.lit("cdc"), "source_id").alias("message")
        open_ = ids.join(self.ledger.read().where(ledger.unresolved()).select("source_id"), "source_id", "left_semi")
        others = self.messages.read().join(ids.select(key), "message", "left_anti")
        self.messages.replace(others.unionByName(open_.select(key, F.lit("cdc").alias("lane"), F.array("source_id").alias("sourceIds"))))
        return told

    def reconcile(self) -> DataFrame:
        return reconcile.summary(self.files.read(), self.document.read(), self.ledger.read(), self.objects.read())

    def restart(self, target: int, target_bytes: int = 2048) -> None:
        """The vendor healthy, all tables emptied (events too, whose ids go on rising), objects deleted, the source seeded
        again; one at a time."""
        if self.busy:
            raise RuntimeError("a restart is running")
        self.busy = True
        try:
            self.mode = "healthy"
            for t in (self.files, self.document, self.ledger, self.checkpoint, self.messages):
                t.replace(self.spark.createDataFrame([], t.schema))
            remove(self.spark, f"{self.root}/events")
            self.objects.delete(self.objects.read().select("object_key"))
            self.top_up(target, target_bytes)
        finally:
            self.busy = False
