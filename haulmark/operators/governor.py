"""Flow control: two-lane rate limit, circuit breaker and retries, with the clock as an argument."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.operators.enrich import VendorError
from haulmark.schemas import LANES

# Calls a second, share kept for cdc, attempts, breaker window.
CALLS_A_SECOND, CDC_SHARE, MAX_ATTEMPTS = 50, 20, 5
WINDOW, LEAST_CALLS, THRESHOLD, OPEN_S, TRIALS = 10, 5, 50.0, 10, 1


@dataclass
class LaneLimiter:
    """Permits by the second: a shared pool, and the share of each lane. A refused lane costs the pool nothing."""

    rate: int = CALLS_A_SECOND
    cdc_share: int = CDC_SHARE
    second: int | None = None
    left: dict[str, int] = field(default_factory=dict)

    def try_acquire(self, lane: str, now: float) -> bool:
        if lane not in LANES:
            raise ValueError(f"unknown lane: {lane}")
        if self.second != int(now):
            self.second = int(now)
            self.left = {"shared": self.rate, "cdc": self.rate, "backfill": self.rate * (100 - self.cdc_share) // 100}
        if min(self.left["shared"], self.left[lane]) < 1:
            return False
        self.left["shared"] -= 1
        self.left[lane] -= 1
        return True


@dataclass
class Breaker:
    """Opens when enough of the last calls were transient failures; lets one through some time later."""

    state: str = "CLOSED"
    calls: list[bool] = field(default_factory=list)
    since: float = 0.0
    events: list[tuple[float, str]] = field(default_factory=list)
    told: Callable[[str], None] | None = None

    def _to(self, state: str, now: float) -> None:
        if self.told:
            self.told(state)
        if state != "HALF_OPEN":
            self.events.append((now, "BREAKER_OPEN" if state == "OPEN" else "BREAKER_CLOSED"))
        self.state, self.calls, self.since = state, [], now

    def permits(self, now: float) -> bool:
        if self.state == "OPEN" and now >= self.since + OPEN_S:
            self._to("HALF_OPEN", self.since + OPEN_S)
        return self.state == "CLOSED" or (self.state == "HALF_OPEN" and len(self.calls) < TRIALS)

    def record(self, transient: bool, now: float) -> None:
        if self.state == "OPEN":
            return
        self.calls = [*self.calls, transient][-WINDOW:]
        if self.state == "HALF_OPEN":
            if len(self.calls) >= TRIALS:
                self._to("OPEN" if 100 * sum(self.calls) >= THRESHOLD * len(self.calls) else "CLOSED", now)
        elif len(self.calls) >= LEAST_CALLS and 100 * sum(self.calls) >= THRESHOLD * len(self.calls):
            self._to("OPEN", now)


def delay_ms(error: VendorError, attempt: int, base_ms: int, rng: random.Random) -> int:
    if error.error_class == "RATE_LIMITED" and error.retry_after_ms is not None:
        return error.retry_after_ms
    wait = base_ms << (attempt - 1)
    return wait + int(rng.random() * wait / 2)


def governed(call: Callable, breaker: Breaker, clock: Callable[[], float], sleep: Callable[[float], None], attempts: int = MAX_ATTEMPTS, base_ms: int = 100, rng: random.Random | None = None, permit: Callable[[], None] | None = None):
    """call() with retries: never after a permanent failure, and not while the breaker refuses. Each attempt first waits for
    its permit, if there are such."""
    rng = rng or random.Random(0)
    for attempt in range(1, attempts + 1):
        if permit:
            permit()
        if not breaker.permits(clock()):
            raise VendorError("TRANSIENT", "the breaker is open")
        try:
            out = call()
        except VendorError as e:
            breaker.record(e.error_class == "TRANSIENT", clock())
            if e.error_class == "PERMANENT" or attempt == attempts:
                raise
            sleep(delay_ms(e, attempt, base_ms, rng) / 1000)
        else:
            breaker.record(False, clock())
            return out
    raise ValueError("at least one attempt is needed")


@dataclass
class Governor:
    """Every attempt of a call waits for a permit of its lane and goes through the breaker."""

    limiter: LaneLimiter
    breaker: Breaker
    clock: Callable[[], float]
    sleep: Callable[[float], None]
    attempts: int = MAX_ATTEMPTS
    base_ms: int = 100
    rng: random.Random = field(default_factory=lambda: random.Random(0))

    def acquire(self, lane: str) -> None:
        while not self.limiter.try_acquire(lane, now := self.clock()):
            self.sleep(int(now) + 1 - now)

    def execute(self, lane: str, call: Callable):
        return governed(call, self.breaker, self.clock, self.sleep, self.attempts, self.base_ms, self.rng, lambda: self.acquire(lane))


def for_lane(lane: str, tasks: int, rate: int = CALLS_A_SECOND, base_ms: int = 100) -> Callable[[], Callable]:
    """For enrich.call_vendor: each of so many tasks at a time gets its share of the calls a second, and its own breaker."""

    def make() -> Callable:
        import time

        own = Governor(LaneLimiter(max(1, rate // max(1, tasks))), Breaker(), time.time, time.sleep, base_ms=base_ms)
        return lambda call: own.execute(lane, call)

    return make


class LaneControl:
    """What a breaker's transitions do to the lanes: open pauses all of them, half-open and closed let them run. start has, for
    each lane, what starts its streaming query from its checkpoint; record gets BREAKER_OPEN and BREAKER_CLOSED."""

    def __init__(self, start: dict[str, Callable], record: Callable[[str], None]):
        self.start, self.record = start, record
        self.running = {lane: begin() for lane, begin in start.items()}

    def __call__(self, state: str) -> None:
        if state == "OPEN":
            for query in self.running.values():
                query.stop()
            self.running = {}
            self.record("BREAKER_OPEN")
            return
        for lane in self.start.keys() - self.running.keys():
            self.running[lane] = self.start[lane]()
        if state == "CLOSED":
            self.record("BREAKER_CLOSED")


def limited(calls: DataFrame, rate: int = CALLS_A_SECOND, cdc_share: int = CDC_SHARE) -> DataFrame:
    """calls (id, lane, at): which of them LaneLimiter lets through, (id, lane, second, granted), calls of a second in order of
    (at, id). A refused lane costs the pool nothing, so a backfill call beyond its lane's share stands in nobody's way."""
    second = F.floor(F.unix_micros("at") / 1_000_000).alias("second")
    rows = calls.select("id", "lane", F.unix_micros("at").alias("t"), second)
    order = [F.col("t"), F.col("id")]
    own = F.row_number().over(Window.partitionBy("second", "lane").orderBy(*order))
    rows = rows.withColumn("fits", own <= F.when(F.col("lane") == "backfill", rate * (100 - cdc_share) // 100).otherwise(rate))
    shared = F.sum(F.col("fits").cast("int")).over(Window.partitionBy("second").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("granted", F.col("fits") & (shared <= rate)).select("id", "lane", "second", "granted")


def broken(calls: DataFrame) -> DataFrame:
    """calls (vendor, id, at, transient): what each vendor's breaker makes of its calls in order of (at, id): (vendor, id,
    permitted, state after the call). A vendor's calls are one sequence, so each is one task's."""

    def fold(frame):
        import pandas as pd

        breaker, out = Breaker(), []
        frame = frame.sort_values(["t", "id"])
        for vendor, i, t, transient in zip(frame["vendor"], frame["id"], frame["t"], frame["transient"], strict=True):
            now = t / 1e6
            permitted = breaker.permits(now)
            if permitted:
                breaker.record(bool(transient), now)
            out.append((vendor, i, permitted, breaker.state))
        return pd.DataFrame(out, columns=["vendor", "id", "permitted", "state"])

    rows = calls.select("vendor", "id", F.unix_micros("at").alias("t"), "transient")
    return rows.groupBy("vendor").applyInPandas(fold, "vendor long, id long, permitted boolean, state string")
