"""Token-bucket verdicts over an access log, as a batch job and as a stream.

A bucket refills continuously, ``limit`` tokens per window. A take with less
than one token locks the caller out until one whole token exists; takes inside a
lockout change nothing. A give returns one token and lifts a lockout.

The rule is sequential per caller, so the batch job separates what is: events
are first counted into one short row per caller and second, spread by both, and
only those rows are walked in order, with three numbers of state. A take after a
window without any call finds a full bucket and no lockout, so a caller's rows are
cut there and the pieces walked apart. A busy caller therefore costs one small row
per second it is active, however many requests it makes, and every single verdict
is derived in parallel afterwards, each event taking the last change before it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# Tokens and refill window per tier.
TIERS = {
    "anon": (30, HOUR_MS),
    "keyed": (200, HOUR_MS),
    "lookup": (120, HOUR_MS),
    "mint": (2, DAY_MS),
}
# End of fixed values.

Tiers = Mapping[str, tuple[int, int]]
SLOT_MS = 1000
CALLER = ["caller", "tier"]


def _arrive(state, now, takes, give, limit, window):
    """Advance ``state`` [tokens, refilled_at, locked_until] by one arrival: an
    optional give, then ``takes`` simultaneous takes.

    Returns (tokens after the give, tokens before the takes, takes served), or
    None when the arrival changed nothing.
    """
    full = float(limit)  # stored as a double, so never an int
    state[0] = min(state[0], full)
    given = None
    if give:
        state[0] = min(full, state[0] + 1)
        state[2] = 0
        given = state[0]
    if not takes or state[2] > now:
        return (given, state[0], 0) if give else None
    elapsed = now - state[1]
    if elapsed > 0:
        state[0] = min(full, state[0] + (elapsed * limit) / window)
        state[1] = now
    before = state[0]
    served = min(takes, math.floor(before))
    state[0] = before - served
    if served < takes:
        wait = math.ceil(((1 - state[0]) * window) / limit) if limit > 0 else window
        state[2] = now + wait
    return given, before, served


def _tier_column(tier: Column, tiers: Tiers, field: int) -> Column:
    """A tier's limit or window; a tier nobody declared fails the job."""
    table = F.create_map(*[F.lit(x) for t, v in tiers.items() for x in (t, int(v[field]))])
    missing = F.raise_error(F.concat(F.lit("unknown tier: "), F.coalesce(tier, F.lit("NULL"))))
    return F.coalesce(table[tier], missing)


def _verdict(ok, remaining, locked, now, limit, window) -> list[Column]:
    whole = F.greatest(F.lit(0), F.floor(remaining)).cast("int")
    # A closed tier never hands out a token, so it has no next one either.
    next_token = F.when(limit > 0, now + window / limit)
    until = F.when(ok, next_token).otherwise(locked)
    wait = F.greatest(F.lit(0), F.when(ok, F.lit(0)).otherwise(locked - now))
    return [
        ok.alias("ok"),
        limit.cast("int").alias("limit"),
        whole.alias("remaining"),
        F.floor(until / 1000).cast("long").alias("reset_at"),
        F.ceil(wait / 1000).cast("long").alias("retry_after"),
    ]


# --- batch -------------------------------------------------------------------

_WALK_SCHEMA = (
    "caller string, tier string, slot long, r_ms array<long>, r_seq array<long>, "
    "r_given array<double>, r_before array<double>, r_served array<long>, "
    "r_tokens array<double>, r_locked array<long>"
)


def _walk(tiers: Tiers):
    """Walk slots in (caller, tier, slot) order, keeping one caller's state."""
    limits = {t: (int(n), int(w)) for t, (n, w) in tiers.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for batch in batches:
            out = []
            for caller, tier, piece, slot, ms, seq, takes, gives in batch.itertuples(index=False):
                limit, window = limits[tier]
                if who != (caller, tier, piece):
                    who, state = (caller, tier, piece), [float(limit), int(ms[0]), 0]
                # The state the slot starts with answers takes inside a lockout.
                records = [(-1, 0, None, state[0], 0, state[0], state[2])]
                if state[2] <= ms[-1] or any(gives):
                    for now, s, n, g in zip(ms, seq, takes, gives):
                        change = _arrive(state, int(now), int(n), bool(g), limit, window)
                        if change:
                            records.append((int(now), int(s), *change, state[0], state[2]))
                out.append((caller, tier, slot, *map(list, zip(*records))))
            yield pd.DataFrame(
                out,
                columns=["caller", "tier", "slot", "r_ms", "r_seq", "r_given", "r_before",
                         "r_served", "r_tokens", "r_locked"],
            )

    return run


def throttle_verdicts(events: DataFrame, tiers: Tiers = TIERS) -> DataFrame:
    """Verdicts for events (event_id, caller, tier, ts, op), op ``take``/``give``.

    Events of one caller count in (ts to the millisecond, event_id) order.
    """
    c = F.col
    limit = _tier_column(c("tier"), tiers, 0)
    log = events.select(
        "event_id", "caller", "tier", F.unix_millis(c("ts")).alias("ms"),
        (c("op") == "give").alias("give"),
    ).withColumn("slot", F.floor(c("ms") / SLOT_MS).cast("long"))

    # One shuffle by (caller, second) serves the ordering, the counting and the
    # join back.
    placed = log.repartition(*CALLER, "slot")
    instant = Window.partitionBy(*CALLER, "slot", "ms").orderBy("event_id")
    placed = placed.withColumn(
        "seq", F.sum(c("give").cast("long")).over(
            instant.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    turn = Window.partitionBy(*CALLER, "slot", "ms", "seq").orderBy("give", "event_id")
    placed = placed.withColumn(
        "turn", F.sum((~c("give")).cast("long")).over(
            turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )

    arrivals = placed.groupBy(*CALLER, "slot", "ms", "seq").agg(
        F.count_if(~c("give")).alias("takes"), F.max("give").alias("gives")
    )
    # More takes in one instant than the bucket can hold all end the same way.
    capped = F.least(c("takes"), limit.cast("long") + 1)
    slots = arrivals.groupBy(*CALLER, "slot").agg(
        F.array_sort(F.collect_list(F.struct("ms", "seq", capped.alias("takes"), "gives")))
        .alias("a")
    )
    inorder = Window.partitionBy(*CALLER).orderBy("slot")
    first, last = F.element_at("a", 1), F.element_at("a", -1)
    idle = first["ms"] - F.lag(last["ms"]).over(inorder) >= _tier_column(c("tier"), tiers, 1)
    slots = slots.withColumn("fresh", (idle & ~first["gives"]).cast("long"))
    slots = slots.withColumn("piece", F.sum(F.coalesce("fresh", F.lit(0))).over(
        inorder.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    slots = slots.select(*CALLER, "piece", "slot", *[
        c("a").getField(f).alias(f) for f in ("ms", "seq", "takes", "gives")
    ])
    walked = (
        slots.repartition(*CALLER, "piece").sortWithinPartitions(*CALLER, "piece", "slot")
        .mapInPandas(_walk(tiers), _WALK_SCHEMA)
    )

    fields = ("ms", "seq", "given", "before", "served", "tokens", "locked")
    records = walked.select(
        *CALLER, "slot",
        F.explode(F.arrays_zip(*[c(f"r_{f}").alias(f) for f in fields])).alias("r"),
    ).select(*CALLER, "slot", c("r.ms").alias("ms"), c("r.seq").alias("seq"), "r")
    # A change stands before the events of its instant, and each event sees the last one.
    upto = Window.partitionBy(*CALLER, "slot").orderBy("ms", "seq", c("event").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = placed.withColumn("event", F.lit(True)).unionByName(records, allowMissingColumns=True).withColumn(
        "r", F.last("r", ignorenulls=True).over(upto)).filter("event")
    r = {f: c("r")[f] for f in fields}
    own = (r["ms"] == c("ms")) & (r["seq"] == c("seq"))
    served = own & (c("turn") <= r["served"])
    ok = c("give") | served
    remaining = (
        F.when(c("give"), r["given"]).when(served, r["before"] - c("turn")).otherwise(r["tokens"])
    )
    window = _tier_column(c("tier"), tiers, 1)
    return joined.select(
        "event_id", *CALLER, c("ms"), F.when(c("give"), "give").otherwise("take").alias("op"),
        *_verdict(ok, remaining, r["locked"], c("ms"), limit, window),
    )


# --- stream ------------------------------------------------------------------

_STEP_SCHEMA = (
    "event_id long, caller string, tier string, ms long, op string, ok boolean, "
    "tokens double, locked long"
)
_STATE_SCHEMA = "tokens double, refilled long, locked long, last long, timer boolean"
#: Rows that a caller's answers leave in at a time, and the store that timers need.
ANSWERS = 10_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bucket(StatefulProcessor):
    """One caller's bucket. It is kept while it may not be full.

    A bucket without a call for a window is full again and its lockout is over, so it
    need not be kept: a timer is set a window behind a call, and when the watermark
    passes it the bucket goes, or the timer is set again behind the last call since.
    """

    def __init__(self, tiers: Tiers):
        self.limits = {t: (int(n), int(w)) for t, (n, w) in tiers.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        caller, tier = key
        limit, window = self.limits[tier]
        # Seventeen bytes a call; a micro-batch comes in no order.
        parts = [(r["ms"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64), r["give"].to_numpy(bool)) for r in rows]
        ms, event_id, give = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((event_id, ms))
        stored = self.bucket.get() if self.bucket.exists() else (float(limit), int(ms[order[0]]), 0, int(ms[order[0]]), False)
        state, last, timer = list(stored[:3]), max(int(stored[3]), int(ms[order[-1]])), bool(stored[4])
        for start in range(0, len(order), ANSWERS):
            out = []
            for k in order[start : start + ANSWERS].tolist():
                now, gives = int(ms[k]), bool(give[k])
                change = _arrive(state, now, int(not gives), gives, limit, window)
                ok = gives or (change is not None and change[2] == 1)
                out.append((int(event_id[k]), caller, tier, now, "give" if gives else "take", ok, state[0], state[2]))
            yield pd.DataFrame(out, columns=["event_id", "caller", "tier", "ms", "op", "ok", "tokens", "locked"])
        if not timer:
            self.handle.registerTimer(last + window)
        self.bucket.update((*state, last, True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, window = self.limits[key[1]]
        if self.bucket.exists():
            *state, last, _ = self.bucket.get()
            if last + window > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(last + window)
            else:
                self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, tiers: Tiers = TIERS, delay: str = "1 minute") -> DataFrame:
    """The same verdicts over a stream, state kept per (caller, tier) until it is idle for a window.

    Within a micro-batch events of a caller count in time order; an event older than the
    state refills nothing. Events may be late by ``delay`` before buckets are given up
    that they belong to; later ones are answered too, by a full bucket if theirs is gone.
    A give to a bucket that is gone finds it full. Bound the micro-batch at the source
    (``maxFilesPerTrigger`` and the like): it bounds the calls held per caller.
    """
    c = F.col
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    limit = _tier_column(c("tier"), tiers, 0)
    window = _tier_column(c("tier"), tiers, 1)
    # Timers follow the watermark; the log goes on without its time stamp, so that no late event is dropped.
    log = events.withWatermark("ts", delay).select(
        "event_id", "caller", "tier", F.unix_millis(c("ts")).alias("ms"),
        F.coalesce(c("op") == "give", F.lit(False)).alias("give"),
    ).filter(limit.isNotNull())
    stepped = log.groupBy(*CALLER).transformWithStateInPandas(
        Bucket(tiers), _STEP_SCHEMA, "Append", "EventTime")
    return stepped.select(
        "event_id", *CALLER, "ms", "op",
        *_verdict(c("ok"), c("tokens"), c("locked"), c("ms"), limit, window),
    )


# The functions above run in Python workers, where this package may not be
# installed; ship their code with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
