"""Token-bucket rules against a plain restatement; batch equals stream."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException

from docketlake.streaming.throttle import DAY_MS, HOUR_MS, TIERS, throttle_stream, throttle_verdicts

START = datetime(2027, 1, 15, 8, 0, tzinfo=timezone.utc)
T0 = int(START.timestamp() * 1000)
COLUMNS = ["event_id", "ok", "limit", "remaining", "reset_at", "retry_after"]


def events(spark, rows):
    """rows: (id, caller, tier, ms after start, op)"""
    made = [(i, c, t, START + timedelta(milliseconds=ms), op) for i, c, t, ms, op in rows]
    return spark.createDataFrame(made, "event_id long, caller string, tier string, ts timestamp, op string")


def verdicts(df):
    return {r["event_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in df.select(*COLUMNS).collect()}


def restated(rows, tiers=TIERS):
    out, buckets = {}, {}
    for i, caller, tier, ms, op in sorted(rows, key=lambda r: (r[3], r[0])):
        limit, window = tiers[tier]
        now = T0 + ms
        b = buckets.setdefault((caller, tier), {"n": float(limit), "at": now, "lock": 0})
        if op == "give":
            b["n"], b["lock"], ok = min(limit, b["n"] + 1), 0, True
        elif b["lock"] > now:
            ok = False
        else:
            if now > b["at"]:
                b["n"], b["at"] = min(limit, b["n"] + (now - b["at"]) * limit / window), now
            ok = b["n"] >= 1
            if ok:
                b["n"] -= 1
            else:
                b["lock"] = now + (math.ceil((1 - b["n"]) * window / limit) if limit else window)
        if ok:
            reset = math.floor((now + window / limit) / 1000) if limit else None
        else:
            reset = b["lock"] // 1000
        wait = 0 if ok else math.ceil(max(0, b["lock"] - now) / 1000)
        out[i] = (ok, limit, max(0, math.floor(b["n"])), reset, wait)
    return out


def mixed(seed=3, n=700):
    """Bursts, same-instant calls, gives in between, a dominating caller."""
    rng, rows, clock = random.Random(seed), [], 0
    for i in range(n):
        clock += rng.choice([0, 0, 0, 1, 40, 900, 61_000])
        caller = "hot" if rng.random() < 0.6 else f"c{rng.randrange(4)}"
        tier = rng.choice(["anon", "mint"])
        rows.append((i, caller, tier, clock, "give" if rng.random() < 0.1 else "take"))
    return rows


def test_limit_then_honest_wait(spark):
    limit, _ = TIERS["anon"]
    rows = [(i, "a", "anon", 0, "take") for i in range(limit + 1)]
    rows += [(100, "a", "anon", 35_000, "take"), (101, "a", "anon", 120_000, "take")]
    rows += [(200 + i, "k", "mint", i, "take") for i in range(3)]
    rows += [(300, "k", "mint", DAY_MS // 2 + 2, "take"), (301, "b", "keyed", 0, "take")]
    got = verdicts(throttle_verdicts(events(spark, rows)))
    assert all(got[i][0] for i in range(limit)) and not got[limit][0]
    assert got[limit][4] == 120 and got[100] == (False, 30, 0, got[limit][3], 85)
    assert got[101][0]
    assert [got[i][0] for i in (200, 201, 202, 300)] == [True, True, False, True]
    assert 43_190 <= got[202][4] <= 43_210 and got[301][1] == 200
    assert got == restated(rows)


def test_give_returns_one_token_and_never_overfills(spark):
    rows = [(i, "a", "mint", i, "take") for i in range(3)] + [(3, "a", "mint", 3, "give"),
            (4, "a", "mint", 4, "take"), (5, "a", "mint", 5, "take")]
    rows += [(10 + i, "full", "mint", i, "give") for i in range(5)] + [(20, "full", "mint", 9, "take")]
    got = verdicts(throttle_verdicts(events(spark, rows)))
    assert [got[i][0] for i in range(6)] == [True, True, False, True, True, False]
    assert got[3][2] == 1 and got[20][2] == 1
    assert got == restated(rows)


def test_closed_tier_and_unknown_tier(spark):
    closed = {"mint": (0, HOUR_MS)}
    rows = [(0, "a", "mint", 0, "take"), (1, "a", "mint", 1000, "take")]
    got = verdicts(throttle_verdicts(events(spark, rows), closed))
    assert got == restated(rows, closed) and got[0][4] == 3600
    with pytest.raises(PySparkException, match="unknown tier"):
        throttle_verdicts(events(spark, [(0, "a", "root", 0, "take")])).collect()


def test_random_logs_match_restatement(spark):
    rows = mixed()
    assert verdicts(throttle_verdicts(events(spark, rows))) == restated(rows)


def stream(spark, folder, parts, name):
    """Answers to parts of a log that arrive as one file each, and the buckets left in the state."""
    source, checkpoint = str(folder / "log"), str(folder / "checkpoint")
    for part in parts:
        events(spark, part).coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            throttle_stream(log).writeStream.format("parquet").option("path", str(folder / "out"))
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    left = spark.read.format("statestore").option("stateVarName", "bucket").load(checkpoint)
    return verdicts(spark.read.parquet(str(folder / "out"))), sorted(r["key"]["caller"] for r in left.collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = mixed(seed=9, n=400)
    got, left = stream(spark, tmp_path, (rows[:200], rows[200:]), "mixed")
    assert got == restated(rows) and "hot" in left


def test_stream_forgets_idle_buckets(spark, tmp_path):
    """Calls around a gap of a window: answers as if every bucket were kept, and only busy ones are."""
    limit, _ = TIERS["anon"]
    first = [(i, "a", "anon", i, "take") for i in range(limit + 3)] + [(90, "b", "anon", 5, "take")]
    busy = [(100 + i, "c", "anon", i * HOUR_MS // 2, "take") for i in range(4)]
    later = [(200, "d", "anon", 4 * HOUR_MS, "take")]
    back = [(300 + i, "a", "anon", 4 * HOUR_MS + 60_000 + i, "take") for i in range(3)]
    late = [(400, "b", "anon", HOUR_MS, "take")]  # far behind the watermark, and answered all the same
    parts = [first + busy[:1], busy[1:], later, [(201, "d", "anon", 4 * HOUR_MS + 1, "take")], back]
    got, left = stream(spark, tmp_path, parts, "idle")
    assert got == restated([r for p in parts for r in p])
    assert left == ["a", "d"]
    got, left = stream(spark, tmp_path, [late], "late")
    assert got[400][0] and left == ["a", "d"]  # answered, and given up by the timer at once


def test_pieces_after_idle_windows(spark):
    """Calls and gives after gaps of just below, at and above a window."""
    rng, rows, clock = random.Random(8), [], 0
    for i in range(400):
        clock += rng.choice([0, 0, 1, 500, HOUR_MS - 1, HOUR_MS, HOUR_MS + 1, DAY_MS])
        rows.append((i, "one", rng.choice(["anon", "mint"]), clock, "give" if rng.random() < 0.3 else "take"))
    assert verdicts(throttle_verdicts(events(spark, rows))) == restated(rows)


def test_a_crowded_second(spark):
    rows = [(i, "hot", "lookup", i % 1000, "give" if i % 5 == 0 else "take") for i in range(20_000)]
    assert verdicts(throttle_verdicts(events(spark, rows))) == restated(rows)
