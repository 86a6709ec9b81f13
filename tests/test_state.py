"""Keyed stream state over several micro-batches: late, repeated and unordered events give the log of the ordered events; a stopped run goes on where it ended."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.streaming.state import run_to_table, settle, settled_changes

DAY = 86_400_000_000
START = 1_700_000_000_000_000
SCHEMA = "user long, event long, at timestamp, price long, status string"
TERMINAL = {"status": ["sold"]}


def events(seed, n=300):
    """(user, event, microseconds, price, status) over ten days."""
    rng = random.Random(seed)
    return [(rng.randrange(6), i, START + rng.randrange(10 * DAY), rng.choice([None, 1, 2]), rng.choice([None, "on", "off", "sold"])) for i in range(n)]


def plain(rows, watermark, timeout):
    """The log of all events before the watermark, by going through each key's events in order."""
    out = []
    for user in {r[0] for r in rows}:
        own = sorted({(r[2], r[1], r[3], r[4]) for r in rows if r[0] == user and r[2] // 1000 < watermark})
        price = status = seen = None
        for i, (at, event, p, s) in enumerate(own):
            gap = seen is not None and at - seen > timeout and status != "sold"
            if gap:
                out.append((user, None, seen + timeout, "disappeared", price, status))
            new = (p is not None and p != price) or (s is not None and s != status)
            price, status = price if p is None else p, status if s is None else s
            if i == 0 or gap or new:
                out.append((user, event, at, "first" if i == 0 else "returned" if gap else "changed", price, status))
            seen = at
        if own and watermark * 1000 - seen > timeout and status != "sold":
            out.append((user, None, seen + timeout, "disappeared", price, status))
    return sorted(out, key=str)


def write(spark, rows, path):
    df = spark.createDataFrame([(u, e, m, p, s) for u, e, m, p, s in rows], "user long, event long, m long, price long, status string")
    df.select("user", "event", F.timestamp_micros("m").alias("at"), "price", "status").coalesce(1).write.mode("append").parquet(path)


def run(spark, base):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = run_to_table(settled_changes(stream, "user", "event", "at", ["price", "status"], "3 days", 0.4, TERMINAL), f"{base}/out", f"{base}/checkpoint")
    return sorted(((r.user, r.event, r.m, r.kind, r.price, r.status) for r in out.withColumn("m", F.unix_micros("at")).collect()), key=str)


@pytest.mark.parametrize("stop", [1, 3])
def test_late_and_repeated_events_fall_into_place(spark, tmp_path, stop):
    """Events arrive up to two days late and some twice; the run is stopped after some files and goes on later."""
    rows = events(stop)
    rng = random.Random(9)
    arriving = sorted(rows, key=lambda r: r[2] + rng.randrange(2 * DAY))
    parts = [arriving[k : k + 60] for k in range(0, len(arriving), 60)]
    parts = [p + rng.sample(p, 5) for p in parts]
    base = str(tmp_path)
    for p in parts[:stop]:
        write(spark, p, f"{base}/in")
    first = run(spark, base)
    for p in parts[stop:]:
        write(spark, p, f"{base}/in")
    got = run(spark, base)
    assert set(map(str, first)) <= set(map(str, got)) and run(spark, base) == got  # rows stay, and a third run adds none
    watermark = max(r[2] for r in rows) // 1000 - 3 * DAY // 1000
    assert got == plain(rows, watermark, int(0.4 * DAY)) and {r[3] for r in got} == {"first", "changed", "disappeared", "returned"}


def test_settling_in_steps_is_settling_at_once():
    rows = [r for r in events(4) if r[0] == 1]
    state, steps = {"values": {}, "pending": {f"{r[2]}|{r[1]}": [r[3], r[4]] for r in rows}}, []
    for w in range(START, START + 12 * DAY, DAY // 3):
        steps += settle(state, w // 1000, ["price", "status"], DAY, TERMINAL)
    assert not state["pending"] and sorted(((1, e, at, k, v.get("price"), v.get("status")) for at, e, k, v in steps), key=str) == plain(rows, (START + 12 * DAY - DAY // 3) // 1000, DAY)
