"""Policies on streams give what the batch gives."""

from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from veil import PolicyError, anonymize
from veil.streaming import session_k_anonymity, shuffle_batches, windowed_k_anonymity


@pytest.fixture()
def events(spark, sf, tmp_path):
    """The events in four files, in the order of their time."""
    df = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    folder = tmp_path / "events"
    numbered = df.withColumn("part", F.ntile(4).over(Window.orderBy("ts"))).cache()
    for i in range(1, 5):
        numbered.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, tmp_path):
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start(str(tmp_path / "rows")))
    query.awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / "rows"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_row_methods(spark, settings, events, tmp_path):
    batch, stream = events
    policy = {"user_id": "hash", "value": "perturb", "event_type": {"method": "substitute", "options": {"list": ["a", "b"]}},
              "props": "remove", "ts": "generalize_date"}
    got = drain(anonymize(stream, policy, settings, ["event_id"]), tmp_path)
    assert rows(got) == rows(anonymize(batch, policy, settings, ["event_id"]))


def test_refusals(settings, events):
    _, stream = events
    for policy in ({"user_id": "k_anonymity"}, {"user_id": "shuffle"}):
        with pytest.raises(PolicyError):
            anonymize(stream, policy, settings, ["event_id"])
    with pytest.raises(PolicyError, match="row key"):
        anonymize(stream, {"value": "perturb"}, settings)


@pytest.mark.parametrize("spread", [1, 4])
def test_windowed_k_anonymity(spark, settings, events, tmp_path, spread):
    batch, stream = events
    batch, stream = [df.withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 7 > 0 THEN user_id END"))
                     for df in (batch, stream)]
    columns = ["event_id", "ts", "user_id"]
    got = drain(windowed_k_anonymity(stream.select(*columns), "ts", "1 day", "user_id", 3, ["event_id"],
                                     spread=spread), tmp_path)
    last = batch.agg(F.max(F.date_trunc("day", "ts"))).first()[0]
    want = windowed_k_anonymity(batch.select(*columns), "ts", "1 day", "user_id", 3, ["event_id"])
    closed = want.filter(F.col("ts") < F.lit(last))
    assert rows(got) == rows(closed)
    assert {"[SUPPRESSED]", "1", None} <= {r["user_id"] for r in got.collect()}


def test_late_rows_are_dropped(spark, settings, events, tmp_path):
    """A row of a closed window would be released with the wrong group size."""
    batch, stream = events
    folder = tmp_path / "in"
    first = batch.select("event_id", "ts", "user_id")
    late = first.orderBy("ts").limit(5).withColumn("event_id", F.col("event_id") + 10**6)
    first.coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(first.schema).parquet(str(folder))
    out = windowed_k_anonymity(stream, "ts", "1 day", "user_id", 2, ["event_id"])
    before = drain(out, tmp_path).count()
    late.coalesce(1).write.mode("append").parquet(str(folder))
    after = drain(out, tmp_path)
    assert after.count() == before and after.filter("event_id >= 1000000").isEmpty()


def test_shuffle_in_batches(spark, settings, events, tmp_path):
    batch, stream = events
    seen = []

    def sink(df, number):
        seen.append((number, df.collect()))

    query = (shuffle_batches(stream, ["user_id"], ["event_id"], settings, sink)
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert len(seen) == 4
    old = {r["event_id"]: r for r in batch.collect()}
    for _, part in seen:
        assert Counter(r["user_id"] for r in part) == Counter(old[r["event_id"]]["user_id"] for r in part)
        assert all(r["value"] == old[r["event_id"]]["value"] for r in part)
    assert sum(len(part) for _, part in seen) == len(old)


@pytest.mark.parametrize("spread", [1, 4])
def test_session_k_anonymity(spark, events, tmp_path, spread):
    """Batch and stream agree on closed sessions, with a hot value, nulls and rows without a time."""
    batch, stream = [df.select("event_id", F.expr("CASE WHEN event_id % 11 > 0 THEN ts END").alias("ts"), F.expr(
        "CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 7 > 0 THEN user_id END").alias("user_id")) for df in events]
    options = {"time": "ts", "gap": "90 minutes", "column": "user_id", "k": 3, "row_key": ["event_id"],
               "longest": "12 hours", "spread": spread}
    got = {r["event_id"]: r["user_id"] for r in drain(session_k_anonymity(stream, **options), tmp_path).collect()}
    want = {r["event_id"]: r["user_id"] for r in session_k_anonymity(batch, **options).collect()}
    assert len(want) == batch.count()
    sessions, runs = {}, []
    for r in sorted(batch.filter("ts IS NOT NULL").collect(), key=lambda r: r["ts"]):
        stretch = int(r["ts"].timestamp() // 43200)
        known = sessions.get(r["user_id"])
        if not known or known[-1]["stretch"] != stretch or (r["ts"] - known[-1]["last"]).total_seconds() > 5400:
            known = sessions.setdefault(r["user_id"], [])
            known.append({"stretch": stretch, "ids": []})
            runs.append(known[-1])
        known[-1]["last"] = r["ts"]
        known[-1]["ids"].append((r["event_id"], r["user_id"]))
    newest = max(run["last"] for run in runs)
    brute, closed = {}, set()
    for run in runs:
        for number, user in run["ids"]:
            brute[number] = None if user is None else str(user) if len(run["ids"]) >= 3 else "[SUPPRESSED]"
            if (newest - run["last"]).total_seconds() >= 5401:
                closed.add(number)
    timed = {k: v for k, v in want.items() if k in brute}
    assert timed == brute and {"[SUPPRESSED]", "1", None} <= set(brute.values())
    assert {v for k, v in want.items() if k not in brute} <= {"[SUPPRESSED]", None}
    assert closed <= set(got) and all(got[k] == want[k] for k in got)
    assert len(set(brute) & set(got)) <= len(closed) + 10


def test_sessions_refuse_bad_requests(events):
    batch, _ = events
    with pytest.raises(PolicyError, match="longer"):
        session_k_anonymity(batch, "ts", "2 days", "user_id", 2, ["event_id"])
    with pytest.raises(PolicyError, match="no such columns"):
        session_k_anonymity(batch, "when", "1 hour", "user_id", 2, ["event_id"])
