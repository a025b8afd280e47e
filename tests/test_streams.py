from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillgraph.operators import locks
from quillgraph.streaming import streams

T0 = datetime(2026, 1, 1)


def test_streams_match_batch(spark, tmp_path):
    rows = [(i, f"d{i % 3}", f"a{i % 2}", T0 + timedelta(seconds=97 * i)) for i in range(60)] + [(5, "d2", "a1", T0 + timedelta(seconds=485)), (99, "d0", "a0", None)]
    df = spark.createDataFrame(rows, "id long, document_path string, agent_id string, created_at timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    read = lambda: streams.stream_table(spark, str(tmp_path / "in"), df)
    notes = streams.run_to_end(streams.recent_notifications(read()), "notes")
    assert sorted(r["id"] for r in notes.collect()) == list(range(60))
    got = streams.run_to_end(streams.leases(read(), "document_path", "agent_id", "created_at", 300), "leases")
    asked = df.select(F.col("document_path").alias("document"), F.col("agent_id").alias("agent"), F.col("created_at").alias("at"), F.lit("acquire").alias("action"), F.lit(300).alias("ttl"), F.lit(False).alias("force"))
    want = locks.replay(asked).select(F.col("document").alias("document_path"), F.col("agent").alias("agent_id"), F.col("at").alias("created_at"), "outcome")
    key = lambda d: sorted((r["document_path"], r["created_at"], r["agent_id"], r["outcome"]) for r in d.collect())
    assert key(got) == key(want)
    rates = streams.run_to_end(streams.failure_rates(read(), "created_at", F.col("agent_id") == "a0"), "rates")
    assert all(0 <= r["failures"] <= r["calls"] for r in rates.collect()) and rates.count() > 0
    sessions = streams.run_to_end(streams.agent_sessions(read(), "agent_id", "created_at"), "sessions", "append")
    assert sessions.columns == ["agent_id", "started", "ended", "beats"]
