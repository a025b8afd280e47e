"""Document locks replayed from a log of requests: grants, refusals, theft, release, expiry and the conflicts they leave.

A request is (document, agent, at, action, ttl, force): action is acquire, refresh or release.  Whether a lock has expired
depends on the last grant before, so each document's requests pass by in order of time; only the present lock is held.

Defined results: requests without document, agent or time are left out; at one time they go by agent; a null ttl is
DEFAULT_TTL seconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TTL = 300


class _Lock:
    """The lock of one document."""

    def __init__(self) -> None:
        self.owner, self.at, self.ttl = None, None, DEFAULT_TTL

    def ask(self, agent: str, at, action: str, ttl: int | None, force: bool | None) -> tuple[str, str | None]:  # noqa: ANN001
        """(outcome, who held it before)."""
        before = self.owner
        expired = before is not None and at > self.at + timedelta(seconds=self.ttl)
        if action == "release":
            if before != agent:
                return "not_held", before
            self.owner = None
            return "released", before
        if before is None:
            outcome = "acquired" if action == "acquire" else "not_held"
        elif before == agent:
            outcome = "refreshed"
        elif expired:
            outcome = "reclaimed" if action == "acquire" else "not_held"
        else:
            outcome = "refused" if action == "refresh" or not force else "stolen"
        if outcome not in ("refused", "not_held"):
            self.owner, self.at, self.ttl = agent, at, DEFAULT_TTL if ttl is None else ttl
        return outcome, before


def replay(log: DataFrame) -> DataFrame:
    """(document, agent, at, action, ttl, outcome, held_by): each request with its outcome and who held the lock before."""
    cols = ["document", "agent", "at", "action", "ttl", "force"]
    ordered = log.where(F.col("document").isNotNull() & F.col("agent").isNotNull() & F.col("at").isNotNull()).select(*cols).repartition("document").sortWithinPartitions("document", "at", "agent", "action")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lock = None, _Lock()
        for b in batches:
            out = []
            for document, *request in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if document != now:
                    now, lock = document, _Lock()
                out.append(lock.ask(*request))
            outcome, before = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(outcome, pa.string()), pa.array(before, pa.string())], [*cols[:5], "outcome", "held_by"])

    kinds = dict(log.dtypes)
    return ordered.mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in cols[:5]) + ", outcome string, held_by string")


def conflicts(replayed: DataFrame) -> DataFrame:
    """(document, agent_a, agent_b, at, conflict_type, resolution): a row a lock that was stolen by force."""
    return replayed.where("outcome = 'stolen'").select("document", F.col("held_by").alias("agent_a"), F.col("agent").alias("agent_b"), "at", F.lit("lock_stolen").alias("conflict_type"), F.lit("force_overwritten").alias("resolution"))


def conflicts_of(rows: DataFrame, document: str | Column | None = None, agent: str | Column | None = None) -> DataFrame:
    """Conflicts about a document, and with an agent on either side."""
    out = rows if document is None else rows.where(F.col("document") == document)
    return out if agent is None else out.where((F.col("agent_a") == agent) | (F.col("agent_b") == agent))


def states(replayed: DataFrame, now: Column) -> DataFrame:
    """(document, agent, at, state): the last grant of each document that was not released since, locked or expired."""
    last = replayed.where(~F.col("outcome").isin("refused", "not_held")).groupBy("document").agg(F.max_by(F.struct("agent", "at", "ttl", "outcome"), F.struct("at", "agent", "action")).alias("l"))
    held = last.where("l.outcome != 'released'")
    over = F.unix_timestamp(now) - F.unix_timestamp("l.at") > F.coalesce("l.ttl", F.lit(DEFAULT_TTL))
    return held.select("document", "l.agent", "l.at", F.when(over, "expired").otherwise("locked").alias("state"))


def reaped(lock_states: DataFrame) -> DataFrame:
    """The locks that are left once expired ones are reaped."""
    return lock_states.where("state = 'locked'")


def released_by(lock_states: DataFrame, agent: str | Column) -> DataFrame:
    """The locks that are left once an agent's are released."""
    return lock_states.where(F.col("agent") != agent)


def lock_stats(lock_states: DataFrame, conflict_rows: DataFrame) -> DataFrame:
    """One row: locked, expired, active_agents, conflicts, last_conflict."""
    s = lock_states.agg(F.count_if(F.col("state") == "locked").alias("locked"), F.count_if(F.col("state") == "expired").alias("expired"), F.count_distinct(F.when(F.col("state") == "locked", F.col("agent"))).alias("active_agents"))
    c = conflict_rows.agg(F.count("*").alias("conflicts"), F.max("at").alias("last_conflict"))
    return s.withColumn("_j", F.lit(1)).join(c.withColumn("_j", F.lit(1)), "_j").drop("_j")
