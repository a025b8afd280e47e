"""Processing only new or changed records: the target is the state.

A target holds, for each record it was built from, the record's key and version.  What is still to do is the source
anti-joined with the target on (key, version): a record that is new, or whose version differs, is left over.  Nothing
else is remembered, so a run that breaks off before publishing has changed nothing and its records are simply left over
again, and a record that was published is never left over twice.

``Target`` publishes a version of the target by writing a segment and then a small commit file under another name, which is
renamed to the run's number; a reader sees all of a run or none of it.  The file system has to rename atomically and refuse
a name that is taken (HDFS and its like; not plain object stores).  ``compact`` writes the current rows as one segment that
stands for all runs before, so the number of segments that are read stays small; ``vacuum`` removes what no run names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_hash(c: Column | str) -> Column:
    """A hash in its plain form: no prefix that names the hash, no blanks around it, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, r"(?U)^\s*(?:[A-Za-z][A-Za-z0-9_/-]*\s*:)?\s*|\s+$", "")
    return F.lower(bare)


def text_hash(c: Column | str) -> Column:
    """SHA-256 of the UTF-8 text in hex; a null text counts as the empty one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def pending(source: DataFrame, target: DataFrame, key: str, version: str) -> DataFrame:
    """The source rows whose (key, version) the target does not hold; a null key or version is never held.

    Extra columns of either side do not matter; only the two columns of the target are read.
    """
    held = target.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    return source.join(held, (source[key] == held["_k"]) & (source[version] == held["_v"]), "left_anti")


def runs_as_intervals(runs: DataFrame) -> DataFrame:
    """(since, until, ok): from each start of a run to the next start, and whether a row of that run says success.

    Rows of one run are combined; where two runs start at the same time the one with the larger id counts.  A run
    without a start is left out.  The log of runs is small by nature (one row a run).
    """
    one = runs.where(F.col("started_at").isNotNull()).groupBy("run_id").agg(
        F.min("started_at").alias("since"), F.max(F.coalesce(F.lower(F.trim("status")) == "success", F.lit(False))).alias("ok")
    )
    one = one.groupBy("since").agg(F.max_by("ok", F.coalesce(F.col("run_id"), F.lit(-1))).alias("ok"))
    from pyspark.sql import Window

    return one.select("since", F.lead("since").over(Window.orderBy("since")).alias("until"), "ok")


def with_run(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents that lie in a run's interval, with its ``since`` and ``ok``; the join is on days, as in ``indexed_by_success``."""
    last = F.coalesce(spans.agg(F.max(F.to_date("since"))).scalar(), F.lit("1970-01-01").cast("date"))
    days = spans.select("since", "until", "ok", F.explode(F.sequence(F.to_date("since"), F.to_date(F.coalesce("until", "since")))).alias("day"))
    d = documents.withColumn("_day", F.least(F.to_date("indexed_at"), last))
    inside = (F.col("_day") == F.col("day")) & (F.col("indexed_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("indexed_at") < F.col("until")))
    return d.join(days, inside).drop("_day", "day", "until")


def indexed_by_success(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """The documents whose ``indexed_at`` lies in a successful run: that of the latest start not after it.

    An equi-join on days: an interval has a row for each day it touches, a document one day (days after the last start
    count as the last), so each document meets the intervals of one day and no join compares all pairs.
    """
    spans = runs_as_intervals(runs)
    last = F.coalesce(spans.agg(F.max(F.to_date("since"))).scalar(), F.lit("1970-01-01").cast("date"))
    days = spans.select("since", "until", "ok", F.explode(F.sequence(F.to_date("since"), F.to_date(F.coalesce("until", "since")))).alias("day"))
    d = documents.withColumn("_day", F.least(F.to_date("indexed_at"), last))
    inside = (F.col("_day") == F.col("day")) & (F.col("indexed_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("indexed_at") < F.col("until")))
    return d.join(days.where("ok"), inside, "left_semi").drop("_day")


def documents_to_process(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """The documents whose present text no successful run has indexed.

    The target's (key, version) rows are those that the successful runs left in ``documents``: the id and the hash as
    of the last indexing, for rows with an ``indexed_at`` in a successful run.
    """
    target = indexed_by_success(documents.where(F.col("indexed_at").isNotNull()), runs).select("doc_id", F.unhex(normal_hash("content_hash")).alias("version"))
    source = documents.select("doc_id", F.unhex(text_hash("text")).alias("version"))
    return pending(source, target.where(F.col("version").isNotNull()), "doc_id", "version")


class Target:
    """A published target: segments under ``path`` and one commit file a run."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self) -> list[tuple[int, str]]:
        """(number, content) of every commit file, in order.  A name that is no number is a commit that was not finished."""
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        found = []
        for s in self._fs.listStatus(log):
            if s.getPath().getName().isdigit():
                with_name = self._fs.open(s.getPath())
                found.append((int(s.getPath().getName()), bytes(with_name.readAllBytes()).decode()))
                with_name.close()
        return sorted(found)

    def commits(self) -> list[tuple[int, str]]:
        """(number, segment) of the published runs that are to be read, in order: the last compaction and the runs since."""
        log = self._log()
        start = max((i for i, (_, content) in enumerate(log) if content.startswith(_BASE)), default=0)
        return [(n, content.removeprefix(_BASE)) for n, content in log[start:]]

    def segments(self) -> DataFrame | None:
        """All published rows, with the number of the run that published them as ``_commit``."""
        parts = [self.spark.read.parquet(f"{self.path}/{s}").withColumn("_commit", F.lit(n)) for n, s in self.commits()]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def state(self) -> DataFrame | None:
        """(key, version) as of the last run that published each key."""
        rows = self.segments()
        if rows is None:
            return None
        return rows.groupBy(self.key).agg(F.max_by(self.version, "_commit").alias(self.version))

    def rows(self) -> DataFrame | None:
        """The current rows: of each key, those of the last run that published it."""
        rows = self.segments()
        if rows is None:
            return None
        latest = rows.groupBy(F.col(self.key).alias("_k")).agg(F.max("_commit").alias("_c"))
        return rows.join(latest, (rows[self.key] == latest["_k"]) & (rows["_commit"] == latest["_c"]), "left_semi").drop("_commit")

    def pending(self, source: DataFrame) -> DataFrame:
        state = self.state()
        return source if state is None else pending(source, state, self.key, self.version)

    def publish(self, output: DataFrame) -> int:
        """Write ``output`` (it must carry key and version) and commit it; returns the run's number.

        Fails without effect if another writer has committed the same number first, and a run that breaks off anywhere
        before the rename has published nothing.
        """
        log = self._log()
        number, segment = (log[-1][0] + 1 if log else 1), f"seg-{uuid.uuid4().hex}"
        output.write.parquet(f"{self.path}/{segment}")
        self._commit(number, segment)
        return number

    def _commit(self, number: int, content: str) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/_log"))
        draft = self._path(f"{self.path}/_log/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        never_replace = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"{self.path}/_log/{number}")), never_replace)

    def compact(self) -> int | None:
        """Write the current rows as one segment that stands for all runs so far; returns its number, or None if there is nothing to bring together."""
        commits, rows = self.commits(), self.rows()
        if rows is None or len(commits) < 2:
            return None
        number, segment = commits[-1][0] + 1, f"seg-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{segment}")
        self._commit(number, _BASE + segment)
        return number

    def vacuum(self, older_than_seconds: float = 86_400) -> list[str]:
        """Remove the segments and drafts that no run names and that are older than any run may take; returns their names."""
        import time

        live, before = {s for _, s in self.commits()}, (time.time() - older_than_seconds) * 1000
        gone = []
        for folder, prefix in ((self.path, "seg-"), (f"{self.path}/_log", "draft-")):
            for s in self._fs.listStatus(self._path(folder)) if self._fs.exists(self._path(folder)) else []:
                name = s.getPath().getName()
                if name.startswith(prefix) and name not in live and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone


#: What the commit file of a compaction begins with.
_BASE = "base:"
