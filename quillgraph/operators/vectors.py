"""Exact vector search and the hybrid ranker.

Similarity is the cosine, 0 where a norm is 0.  Vectors that are null, hold a null or a NaN, or differ in length from
the query are similar to none.  Ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIER2_BOOST = 1.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None)).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def usable(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def effective(own: Column, given: Column) -> Column:
    """An agent's vector where there is one, else the record's own."""
    return F.coalesce(given, own)


def binary_signature(content: Column) -> Column:
    """128 numbers for content that is no text: the signs of its SHA-256 in hex by their codes, then zeros."""
    signs = F.transform(F.split(F.sha2(content, 256), ""), lambda c: F.ascii(c) / 255.0)
    return F.concat(F.filter(signs, lambda x: x > 0), F.array_repeat(F.lit(0.0), 64))


def with_given(own: DataFrame, given: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, v, by_agent): the vectors in effect: a given one, brought to length 1, before the chunk's own.

    Both are (chunk_id, v).  A given vector that is not usable or zero, or of an unknown chunk, is not taken (``refused``).
    """
    g = given.where(usable(F.col("v"), dim)).select("chunk_id", F.col("v").alias("_g")).where(dot(F.col("_g"), F.col("_g")) > 0).dropDuplicates(["chunk_id"])
    met = own.select("chunk_id", "v").join(g.select("chunk_id", unit(F.col("_g")).alias("_g")), "chunk_id", "left")
    rows = met.select("chunk_id", effective(F.col("v").cast("array<double>"), F.col("_g")).alias("v"), F.col("_g").isNotNull().alias("by_agent"))
    return rows.where(F.col("v").isNotNull())


def refused(own: DataFrame, given: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, reason) of the given vectors that are not taken."""
    met = given.join(own.select("chunk_id", F.lit(True).alias("_in")), "chunk_id", "left")
    fine = F.when(usable(F.col("v"), dim), dot(F.col("v"), F.col("v")) > 0).otherwise(False)
    return met.select("chunk_id", F.when(F.col("_in").isNull(), "unknown_chunk").when(~fine, "unusable_vector").alias("reason")).where(F.col("reason").isNotNull())


def removed(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The index without the vectors of some ids."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def quality(own: DataFrame, given: DataFrame, dim: int) -> DataFrame:
    """One row: chunks, given (with an agent's vector), coverage in per cent, span (of the ten nearest to an even probe), advice."""
    probe = F.array(*[F.lit(0.1)] * dim)
    near = own.where(F.col("v").isNotNull()).where(dot(F.col("v"), F.col("v")) > 0).select(cosine(F.col("v"), probe).alias("s")).orderBy(F.desc(F.round("s", 9))).limit(10)
    span = near.agg(F.max("s") - F.min("s")).scalar()
    k = own.select("chunk_id").join(given.select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.count("*")).scalar()
    row = own.agg(F.count("*").alias("chunks")).withColumn("given", k)
    share = F.col("given") / F.greatest(F.col("chunks"), F.lit(1)) * 100.0
    return row.select("chunks", "given", F.round(share, 2).alias("coverage"), F.round(span, 4).alias("span"), F.when(share < 5, "critical").when(share < 80, "low").alias("advice"))


def nearest(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """(id, similarity) of the k nearest to one query vector.  A map and a top-k; nothing else is shuffled."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.where(usable(F.col(vector_col), len(query))).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "id").limit(k)


def nearest_current(history: DataFrame, id_col: str, version_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """(id, similarity) of the k ids whose highest version is nearest to one query vector, to nine places.

    Similarities are taken row by row and the version is decided among them, so no vector is shuffled.  An id whose highest
    version is not usable is similar to none.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.when(usable(F.col(vector_col), len(query)), cosine(F.col(vector_col), q))
    last = history.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(version_col).alias("n"), own.alias("s")).groupBy("id").agg(F.max_by("s", "n").alias("similarity"))
    return last.where(F.col("similarity").isNotNull()).orderBy(F.desc(F.round("similarity", 9)), "id").limit(k)


#: Query vectors that are sent to every task at most, in bytes of their numbers.
SENT = 64 << 20
#: Rows of the base that meet the queries at once, and how many similarities a task holds at most.
ROWS, CELLS = 2048, 1 << 21


def nearest_batch(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, dim: int, k: int, blocks: int = 16) -> DataFrame:
    """(query_id, id, rank, similarity): the k nearest of every query row, by exact block products.

    Queries of up to SENT bytes, which is checked, go to every task; the base streams by in batches and a task keeps the k
    best of each query so far, so the base is neither shuffled nor held.  More queries meet the base in shuffled blocks.
    """
    usable_queries = queries.where(usable(F.col(vector_col), dim))
    few = usable_queries.limit(SENT // (8 * dim) + 1).count()
    if few * 8 * dim > SENT:
        partial = _blocks(queries, base, id_col, vector_col, dim, k, blocks)
    else:
        partial = _streamed(usable_queries, base.where(usable(F.col(vector_col), dim)), id_col, vector_col, dim, k)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    return partial.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")


def _streamed(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, dim: int, k: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def matrix(column: pa.Array) -> np.ndarray:
        x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        n = np.sqrt((x * x).sum(1))
        return x / np.where(n == 0, 1, n)[:, None]

    held = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v")).toArrow()
    ids = held["q"].combine_chunks() if held.num_rows else pa.array([], pa.int64())
    sent = base.sparkSession.sparkContext.broadcast((ids, matrix(held["v"].combine_chunks()) if held.num_rows else np.empty((0, dim))))

    def work(batches):  # noqa: ANN001, ANN202
        ids, x = sent.value
        best_s, best_i = np.full((len(x), k), -np.inf), np.empty((len(x), k), object)
        kind = None
        for b in batches:
            kind = b[0].type
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                _merged(x, matrix(part[1]), np.array(part[0].to_pylist(), object), best_s, best_i, k)
        if kind is not None and len(x):
            rows, at = np.nonzero(best_s > -np.inf)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(best_i[rows, at].tolist(), kind), pa.array(best_s[rows, at])], ["query_id", "id", "similarity"])

    return base.select(id_col, vector_col).mapInArrow(work, f"query_id {dict(queries.dtypes)[id_col]}, id {dict(base.dtypes)[id_col]}, similarity double")


def _merged(x, y, ids, best_s, best_i, k: int) -> None:  # noqa: ANN001
    """Put what of the unit vectors ``y`` is among the k best of each of ``x`` into ``best_s`` and ``best_i``, by similarity to 12 places, then id.

    At most CELLS similarities are held at once, however many the queries are.
    """
    import numpy as np

    step = max(1, CELLS // max(1, len(y)))
    for lo in range(0, len(x) if len(y) else 0, step):
        s = x[lo : lo + step] @ y.T
        # the k-th best so far; less than a unit of the 12th place is lost by rounding
        for q in np.flatnonzero(s.max(1) >= best_s[lo : lo + step, -1] - 1e-11).tolist():
            r = np.round(s[q], 12)
            least = max(np.round(best_s[lo + q, -1], 12), np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf)
            told = [(v, i) for v, i in zip(best_s[lo + q].tolist(), best_i[lo + q].tolist(), strict=True) if v > -np.inf]
            told += [(float(s[q, j]), ids[j]) for j in np.flatnonzero(r >= least).tolist()]
            told = sorted(told, key=lambda z: (-round(z[0], 12), z[1]))[:k]
            best_s[lo + q, : len(told)], best_i[lo + q, : len(told)] = [v for v, _ in told], [i for _, i in told]


def _blocks(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, dim: int, k: int, blocks: int) -> DataFrame:
    """(query_id, id, similarity): the k best of each query in each share of the base; every block of queries meets every share once."""
    import numpy as np
    import pandas as pd

    cols = f"query_id {dict(queries.dtypes)[id_col]}, id {dict(base.dtypes)[id_col]}, similarity double"
    q = queries.where(usable(F.col(vector_col), dim)).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q")).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    b = base.where(usable(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(parts)))
    q = q.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    b = b.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))) if blocks > 1 else b.withColumn("_b", F.lit(0).cast("long"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "similarity": np.empty(0)})
        x, y = (np.array(d.tolist(), np.float64) for d in (left["q"], right["v"]))
        nx, ny = (np.sqrt((m * m).sum(1)) for m in (x, y))
        x, y = x / np.where(nx == 0, 1, nx)[:, None], y / np.where(ny == 0, 1, ny)[:, None]
        ids = right["id"].to_numpy()
        best_s, best_i = np.full((len(x), k), -np.inf), np.empty((len(x), k), object)
        for lo in range(0, len(y), ROWS):
            _merged(x, y[lo : lo + ROWS], ids[lo : lo + ROWS], best_s, best_i, k)
        rows, at = np.nonzero(best_s > -np.inf)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[rows], "id": best_i[rows, at].tolist(), "similarity": best_s[rows, at]})

    return q.groupBy("_b", "_p").cogroup(b.groupBy("_b", "_p")).applyInPandas(meet, cols)


def blend_weight(query: str, base: float) -> float:
    """The vector side's weight: less for code-like queries, least for prose."""
    import re

    signs = ["_" in query, bool(re.search(r"[A-Z][a-z]+[A-Z]", query)), bool(set(query) & set("{}[]();")), bool(re.search(r"\b(def|class|function|import|const|let|var|fn|pub)\b", query)), "." in query and not query.endswith(".")]
    n = sum(signs)
    return max(0.3, base - 0.3) if n >= 3 else max(0.3, base - 0.15) if n else max(0.08, base - 0.40)


def hybrid(near: DataFrame, keyword: DataFrame, alpha: float, top_k: int, boosted: DataFrame | None = None) -> DataFrame:
    """(id, score, source): the blend of a vector top list (id, similarity) and a keyword top list (id, score).

    Vector scores are scaled to the span of the list (all 1 without a span) and boosted for ids in ``boosted``; keyword
    scores are divided by their maximum.  The blend gives way to the pure keyword order if any keyword score is above 0
    and (the five best of both sides share at most half, or a clear vector winner is not among the five best keyword
    hits, or the vector scores are flat, or the best of them is weak).  All conditions come from the two bounded lists
    in the same plan; nothing is brought to the driver.
    """
    v = near.select("id", F.col("similarity").alias("v"))
    rows = v.join(keyword.select("id", F.col("score").alias("b")), "id", "full").withColumn("b", F.coalesce("b", F.lit(0.0)))
    rows = rows.withColumn("boost", F.lit(False)) if boosted is None else rows.join(boosted.select("id").distinct().withColumn("boost", F.lit(True)), "id", "left").withColumn("boost", F.coalesce("boost", F.lit(False)))
    all_rows = Window.partitionBy(F.lit(1))  # at most 5 k rows: both lists are top lists
    by_v = Window.partitionBy(F.lit(1)).orderBy(F.col("v").desc_nulls_last(), "id")
    by_b = Window.partitionBy(F.lit(1)).orderBy(F.desc("b"), "id")
    s = rows.withColumns({"rv": F.when(F.col("v").isNotNull(), F.row_number().over(by_v)), "rb": F.row_number().over(by_b)})
    s = s.withColumns(
        {
            "vmax": F.max("v").over(all_rows),
            "vmin": F.min("v").over(all_rows),
            "bmax": F.max("b").over(all_rows),
            "nv": F.count("v").over(all_rows),
            "both": F.sum(((F.col("rv") <= 5) & (F.col("rb") <= 5)).cast("int")).over(all_rows),
            "rest": F.max(F.when(F.col("rv") == F.least(F.lit(4), F.count("v").over(all_rows)), F.col("v"))).over(all_rows),
            "winner": F.max(F.when(F.col("rv") == 1, F.col("rb"))).over(all_rows),
        }
    )
    span = F.col("vmax") - F.col("vmin")
    disagree = F.when(F.col("nv") == 0, 0.0).otherwise(1 - F.coalesce(F.col("both"), F.lit(0)) / F.greatest(F.least(F.col("nv"), F.lit(5)), F.lit(1)))
    clear = (F.col("nv") >= 2) & (F.col("vmax") - F.col("rest") > 0.15) & (F.col("winner") > 5)
    flat = (F.col("nv") >= 4) & (F.coalesce(span, F.lit(0.0)) < 0.035)
    weak = F.coalesce(F.col("vmax"), F.lit(0.0)) < 0.70
    fallback = ((disagree >= 0.5) | F.coalesce(clear, F.lit(False)) | flat | weak) & (F.col("bmax") > 0)
    nv = F.when(F.col("v").isNull(), 0.0).when(span > 0, (F.col("v") - F.col("vmin")) / span).otherwise(1.0) * F.when(F.col("boost"), TIER2_BOOST).otherwise(1.0)
    nb = F.when(F.col("bmax") > 0, F.col("b") / F.col("bmax")).otherwise(F.col("b"))
    out = s.select("id", F.when(fallback, nb).otherwise(alpha * nv + (1 - alpha) * nb).alias("score"), F.when(fallback, "keyword").otherwise("vector").alias("source"))
    return out.orderBy(F.desc("score"), "id").limit(top_k)
