"""Most similar vectors by additive quantisation.

A vector is approximated by the sum of one entry from each of CODEBOOKS full-dimensional residual codebooks of ENTRIES
entries.  The codebooks are fitted by k-means on the residuals of a bounded sample (SAMPLE vectors, the least hashes of
the ids); every vector is indexed.  Encoding is a beam search.  The first ``depth`` codes of each of the BEAM best paths
are the vector's lists, so near vectors, whose paths differ in order of quality only, share a list.  The depth follows
from the number of vectors, so that lists stay small, and ends where codes would tell near vectors apart.  That is also
judged path by path: a path ends at the code that leaves over at most CLEAR times the distance at the threshold, and one
that leaves over little more is listed there besides going on, so that it meets near vectors whose paths end.  Within a
list, pairs are scored from the codes alone: a table of all products of codebook entries gives the product of two sums by
lookups, divided by the stored norms.  Pairs within ``slack`` of the threshold are scored exactly on the vectors.

In lists beyond LIMIT members, paths that go on are branched again by ``depth + 2`` codes; those that end, as in a dense
group of different vectors, are compared exactly on the vectors in salted blocks of about BLOCK members, of which each
pair of blocks yields the k + 1 nearest of every member.  That work grows with the square of such a group.  Equal vectors are one class; a class shows at most k + 1 members to each partner, which
is all that k neighbours can need, so a hot vector costs k rows a copy and not a square.

Defined results: a vector that is null, of another length, zero, or holds a NaN, null or infinity is similar to none; of
an id's rows the highest version counts, repeats once; ties in similarity go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import grouping as G
from quillgraph.session import materialize, materialize_by

CODEBOOKS, ENTRIES, BEAM, SAMPLE, LIMIT, ROUNDS, BLOCK = 10, 64, 8, 16_384, 1024, 8, 4096
#: Codes name a vector's lists only while what is left to encode is this many times the distance at the threshold.
CLEAR = 1.5


def current(df: DataFrame, id_col: str, version_col: str, vector_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors (vid, v), members (vid, id)) of the current usable vectors.

    vid is a hash of the vector, so equal vectors share it.  Which vector is current is decided on (id, version, vid)
    alone; the vectors themselves are shuffled once, by vid, and stay bucketed by it.
    """
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(version_col, F.lit(-1)).alias("n"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull())
    usable = (F.size("v") == dim) & ~bad & F.exists("v", lambda e: e != 0)
    vid = F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("v"))
    latest = rows.select("id", "n", vid.alias("vid")).groupBy("id").agg(F.max_by(F.struct("vid"), F.struct("n", "vid")).alias("r"))
    members = materialize(latest.select(F.col("r.vid").alias("vid"), "id").where(F.col("vid").isNotNull()), "p7-members")
    held = rows.where(usable).select(F.xxhash64("v").alias("vid"), "v").join(members.select("vid").distinct(), "vid", "left_semi")
    return materialize_by(held.dropDuplicates(["vid"]), "vid", "p7-vectors"), members


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the usable vectors, their unit rows in double precision)."""
    n = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(n == dim)
    if not len(at):
        return at, np.empty((0, dim))
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)  # a null becomes NaN
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], x[ok] / norm[ok, None]


def fit(x: np.ndarray, books: int = CODEBOOKS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Residual codebooks (books, entries, dim) by k-means on what the codebooks before leave over."""
    rng = np.random.default_rng(7)
    r = x.astype(np.float32)
    out = np.zeros((books, entries, x.shape[1]), np.float32)
    for m in range(books):
        c = r[rng.permutation(len(r))[: min(entries, len(r))]].copy()
        for _ in range(rounds):
            a = np.argmax(r @ c.T - 0.5 * (c * c).sum(1), 1)
            n = np.bincount(a, minlength=len(c))
            order = np.argsort(a, kind="stable")
            sums = np.add.reduceat(r[order], np.concatenate([[0], np.cumsum(n)[:-1]]).clip(max=len(r) - 1), axis=0)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out[m, : len(c)] = c
        if len(c) < entries:
            out[m, len(c) :] = c[0]
        r = r - c[np.argmax(r @ c.T - 0.5 * (c * c).sum(1), 1)]
    return out


def encode(x: np.ndarray, books: np.ndarray, depth: int, beam: int = BEAM) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(levels, best full codes (n, books), norms of the approximations).

    A level is (paths (n, beam, m), what each leaves over (n, beam), the places of their parents) for m codes up to ``depth``.
    """
    m_all, k, _ = books.shape
    n, x = len(x), x.astype(np.float32)
    sq = (books * books).sum(2)
    own = (x * x).sum(1)[:, None]
    paths = np.zeros((n, 1, 0), np.int64)
    cost = np.zeros((n, 1), np.float32)
    levels = []
    for m in range(m_all):
        new = cost[:, :, None] + (sq[m] - 2 * x @ books[m].T)[:, None, :]
        for q in range(m):
            new += (2 * books[q] @ books[m].T)[paths[:, :, q]]
        flat = new.reshape(n, -1)
        width = min(beam if m < depth else 2, flat.shape[1])
        top = np.argpartition(flat, width - 1, 1)[:, :width]
        cost = np.take_along_axis(flat, top, 1)
        paths = np.concatenate([np.take_along_axis(paths, (top // k)[:, :, None], 1), (top % k)[:, :, None]], 2)
        if m < depth:
            levels.append((paths, np.sqrt(np.maximum(own + cost, 0)), top // k))
    best = np.take_along_axis(paths, np.argmin(cost, 1)[:, None, None], 1)[:, 0]
    approx = sum(books[m][best[:, m]] for m in range(m_all))
    return levels, best.astype(np.uint8), np.sqrt((approx * approx).sum(1))


def left_over(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The root mean square of what is left of the vectors before each codebook."""
    r, out = x.astype(np.float32), []
    for c in books:
        out.append(float(np.sqrt((r * r).sum(1).mean())))
        r = r - c[np.argmax(r @ c.T - 0.5 * (c * c).sum(1), 1)]
    return np.array(out)


def apart(threshold: float) -> float:
    """The distance of two unit vectors whose cosine is ``threshold``."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def list_depth(n: int, left: np.ndarray, threshold: float) -> int:
    """The codes a list is made of: with ENTRIES ** (depth - 1) of the order of n a list holds a few vectors."""
    clear = int((left > CLEAR * apart(threshold)).sum())
    return max(1, min(CODEBOOKS - 2, clear, 1 + math.ceil(math.log(max(n, 2) / 2, ENTRIES))))


def _indexed(v: DataFrame, books: np.ndarray, depth: int, near: float, above: int = 0) -> DataFrame:
    """(list, vid, code, norm, ends, goes_on): the entries of every vector in its lists of more than ``above`` codes.

    ``near`` is the distance at the threshold.  An entry that ends must meet its list at this depth; one that goes on has
    codes left that do not tell near vectors apart.
    """
    dim = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_rows(b[1], dim)
            for lo in range(0, len(at), 2000):
                part = at[lo : lo + 2000]
                levels, code, norm = encode(x[lo : lo + 2000], books, depth)
                vid = b[0].take(pa.array(part)).to_numpy(zero_copy_only=False)
                codes = np.array([c.tobytes() for c in code], object)
                key, on = np.ones((len(part), 1), np.int64), np.ones((len(part), 1), bool)
                for m, (paths, rest, parent) in enumerate(levels, 1):
                    key = np.take_along_axis(key, parent, 1) * ENTRIES + paths[:, :, m - 1]  # begins with 1, so depths differ
                    on = np.take_along_axis(on, parent, 1)
                    ends = rest <= (CLEAR + 0.5) * near
                    listed = on & (ends | (m == depth)) if m > above else np.zeros_like(on)
                    on = on & (rest > CLEAR * near)
                    i, j = np.nonzero(listed)
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[i, j]), pa.array(vid[i]), pa.array(codes[i], pa.binary()), pa.array(norm[i].astype(np.float32)), pa.array(ends[i, j]), pa.array(on[i, j])],
                            ["list", "vid", "code", "norm", "ends", "goes_on"],
                        )

    return v.select("vid", "v").mapInArrow(work, "list bigint, vid bigint, code binary, norm float, ends boolean, goes_on boolean")


def _scored(lists: DataFrame, books: np.ndarray, floor: float) -> DataFrame:
    """(a, b) of the pairs within each list whose looked-up similarity reaches ``floor``."""
    m = len(books)
    flat = books.reshape(-1, books.shape[2])
    table = (flat @ flat.T).astype(np.float32)
    shift = (np.arange(m) * ENTRIES).astype(np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b[0]
            n = col.value_lengths().to_numpy(zero_copy_only=False)
            items = col.flatten()
            vid = items.field("vid").to_numpy(zero_copy_only=False)
            norm = items.field("norm").to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(items.field("code").to_pylist()), np.uint8).reshape(len(vid), m).astype(np.int64) + shift
            start = np.cumsum(n) - n
            left, right = [], []
            for size in np.unique(n):
                i, j = np.triu_indices(size, 1)
                s = start[n == size][:, None]
                left.append((s + i).ravel())
                right.append((s + j).ravel())
            left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            keep_a, keep_b = [], []
            for lo in range(0, len(left), 200_000):
                p, q = left[lo : lo + 200_000], right[lo : lo + 200_000]
                dot = np.zeros(len(p), np.float32)
                for y in range(m):
                    for z in range(m):
                        dot += table[code[p, y], code[q, z]]
                ok = (dot >= floor * norm[p] * norm[q]) & (vid[p] != vid[q])
                keep_a.append(vid[p[ok]])
                keep_b.append(vid[q[ok]])
            a, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keep_a, keep_b))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    return lists.select("members").mapInArrow(score, "a bigint, b bigint")


def nearest(x: np.ndarray, y: np.ndarray, most: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity): for every row of x its ``most`` nearest rows of y at the threshold or above, ties by place; ``same``: not itself."""
    out = []
    for lo in range(0, len(x), 256):
        s = np.round(x[lo : lo + 256] @ y.T, 9)
        if same:
            s[np.arange(len(s)), lo + np.arange(len(s))] = -2
        least = np.full((len(s), 1), threshold)
        if s.shape[1] > most:
            least = np.maximum(least, np.partition(s, s.shape[1] - most, 1)[:, s.shape[1] - most, None])
        keep = s >= least
        crowded = np.flatnonzero(keep.sum(1) > most)
        for r in crowded.tolist():
            at = np.flatnonzero(keep[r])
            keep[r] = False
            keep[r, at[np.argsort(-s[r, at], kind="stable")[:most]]] = True
        i, j = np.nonzero(keep)
        out.append((i + lo, j, s[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _blocked(big: DataFrame, v: DataFrame, dim: int, most: int, threshold: float, block: int) -> DataFrame:
    """(a, b, similarity): the ``most`` nearest of each member of the lists in ``big`` (list, vid), exactly; each task meets one pair of blocks."""
    sizes = big.groupBy("list").agg(F.ceil(F.count("*") / block).alias("_nb"))
    b = big.join(sizes, "list").withColumn("_b", F.pmod(F.xxhash64("vid", F.lit(5)), F.col("_nb"))).join(v.select("vid", "v"), "vid")
    left = b.select("list", F.col("_b").alias("_x"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_y"), "vid", "v")
    right = b.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_x"), F.col("_b").alias("_y"), "vid", "v").toDF("_l", "_p", "_q", "_vid", "_v")

    def rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.combine_chunks().sort_by(t.column_names[3])
        at, x = unit_rows(t[4].combine_chunks(), dim)
        return t[3].to_numpy()[at], x

    def meet(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        (a, x), (c, y) = rows(p), rows(q)
        same = key[1].as_py() == key[2].as_py()
        i, j, s = nearest(x, y, most, threshold, same)
        a_all, b_all, s_all = [a[i]], [c[j]], [s]
        if not same:
            j, i, s = nearest(y, x, most, threshold, same)
            a_all, b_all, s_all = [*a_all, c[j]], [*b_all, a[i]], [*s_all, s]
        return pa.table({"a": np.concatenate(a_all), "b": np.concatenate(b_all), "similarity": np.concatenate(s_all)})

    met = left.groupBy("list", "_x", "_y").cogroup(right.groupBy("_l", "_p", "_q")).applyInArrow(meet, "a bigint, b bigint, similarity double")
    met = materialize(met, "p7-met").dropDuplicates(["a", "b"])
    return met.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("_r") <= most).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"
    )


def candidates(v: DataFrame, books: np.ndarray, depth: int, floor: float, most: int, threshold: float, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, exact): distinct (a, b) vids that share a list within the limit and pass the looked-up score; (a, b, similarity) from lists beyond it, if any."""
    found, ended, level, above = [], [], v, 0
    while True:
        entries = materialize(_indexed(level, books, depth, apart(threshold), above), "p7-entries")
        sizes = G.sized(entries, "list")
        small = G.within_limit(entries, sizes, "list", limit).groupBy("list").agg(F.collect_list(F.struct("vid", "code", "norm")).alias("members"))
        found.append(_scored(small, books, floor))
        big = materialize(G.beyond_limit(entries.select("list", "vid", "ends", "goes_on"), sizes, "list", limit), "p7-big")
        if big.isEmpty():
            break
        last = depth == CODEBOOKS
        ended.append((big if last else big.where("ends")).select("list", "vid"))
        on = big.where("goes_on").select("vid").distinct()
        if last or on.isEmpty():
            break
        above, depth = depth, min(CODEBOOKS, depth + 2)
        level = v.join(on, "vid", "left_semi")
    exact = None
    if ended:
        exact = _blocked(reduce(DataFrame.unionByName, ended), v, books.shape[2], most, threshold, max(limit, BLOCK))
    return reduce(DataFrame.unionByName, found).distinct(), exact


def similar_vectors(df: DataFrame, id_col: str, version_col: str, vector_col: str, dim: int, k: int, threshold: float, slack: float = 0.25, sample: int = SAMPLE) -> DataFrame:
    """(a, b, similarity): pairs of ids at or above the threshold of which one is among the k most similar of the other."""
    vectors, members = current(df, id_col, version_col, vector_col, dim)
    n = vectors.count()
    share = F.pmod(F.xxhash64("vid", F.lit(11)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(n, 1)))
    rows = vectors.where(share).select("v").limit(2 * sample).toArrow()
    at, x = unit_rows(rows["v"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float32())), dim)
    if not len(at):
        rows = vectors.select("v").limit(sample).toArrow()
        at, x = unit_rows(rows["v"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float32())), dim)
    if not len(at):
        return df.sparkSession.createDataFrame([], "a string, b string, similarity double")
    books = fit(x)
    pairs, blocked = candidates(vectors, books, list_depth(n, left_over(x, books), threshold), threshold - slack, k + 1, threshold)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, x = unit_rows(b[2], dim)
            j, y = unit_rows(b[3], dim)
            assert len(i) == len(j) == b.num_rows
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(np.round((x * y).sum(1), 9))], ["a", "b", "similarity"])

    near = materialize(
        pairs.join(vectors.select(F.col("vid").alias("a"), F.col("v").alias("x")), "a")
        .join(vectors.select(F.col("vid").alias("b"), F.col("v").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(exact, "a bigint, b bigint, similarity double")
        .where(F.col("similarity") >= threshold),
        "p7-near",
    )
    if blocked is not None:
        near = materialize(near.unionByName(blocked).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "p7-all")
    return _ranked(near, members, k)


def _ranked(near: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The pairs of ids, from the near pairs of vectors and the ids of each."""
    # The k + 1 least ids of a class, in bounded state: per salt first, then over the salts.
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    first = ids.withColumn("_r", F.row_number().over(Window.partitionBy("vid", salt).orderBy("id"))).where(F.col("_r") <= k + 1)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("_r") <= k + 1).select("vid", "id")
    links = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    # A class's k + 1 most similar classes suffice, as each holds at least one id.
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    links = links.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    own = first.select(F.col("vid").alias("a"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
    other = links.join(first.select(F.col("vid").alias("b"), F.col("id").alias("y")), "b").select("a", "y", "similarity")
    offered = own.unionByName(other)
    per = offered.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "y"))).where(F.col("_r") <= k + 1).drop("_r")
    rows = per.join(ids.select(F.col("vid").alias("a"), F.col("id").alias("x")), "a").where("x != y")
    kept = rows.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "y"))).where(F.col("_r") <= k)
    return kept.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").dropDuplicates(["a", "b"])
