"""Filling containers of fixed capacity: harmonic packing.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C / (k + 1), C / k], so any k items of class k
fit one container, and a container of class k is closed to its class after exactly k items, whatever their lengths.
With ``fill``, the gap g that a container is left with belongs to a class too.  It takes one item: the shortest of its own
class C // g if that fits, else one of the coarsest class that fits whatever its length (items up to C / ceil(C / g)); the
rest of the gap is a smaller gap.  A step is a look-up of a class, not a search among lengths.

Items are dealt by the hash of their id into shares of about SHARE items; their number follows from the number of items
alone, each share is packed independently of the others and by one task, which holds the share's lengths and nothing else.

Defined results: items without tokens (or with a null count) get no container; an item beyond the capacity is cut into
full pieces, each a container of its own, and a rest that is packed like any item; equal lengths go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize

CAPACITY, SHARE = 2048, 200_000


def pack(lengths: np.ndarray, capacity: int, fill: bool = True) -> np.ndarray:
    """The container number of each length (all between 1 and the capacity), for one share; lengths within a class in the order given."""
    out = np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return out
    sizes = np.asarray(lengths, np.int64)
    kinds = capacity // sizes
    order = np.argsort(kinds, kind="stable")
    first = np.searchsorted(kinds[order], np.arange(capacity + 2)).tolist()  # class k: order[first[k]:first[k + 1]]
    place, size = order.tolist(), sizes.tolist()
    at, end = first[:-1], first[1:]  # the unpacked items of each class: order[at[k]:end[k]]
    finer = list(range(capacity + 2))  # a forest that leads past the classes that are used up

    def full(k: int) -> int:
        """The coarsest class from k on that is not used up, or capacity + 1."""
        root = k
        while root <= capacity and (finer[root] != root or at[root] == end[root]):
            root = finer[root] if finer[root] != root else root + 1
        while k < root:
            finer[k], k = root, max(finer[k], k + 1)
        return root

    container, k = 0, full(1)
    while k <= capacity:
        gap = capacity
        stop = min(at[k] + k, end[k])
        for i in range(at[k], stop):
            out[place[i]] = container
            gap -= size[place[i]]
        at[k] = stop
        while fill and gap > 0:
            j = capacity // gap
            if at[j] < end[j] and size[place[end[j] - 1]] <= gap:
                end[j] -= 1
                i = place[end[j]]
            else:
                j = full(-(-capacity // gap))
                if j > capacity:
                    break
                i = place[at[j]]
                at[j] += 1
            out[i] = container
            gap -= size[i]
        container += 1
        k = full(k)
    return out


def containers(counted: DataFrame, id_col: str, count_col: str, capacity: int = CAPACITY, fill: bool = True, share: int = SHARE) -> DataFrame:
    """(id, piece_no, start_token, n_tokens, container_id): where each piece of each item goes.

    Only ids and counts are written and shuffled.  A container number is unique across shares, the same on every attempt
    of a task and whatever the session's settings.
    """
    kind = dict(counted.dtypes)[id_col]
    rows = materialize(counted.where(F.col(count_col) > 0).select(F.col(id_col), F.col(count_col).cast("long").alias("n")), "p9-counts")
    n = max(1, math.ceil(rows.count() / share))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(id_col, "n"), F.lit(n)).cast("int"))

    def placed(ids: pa.Array, counts: np.ndarray, number: int) -> pa.RecordBatch:
        whole, rest = np.divmod(counts, capacity)
        pieces = whole + (rest > 0)
        owner = np.repeat(np.arange(len(counts)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = piece == whole[owner]
        length = np.where(last, rest[owner], capacity)
        where = np.empty(len(owner), np.int64)
        where[~last] = np.arange((~last).sum())
        where[last] = pack(length[last], capacity, fill) + (~last).sum()
        cols = [ids.take(pa.array(owner)), pa.array(piece), pa.array(piece * capacity), pa.array(length), pa.array((number << 40) | where)]
        return pa.RecordBatch.from_arrays(cols, [id_col, "piece_no", "start_token", "n_tokens", "container_id"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                yield placed(pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), now)

        for b in batches:
            number = b[2].to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e > s:
                    if number[s] != now:
                        yield from flush()
                        now, parts = int(number[s]), []
                    parts.append((b[0].slice(s, e - s), b[1].slice(s, e - s).to_numpy()))
        yield from flush()

    shared = rows.repartition(n, "share").sortWithinPartitions("share", F.desc("n"), id_col)
    return shared.mapInArrow(work, f"`{id_col}` {kind}, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint")


def filled(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (containers, tokens, filled): how full the containers are."""
    total = packed.agg(F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return total.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
