"""Cutting oversized texts at natural boundaries.

A text is worked on as byte ranges.  Each range yields a boundary table (line ends, which of them end an empty line,
spaces where lines are longer than a window) with positions counted in code points from the range's start, and the
state of its open first and last line.  Tables of one text are stitched in range order: a running sum of the ranges'
lengths moves the positions, the open-line states decide whether a line end at a range's head ends an empty line.  The
pieces come from the stitched tables alone, by a walk that holds what lies within one piece of its place, so its memory
depends neither on the text's length nor on its boundaries.

Texts of one range stay where they are; those of several have their ranges cut out one by one and dealt over the workers.
``split_files`` reads giant files by ranges: each worker opens the file, reads its own range, and no task sees the rest.

Defined results: null and short texts give no pieces; a repeated id gives its pieces once; a row with a null id is left
out; a null start position counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, LEAST, OVERLAP = 2400, 1200, 200
RANGE_BYTES = 1 << 20


def range_table(data: bytes, least: int) -> tuple[int, bytes, bytes, bytes, bool, bool, bool]:
    """(code points, line ends, empty-line marks, spaces, head blank, tail blank, has a line end) of one byte range.

    A code point belongs to the range of its first byte, so counting first bytes needs no halo; the line that is open
    at either edge is the halo's part and travels as the two blank states.
    """
    a = np.frombuffer(data, np.uint8)
    cp = np.cumsum((a & 0xC0) != 0x80).astype(np.int32)
    lf = np.flatnonzero(a == 10)
    solid = np.cumsum((a != 10) & (a != 32) & (a != 9) & (a != 13))
    ends = cp[lf]
    at = solid[lf]
    empty = np.zeros(len(lf), np.uint8)
    if len(lf) > 1:
        empty[1:] = at[1:] == at[:-1]
    head = bool(at[0] == 0) if len(lf) else bool(len(a) == 0 or solid[-1] == 0)
    tail = bool(len(lf) and solid[-1] == at[-1]) if len(lf) else head
    sp = cp[np.flatnonzero(a == 32)]
    if len(lf):  # a window wider than `least` always holds a line end if the line is not longer
        i = np.searchsorted(ends, sp, "right")
        before = np.where(i > 0, ends[np.maximum(i - 1, 0)], -(1 << 30))
        after = np.where(i < len(ends), ends[np.minimum(i, len(ends) - 1)], 1 << 30)
        sp = sp[after - before > least]
    return int(cp[-1]) if len(a) else 0, ends.tobytes(), empty.tobytes(), sp.tobytes(), head, tail, bool(len(lf))


class Walk:
    """The pieces of one text, from its ranges' tables in order (``add``, then ``close``): last empty line, else last line end, else last space, else the limit."""

    def __init__(self, limit: int, least: int, overlap: int) -> None:
        self.limit, self.least, self.overlap = limit, least, overlap
        self.at = self.seen = 0
        self.open_blank = False  # before the first line feed no line is an empty one
        self.held = [np.empty(0, np.int64)] * 3  # empty lines, line ends, spaces from here on

    def add(self, n: int, ends: bytes, empties: bytes, spaces: bytes, head: bool, tail: bool, has: bool) -> list[tuple[int, int]]:
        """Stitch the next range on; the pieces that its end settles."""
        e = np.frombuffer(ends, np.int32).astype(np.int64) + self.seen
        m = np.frombuffer(empties, np.uint8).astype(bool)
        if has:
            m = np.concatenate([[head and self.open_blank], m[1:]])
        self.open_blank = tail if has else self.open_blank and head
        new = e[m], e, np.frombuffer(spaces, np.int32).astype(np.int64) + self.seen
        self.held = [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        self.seen += n
        out = []
        while self.seen - self.at > self.limit:
            stop = self.at + self.limit
            for marks in self.held:
                k = int(np.searchsorted(marks, self.at + self.limit, "right"))
                if k and marks[k - 1] > self.at + self.least:
                    stop = int(marks[k - 1])
                    break
            out.append((self.at, stop))
            self.at = stop - self.overlap
        self.held = [x[np.searchsorted(x, self.at) :] for x in self.held]
        return out

    def close(self) -> list[tuple[int, int]]:
        return [(self.at, self.seen)]


_TABLE = "id string, base bigint, range_no bigint, n int, ends binary, empties binary, spaces binary, head boolean, tail boolean, has boolean"
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_()]


def _checked(limit: int, least: int, overlap: int) -> None:
    if not 0 <= overlap < least < limit:
        raise ValueError("0 <= overlap < least < limit must hold")


def _pieces(tabled: DataFrame, limit: int, least: int, overlap: int) -> DataFrame:
    """(id, start_pos, end_pos) from the ranges' tables.  Copies of an id go first (map-side), so no id is hot."""

    def batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        ids, starts, stops = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["id", "start_pos", "end_pos"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, walk = None, 0, Walk(limit, least, overlap)

        def placed(found: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
            return [(now, base + s, base + e) for s, e in found]

        for b in batches:
            rows: list[tuple[str, int, int]] = []
            for r in b.to_pylist():
                if r["id"] != now:
                    rows += placed(walk.close()) if now is not None and walk.seen > limit else []
                    now, base, walk = r["id"], r["base"], Walk(limit, least, overlap)
                rows += placed(walk.add(r["n"], r["ends"], r["empties"], r["spaces"], r["head"], r["tail"], r["has"]))
            yield batch(rows)
        yield batch(placed(walk.close()) if now is not None and walk.seen > limit else [])

    once = tabled.dropDuplicates(["id", "range_no"])
    return once.repartition("id").sortWithinPartitions("id", "range_no").mapInArrow(work, "id string, start_pos bigint, end_pos bigint")


def split_oversized(
    df: DataFrame,
    id_col: str,
    text_col: str,
    start_col: str,
    limit: int = LIMIT,
    least: int = LEAST,
    overlap: int = OVERLAP,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(id, start_pos, end_pos) of the pieces of every text longer than ``limit`` code points; see the module docstring."""
    _checked(limit, least, overlap)
    big = df.where(F.col(id_col).isNotNull() & (F.char_length(text_col) > limit)).select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(start_col).cast("long"), F.lit(0)).alias("base"), F.col(text_col).cast("binary").alias("data")
    )
    small = F.octet_length("data") <= range_bytes
    single = big.where(small).select("id", "base", F.lit(0).cast("long").alias("range_no"), "data")
    last = F.floor((F.octet_length("data") - 1) / range_bytes).cast("int")
    # The ranges are cut inside the row, so an exploded row carries its own range and not the text.
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("long").alias("range_no"), F.substring("data", i * range_bytes + 1, F.lit(range_bytes)).alias("data")))
    several = big.where(~small).select("id", "base", F.explode(cut).alias("r")).select("id", "base", "r.range_no", "r.data").repartition("id", "range_no")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(range_table(x.as_py(), least) for x in b["data"]), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b["id"], b["base"], b["range_no"], *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], _names(_TABLE))

    tabled = single.mapInArrow(tables, _TABLE).unionByName(several.mapInArrow(tables, _TABLE))
    return _pieces(tabled, limit, least, overlap).select(F.col("id").alias(id_col), "start_pos", "end_pos")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def split_files(files: DataFrame, path_col: str, length_col: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start_pos, end_pos) of the pieces of UTF-8 files longer than ``limit`` code points.

    ``files`` lists paths or URIs that every worker can open, with their lengths in bytes; a null path or length is left
    out.  A worker reads the ranges dealt to it by offset; no task loads a file.
    """
    _checked(limit, least, overlap)
    f = files.where(F.col(path_col).isNotNull() & (F.col(length_col) > limit)).select(F.col(path_col).alias("id"), F.col(length_col).cast("long").alias("size")).distinct()
    last = F.floor((F.col("size") - 1) / range_bytes).cast("long")
    ranges = f.select("id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range_no")).repartition("id", "range_no")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            found = []
            for path, no in zip(b["id"].to_pylist(), b["range_no"].to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                with store.open_input_file(inner) as source:
                    found.append((0, *range_table(source.read_at(range_bytes, no * range_bytes), least)))
            cols = list(zip(*found, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(cols[0], pa.int64()), b["range_no"], *(pa.array(c, k) for c, k in zip(cols[1:], _KINDS, strict=True))], _names(_TABLE))

    return _pieces(ranges.mapInArrow(tables, _TABLE), limit, least, overlap).select(F.col("id").alias(path_col), "start_pos", "end_pos")


def ordered(pieces: list[tuple[int, int]], overlap: int = OVERLAP) -> bool:
    """Whether consecutive pieces overlap as specified."""
    return all(b[0] == a[1] - overlap for a, b in pairwise(pieces))
