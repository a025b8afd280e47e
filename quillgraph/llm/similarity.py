"""Near-duplicate texts by a chosen-path set similarity join.

Texts are sets of word shingles.  Texts with the same set form a class; the join works on classes.  For each class a
minwise token (the shingle that has the least value under one of POSITIONS hash functions) is kept a position.  In each
of TREES independent trees a node branches its members: the node's path chooses BRANCHES of the positions, and members
with the same minwise token at a chosen position go to the same child, so a pair of similarity s shares a child with
probability 1 - (1 - s) ** BRANCHES.  Nodes of at most LIMIT members are compared exhaustively, larger ones branch
again, and those left at MAX_DEPTH are compared exactly in blocks of about BLOCK members.  Members of a node are compared
by a sketch first (eight bits of the first SKETCHED minwise tokens); a pair at the threshold passes it but for MISSED.
Every pair that passes is verified on the whole sets.

The positions below the root are the tree's own, DEEPER of them, so trees fail independently.  With BRANCHES = 2, a pair
at 0.6 shares a root child with 0.84.  As the nodes of a level draw from the same DEEPER positions, a simulation of
them stands for a formula: five trees miss such a pair with probability 0.0001 at one level, 0.0009 at two and 0.0034
at three, which is MAX_DEPTH.  The blocks' work grows with the square of a node that is still large there.  The trees of
a level are one job; levels follow only for large nodes.

Defined results: null ids are left out; null texts and texts of fewer than ``min_words`` words are in no class; a
repeated id counts once; equal texts are one class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize, materialize_by

TREES, BRANCHES, DEEPER, LIMIT, MAX_DEPTH = 5, 2, 8, 48, 3
POSITIONS = TREES * (BRANCHES + DEEPER)
#: The sketch is taken of the first positions, eight to a 64-bit number.
SKETCHED = 24
#: Members of a block of what is still large at MAX_DEPTH.
BLOCK = 4096
#: Nodes with more rows than this are hot: they branch without being brought together in one task first.
HOT = 200_000
#: The probability with which the sketch may lose a pair that is just at the threshold.
MISSED = 2.5e-4
_SAMPLED = 16

_WORD = re.compile(r"[A-Za-z0-9_]+")
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) | np.uint64(1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    """64-bit hashes of the words met so far; emptied when full, so its size is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: _Hashes, k: int, min_words: int) -> np.ndarray | None:
    """The sorted distinct 64-bit hashes of the text's shingles, or None if the text has too few words."""
    words = _WORD.findall(text) if text else []
    if len(words) < max(min_words, k):
        return None
    w = np.array([hashes[x] for x in " ".join(words).lower().split(" ")], np.uint64)
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):  # order matters: the running value is mixed before each word
        h = (h ^ (h >> np.uint64(29))) * _M1 + w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    return np.unique(h)


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise token of the set at each position, as 32 bits of the shingle's hash (a clash costs one vain comparison)."""
    out = np.empty(POSITIONS, np.uint64)
    step = max(1, (1 << 20) // len(s))
    for i in range(0, POSITIONS, step):
        v = s[None, :] * _SEEDS[i : i + step, None]
        v ^= v >> np.uint64(31)
        out[i : i + step] = s[np.argmin(v * _M3, axis=1)]
    return out.astype(np.uint32).view(np.int32)


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Eight bits of each of the first SKETCHED minwise tokens, packed in three 64-bit numbers."""
    t = tokens[:SKETCHED].view(np.uint32)
    return np.ascontiguousarray(((t ^ (t >> np.uint32(13))) & np.uint32(0xFF)).astype(np.uint8)).view(np.int64)


def least_agreement(threshold: float, missed: float = MISSED) -> int:
    """The positions in which two sketches must agree, so that a pair at the threshold falls short with probability ``missed`` at most."""
    below, c = 0.0, 0
    while True:
        below += math.comb(SKETCHED, c) * threshold**c * (1 - threshold) ** (SKETCHED - c)
        if below > missed or c == SKETCHED:
            return c
        c += 1


def keys_of(s: np.ndarray) -> tuple[bytes, int]:
    """(cls, cid): the 128-bit hash of the whole set, and its 64-bit short form that travels through the trees."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return d, int.from_bytes(d[:8], "little", signed=True)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int) -> DataFrame:
    """(id, cls, cid, k0, k1, k2, sig): class keys, sketch and minwise tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        with np.errstate(over="ignore"):
            for b in batches:
                ids, keys, sigs = [], [], []
                for i, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                    s = shingle_set(text, hashes, shingle, min_words)
                    if s is not None:
                        ids.append(i)
                        keys.append(keys_of(s))
                        sigs.append(minwise(s))
                flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int32))
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * POSITIONS), flat)
                k = np.array([sketch_of(x) for x in sigs], np.int64).reshape(len(ids), 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array([k for k, _ in keys], pa.binary()), pa.array([c for _, c in keys], pa.int64()), *(pa.array(k[:, q]) for q in range(3)), sig],
                    ["id", "cls", "cid", "k0", "k1", "k2", "sig"],
                )

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id string, cls binary, cid bigint, k0 bigint, k1 bigint, k2 bigint, sig array<int>")


_CLASS = ("cid", "k0", "k1", "k2")


def _children(nodes: DataFrame) -> DataFrame:
    """The next level: the node's own hash chooses BRANCHES different positions of its tree's deeper pool; a node number's remainder by TREES is its tree."""
    tree = F.pmod("node", F.lit(TREES))
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(DEEPER))
    offset = 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(DEEPER - 1))
    at = nodes.select("node", *_CLASS, "sig", tree.alias("_tree"), F.explode(F.array(first, F.pmod(first + offset, F.lit(DEEPER)))).alias("_p"))
    token = F.element_at("sig", (TREES * BRANCHES + F.col("_tree") * DEEPER + F.col("_p") + 1).cast("int"))
    return at.select(_numbered(F.xxhash64("node", "_p", token), F.col("_tree")).alias("node"), *_CLASS)


def _numbered(h: Column, tree: Column) -> Column:
    """The node number made of a hash and the node's tree."""
    h = F.shiftright(h, 3)
    return h - F.pmod(h, F.lit(TREES)) + tree


def _met(limit: int, agree: int):  # noqa: ANN202
    """Over rows sorted by node and class: the pairs of each node of at most ``limit`` members whose sketches agree (big false), or the members of a larger node (big true).

    Holds at most ``limit`` members of one node; the members of a larger node pass through as they come.
    """
    i, j = np.triu_indices(limit, 1)
    upto = [np.flatnonzero(j < n) for n in range(limit + 1)]
    none = np.empty(0, np.int64), np.empty((0, SKETCHED), np.uint8)

    def close(held: tuple[np.ndarray, np.ndarray], out: list) -> None:
        c, k = held
        if len(c) > 1:
            at = upto[len(c)]
            a, b = i[at], j[at]
            ok = (k[a] == k[b]).sum(1) >= agree
            if ok.any():
                out.append((c[a[ok]], c[b[ok]], False))

    def rows(out: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _, _ in out]) if out else none[0]
        c = np.concatenate([x for _, x, _ in out]) if out else none[0]
        flag = np.concatenate([np.full(len(x), f) for x, _, f in out]) if out else np.empty(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(flag)], ["a", "b", "big"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, big, last = None, none, False, None
        for batch in batches:
            node, cid = batch[0].to_numpy(), batch[1].to_numpy()
            key = np.stack([batch[q].to_numpy() for q in (2, 3, 4)], 1).view(np.uint8)
            fresh = np.ones(len(node), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (cid[1:] != cid[:-1])
            node, cid, key = node[fresh], cid[fresh], key[fresh]
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
            out: list = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                if node[s] != now:
                    close(held, out)
                    held, big, last = none, False, None
                    if e - s == 1 and e < len(node):
                        now = None  # the usual case: a member alone
                        continue
                    now = node[s]
                if cid[s] == last:
                    s += 1
                c, k = cid[s:e], key[s:e]
                if not len(c):
                    continue
                last = c[-1]
                if not big and len(held[0]) + len(c) > limit:
                    big, c, held = True, np.concatenate([held[0], c]), none
                if big:
                    out.append((np.full(len(c), now, np.int64), c, True))
                else:
                    held = np.concatenate([held[0], c]), np.concatenate([held[1], k])
            yield rows(out)
        out = []
        close(held, out)
        yield rows(out)

    return work


def _level(level: DataFrame, limit: int, hot: int, agree: int) -> DataFrame:
    """(a, b, big) of one level.  One shuffle, by node, of five numbers a row.

    Hot nodes are found first on a fixed share of the classes (which only routes: a node taken for hot branches, and
    what is small after that is compared there); there are at most rows / hot of them, so their list is small.
    """
    share = level.where(F.pmod(F.xxhash64("cid"), F.lit(_SAMPLED)) == 0)
    hot_nodes = share.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > hot // _SAMPLED).select("node")
    hot_nodes = materialize(hot_nodes, "p3-hot")
    schema = "a bigint, b bigint, big boolean"
    if hot_nodes.isEmpty():
        return level.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(_met(limit, agree), schema)
    cold = level.join(hot_nodes, "node", "left_anti")
    passed = level.join(hot_nodes, "node", "left_semi").select(F.col("node").alias("a"), F.col("cid").alias("b"), F.lit(True).alias("big"))
    return cold.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(_met(limit, agree), schema).unionByName(passed)


def _blocked(big: DataFrame, block: int, agree: int) -> DataFrame:
    """(a, b): every pair of classes in a node of ``big`` whose sketches agree, exactly; each task meets one pair of blocks."""
    sizes = big.groupBy("node").agg(F.ceil(F.count("*") / block).alias("_nb"))
    b = big.join(sizes, "node").withColumn("_b", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("_nb")))
    left = b.select("node", F.col("_b").alias("_x"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_y"), *_CLASS)
    right = b.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_x"), F.col("_b").alias("_y"), *_CLASS)
    right = right.toDF("_l", "_p", "_q", *(f"_{c}" for c in _CLASS))

    def rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        cid, *k = (c.to_numpy() for c in t.combine_chunks().columns[3:])
        once = np.unique(cid, return_index=True)[1]
        return cid[once], np.stack([c[once] for c in k], 1).view(np.uint8)

    def meet(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        (a, x), (c, y) = rows(p), rows(q)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i in range(len(a)):  # within one block, each pair once
            j = np.flatnonzero((y[i + 1 :] == x[i]).sum(1) >= agree) + i + 1 if key[1] == key[2] else np.flatnonzero((y == x[i]).sum(1) >= agree)
            out.append((np.full(len(j), a[i]), c[j]))
        a, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": np.minimum(a, c), "b": np.maximum(a, c)})

    return left.groupBy("node", "_x", "_y").cogroup(right.groupBy("_l", "_p", "_q")).applyInArrow(meet, "a bigint, b bigint")


def candidates(classes: DataFrame, threshold: float, limit: int = LIMIT, max_depth: int = MAX_DEPTH, hot: int = HOT) -> DataFrame:
    """Distinct (a, b), a before b, of the class numbers that met in a node of some tree."""
    roots = classes.select(*_CLASS, F.posexplode(F.slice("sig", 1, TREES * BRANCHES)).alias("_p", "_t"))
    level = roots.select(_numbered(F.xxhash64("_p", "_t"), F.floor(F.col("_p") / BRANCHES)).alias("node"), *_CLASS)
    found = []
    for depth in range(1, max_depth + 1):
        met = materialize(_level(level, limit, hot, least_agreement(threshold)), "p3-met")
        found.append(met.where("NOT big").select("a", "b"))
        big = met.where("big").select(F.col("a").alias("node"), F.col("b").alias("cid"))
        if big.isEmpty():
            break
        if depth == max_depth:
            found.append(_blocked(big.join(classes.select(*_CLASS), "cid"), max(limit, BLOCK), least_agreement(threshold)))
        else:
            level = _children(big.join(classes.select(*_CLASS, "sig"), "cid"))
    return reduce(DataFrame.unionByName, found).distinct()


_BLOOM_BITS = 1 << 25
#: Representatives that the filter tells apart: at eight bits each, it lets one text in twenty through in vain.
BLOOM_MOST = _BLOOM_BITS // 8


def _bits(ids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in ids], np.uint64)
    return (h % np.uint64(_BLOOM_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(_BLOOM_BITS)).astype(np.int64)


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (4 MB, whatever the data) of a column of ids, built where the ids are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BLOOM_BITS, bool)
        for b in batches:
            for at in _bits(b[0].to_pylist()):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    total = np.zeros(_BLOOM_BITS // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(work, "bits binary").toLocalIterator():  # at most 8 rows of 4 MB
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def similar_classes(
    df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int = 5, min_words: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between class keys at or above the threshold; members (cls, id) of every class.

    Pairs within a class are implied (similarity 1) and not expanded.
    """
    sk = materialize(sketches(df, id_col, text_col, shingle, min_words), "p3-sketch")
    members = sk.select("cls", "id").distinct()
    classes = materialize(sk.groupBy("cid").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("k0", "k1", "k2", "sig"))), "p3-class")
    cand = materialize(candidates(classes, threshold), "p3-pairs")
    # The sets of the classes in question are made again from their representatives' texts.  The Bloom filter picks the
    # texts where they lie, so no text is shuffled; what it lets through in vain meets no candidate in the joins.
    numbers = cand.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    reps = materialize(numbers.join(classes.select("cid", "rep"), "cid").select(F.col("rep").alias("id")), "p3-reps")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    by_filter = reps.count() <= BLOOM_MOST
    if not by_filter:  # more than the filter can tell apart: the texts are picked by a join
        texts = texts.join(reps, "id", "left_semi")
    picked = df.sparkSession.sparkContext.broadcast(bloom(reps) if by_filter else None)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _Hashes(), None if picked.value is None else np.unpackbits(picked.value).view(bool)
        with np.errstate(over="ignore"):
            for b in batches:
                column = b[1]
                if bits is not None:
                    x, y = _bits(b[0].to_pylist())
                    column = column.filter(pa.array(bits[x] & bits[y]))
                s = [shingle_set(t, hashes, shingle, min_words) for t in column.to_pylist()]
                s = [x for x in s if x is not None]
                keys = [keys_of(x) for x in s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for _, c in keys], pa.int64()), pa.array([k for k, _ in keys], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], ["cid", "cls", "items"]
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = []
            for x, y in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    sim.append(0.0)
                else:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    sim.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    whole = materialize_by(texts.mapInArrow(sets, "cid bigint, cls binary, items binary").dropDuplicates(["cid", "cls"]), "cid", "p3-sets")
    x = whole.select(F.col("cid").alias("a"), F.col("cls").alias("p"), F.col("items").alias("x"))
    y = whole.select(F.col("cid").alias("b"), F.col("cls").alias("q"), F.col("items").alias("y"))
    met = cand.join(x, "a").join(y, "b").select("p", "q", "x", "y")
    links = met.mapInArrow(verify, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold)
    return links, members


#: Copies of a class that one row of the expansion meets at most on either side.
COPIES = 1000


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) ids of all similar pairs, the copies within each class included; a before b.

    The result has a row a pair, so copies make it grow with their square; no task does: members are dealt into blocks of
    about COPIES by their hash, and a key of the joins is a class and a block.
    """
    sizes = materialize(members.groupBy("cls").agg(F.ceil(F.count("*") / COPIES).alias("nb")), "p3-sizes")
    dealt = members.join(sizes.where("nb > 1"), "cls", "left").select("cls", "id", F.when(F.col("nb").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("id"), F.col("nb"))).alias("k"))
    dealt = materialize(dealt, "p3-dealt")

    def blocks(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    of = lambda c, nb: sizes.select(F.col("cls").alias(c), F.col("nb").alias(nb))
    met = links.select("a", "b").join(of("a", "na"), "a").join(of("b", "nb"), "b")
    met = met.select("a", "b", blocks("na").alias("i"), "nb").select("a", "b", "i", blocks("nb").alias("j"))
    side = lambda c, k, x: dealt.select(F.col("cls").alias(c), F.col("k").alias(k), F.col("id").alias(x))
    across = met.join(side("a", "i", "x"), ["a", "i"]).join(side("b", "j", "y"), ["b", "j"])
    own = sizes.select(F.col("cls").alias("a"), blocks("nb").alias("i"), "nb")
    own = own.select("a", "i", F.explode(F.sequence(F.col("i"), F.col("nb") - 1)).alias("j")).withColumn("b", F.col("a"))
    copies = own.join(side("a", "i", "x"), ["a", "i"]).join(side("b", "j", "y"), ["b", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return across.select("x", "y").unionByName(copies.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def class_rows(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cls, copies, links): one row a document; ``copies`` are the members of its class, ``links`` the other documents it is similar to.

    Linear in the documents: a hot class is one number that its members are joined with.
    """
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.select(F.col("cls").alias("b"), F.col("copies").alias("n")), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("near"))
    per = sizes.join(near, "cls", "left").select("cls", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(per, "cls").select("id", F.lower(F.hex("cls")).alias("cls"), "copies", "links")
