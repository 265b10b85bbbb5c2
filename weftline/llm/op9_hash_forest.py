"""Nearest neighbours by a hash-prefix forest, largest inner product first.

Vectors are brought to one norm by an extra component (of zero for queries), so the angle orders like the inner product.
Each of `trees` trees gives every vector a hash string: SYMBOLS symbols, each the nearest of the 2 * AXES signed axes of a
rotation. A tree is a sorted array of these strings, cut at a prefix of `cut` bits into buckets of about `bucket` vectors
that lie in one task each. A query descends in `scouts` trees to its longest prefixes that `enough` vectors share; what it
finds there bounds its k nearest scores from below. From those and the chance that two vectors at an angle share a prefix
(measured once on random pairs) follows the expected recall for each prefix length, and the query ascends in all trees in
step, one bit at a time, until that reaches `recall`. At each length it also descends along its next-best symbols, up to
PROBES in all. Only queries that would have to ascend to the root (too little found to judge by, prefixes so short that the
trees together would be read `whole` times, or fewer than k found) are held against all rows, in blocks of `block` queries.

Buckets hold ids, strings and vectors of one byte a component; the `2 * k` best of a bucket that are not below the bound go
on, and the best of all trees are scored again from the vectors themselves. Shuffled: `trees` such rows a vector. Buckets
over `most` vectors or queries are dealt by a salt, part by part. Equal vectors are one class under the row of its smallest
id, of which only the `k` + 1 smallest ids can matter (ties go to smaller ids). Only norms, counts and blocks come to the driver.

Vectors that are null, zero, hold null or non-finite components, or differ in length from the longest (their product with
it is not defined), take no part; so do null ids. Rows with equal id and vector are one; an id with several vectors is
sought by and found by the best of them. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.shared import settle, table

AXES, SYMBOL, SYMBOLS = 32, 6, 8
BITS = SYMBOL * SYMBOLS
PROBES = 3
SENT_CLASSES = 50_000
#: Cosines at which shared prefixes are measured, on PAIRS random pairs each.
GRID, PAIRS = np.linspace(0, 1, 21), 96
HITS = "query_id long, rid long, score double"
ASKED = "query_id long, tree int, prefix long, deep int, floor float, rest long, scale float, code binary"


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Hashing:
    """Hash strings of one dimension and number of trees; the first symbol stands in the highest of BITS bits."""

    def __init__(self, dims: int, trees: int):
        rng = np.random.default_rng(20_240_229)
        axes = [rng.standard_normal((dims, AXES)) for _ in range(trees * SYMBOLS)]
        self.planes = np.concatenate([np.linalg.qr(a)[0] if dims >= AXES else a / np.sqrt(dims) for a in axes], axis=1).astype(np.float32)
        self.trees = trees

    def projected(self, x: np.ndarray, trees: int, symbols: int = SYMBOLS) -> np.ndarray:
        """(rows, trees, symbols, 2 * AXES): the components along all signed axes."""
        planes = self.planes.reshape(-1, self.trees, SYMBOLS, AXES)[:, :trees, :symbols].reshape(len(self.planes), -1)
        y = (x.astype(np.float32) @ planes).reshape(len(x), trees, symbols, AXES)
        return np.concatenate([y, -y], axis=3)

    def strings(self, x: np.ndarray, trees: int, symbols: int = SYMBOLS) -> np.ndarray:
        """(rows, trees) strings; symbols beyond the number asked for are zero."""
        out = np.zeros((len(x), trees), dtype=np.int64)
        for a in range(0, len(x), 512):
            best = self.projected(x[a : a + 512], trees, symbols).argmax(axis=3)
            for s in range(symbols):
                out[a : a + 512] |= best[:, :, s].astype(np.int64) << (BITS - SYMBOL * (s + 1))
        return out

    def branches(self, x: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols in order of nearness, what the choice of each costs against the first), PROBES + 1 of each symbol, and strings."""
        y = self.projected(x, trees)
        order = np.argsort(-y, axis=3)[..., : PROBES + 1]
        near = np.take_along_axis(y, order, 3)
        h = (order[..., 0].astype(np.int64) << (BITS - SYMBOL * np.arange(1, SYMBOLS + 1))).sum(axis=2)
        return order, near[..., :1] ** 2 - near**2, h

    @staticmethod
    def descents(order: np.ndarray, cost: np.ndarray, h: np.ndarray, deep: int) -> np.ndarray:
        """(rows, trees, PROBES) strings cut to `deep` bits: the own one, then those with the one symbol changed that costs least."""
        used = max(1, -(-deep // SYMBOL))
        n, trees = h.shape
        flat = cost[:, :, :used, 1:].reshape(n, trees, -1)
        cheap = np.argsort(flat, axis=2)[..., : PROBES - 1]
        symbol, rank = cheap // PROBES, cheap % PROBES + 1
        row, tree = np.arange(n)[:, None, None], np.arange(trees)[None, :, None]
        change = (order[row, tree, symbol, rank] ^ order[row, tree, symbol, 0]).astype(np.int64) << (BITS - SYMBOL * (symbol + 1))
        out = np.concatenate([h[..., None], h[..., None] ^ change], axis=2)
        return out >> (BITS - deep)


@functools.lru_cache(maxsize=2)
def hashing(dims: int, trees: int) -> Hashing:
    return Hashing(dims, trees)


def shares(dims: int, trees: int) -> np.ndarray:
    """[cosine of GRID, bits, probes - 1]: how often a vector is met in a tree at this angle, prefix length and number of descents."""
    rng, known = np.random.default_rng(7), hashing(dims, trees)
    a = rng.standard_normal((PAIRS, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((PAIRS, dims))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-30)
    found = known.branches(a, trees)
    out = np.ones((len(GRID), BITS + 1, PROBES))
    others = [known.strings(c * a + math.sqrt(max(0, 1 - c * c)) * b, trees) for c in GRID]
    for deep in range(1, BITS + 1):
        met = known.descents(*found, deep)
        for c, h in enumerate(others):
            same = np.maximum.accumulate(met == (h >> (BITS - deep))[..., None], axis=2)
            out[c, deep] = same.mean(axis=(0, 1))
    return np.maximum.accumulate(out, axis=0)


def steps(share: np.ndarray, cosines: np.ndarray, trees: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of cosines: the prefix length and the descents in each tree, fewest vectors first, that are expected to reach `recall`; 0 for the root."""
    deep, probes, least = np.zeros(len(cosines), dtype=int), np.ones(len(cosines), dtype=int), np.full(len(cosines), np.inf)
    at = np.clip(cosines, 0, 1) * (len(GRID) - 1)
    low = np.minimum(at.astype(int), len(GRID) - 2)
    part = at - low
    for d in range(1, share.shape[1]):
        for p in range(share.shape[2]):
            met = share[low, d, p] * (1 - part) + share[low + 1, d, p] * part
            better = ((1 - (1 - met) ** trees).mean(axis=1) >= recall) & ((p + 1) / 2.0**d < least)
            deep[better], probes[better], least[better] = d, p + 1, (p + 1) / 2.0**d
    return deep, probes


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One signed byte a component, and the scale of each row."""
    scale = np.maximum(np.abs(v).max(axis=1), 1e-300) / 127
    return np.round(v / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def kind_of_row(dims: int) -> np.dtype:
    return np.dtype([("rid", "<i8"), ("rest", "<u4"), ("scale", "<f4"), ("code", "i1", (dims,))])


def tail(h: np.ndarray, cut: int) -> np.ndarray:
    """The 32 bits of a string behind the bucket's prefix, so far as there are any."""
    left = (h.astype(np.uint64) << np.uint64(64 - BITS)) << np.uint64(cut)
    return (left >> np.uint64(32)).astype(np.uint32)


def in_bucket(rests: np.ndarray, rest: np.ndarray, inner: np.ndarray, enough: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each query the slice of the sorted array that shares `inner` bits behind the cut; fewer where it holds under `enough`."""
    while True:
        free = np.uint64(32) - inner.astype(np.uint64)
        low = rest.astype(np.uint64) >> free << free
        lo, hi = np.searchsorted(rests, low), np.searchsorted(rests, low + (np.uint64(1) << free) - np.uint64(1), "right")
        short = (hi - lo < enough) & (inner > 0)
        if not short.any():
            return lo, hi
        inner = np.where(short, inner - 1, inner)


def search(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 12, scouts: int = 2, bucket: int = 1024, enough: int = 256, recall: float = 0.93, whole: float = 4.0, most: int = 8192, block: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. is_query is an expression over the column vec_id.
    The number of queries, and of those held against all rows, is added to `report`."""
    spark = vectors.sparkSession
    column = F.col(f"`{vector_col}`")
    exact_type = vectors.select(column.alias("v")).schema["v"].dataType.simpleString()
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (column if exact_type == "array<float>" else column.cast("array<double>")).alias("v"))
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    raw = raw.where(F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", wrong))
    dims = raw.agg(F.max(F.size("v"))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    rows = settle(raw.where(F.size("v") == dims).select("vec_id", "v", F.monotonically_increasing_id().alias("rid"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")))
    # Norms relative to the largest component, so that squares neither vanish nor overflow.
    top = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("m"), F.count(F.lit(1)).alias("n")).first()
    unit = float(top.m)
    limit = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") / unit) * (x.cast("double") / unit)))).first()[0])
    cut = max(0, min(16, round(math.log2(max(1, top.n / bucket)))))
    # Classes of equal vectors with more than one row: the row that stands for each, and the ids that can matter.
    same = rows.groupBy("k1", "k2", "vec_id").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("c"))
    several = same.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "rid")).alias("rep"), F.sum("c").alias("c")).where("c > 1").select("k1", "k2", F.col("rep.rid").alias("rep"))
    place = F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id"))
    lists = same.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    several = settle(several.join(lists, ["k1", "k2"]))
    # Sent to all tasks up to SENT_CLASSES (of at most k + 1 ids each), so that vectors are not shuffled for them; joined beyond.
    several = F.broadcast(several) if several.limit(SENT_CLASSES + 1).count() <= SENT_CLASSES else several
    index = rows.join(several, ["k1", "k2"], "left").where("rep is null or rep = rid").select("rid", "vec_id", "v", "members")
    queries = rows.where(is_query).groupBy("k1", "k2", F.col("vec_id").alias("query_id")).agg(F.first("v").alias("v")).select("query_id", "v")
    known_dims, symbols = dims + 1, max(1, -(-cut // SYMBOL))

    def lifted(v: np.ndarray, query: bool) -> np.ndarray:
        v = v / unit
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, limit - (v * v).sum(axis=1)))
        return np.column_stack([v, extra])

    def counted(batches):
        for batch in batches:
            h = hashing(known_dims, trees).strings(lifted(matrix(batch.column(0), dims), False), trees, symbols) >> (BITS - cut)
            for t in range(trees):
                prefix, n = np.unique(h[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, dtype=np.int32)), pa.array(prefix), pa.array(n)], ["tree", "prefix", "n"])

    sizes = index.select("v").mapInArrow(counted, "tree int, prefix long, n long").groupBy("tree", "prefix").agg(F.sum("n").alias("n"))
    crowded = settle(sizes.where(F.col("n") > most).select("tree", "prefix", F.ceil(F.col("n") / most).cast("int").alias("vp")))

    def shelved(first: int):
        """Blobs of rows of one bucket in the first trees."""

        def run(batches):
            for batch in batches:
                v = matrix(batch.column(1), dims)
                if not len(v):
                    continue
                h = hashing(known_dims, trees).strings(lifted(v, False), first)
                code, scale = coded(v / unit)
                out = ([], [], [])
                for t in range(first):
                    item = np.zeros(len(v), dtype=kind_of_row(dims))
                    item["rid"], item["rest"], item["scale"], item["code"] = batch.column(0).to_numpy(), tail(h[:, t], cut), scale, code
                    prefix = h[:, t] >> (BITS - cut)
                    order = np.argsort(prefix, kind="stable")
                    prefix, item = prefix[order], item[order]
                    starts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
                    for a, b in zip(starts, np.append(starts[1:], len(v))):
                        for x, value in zip(out, (t, int(prefix[a]), item[a:b].tobytes())):
                            x.append(value)
                for a in range(0, len(out[0]), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 2048], kind) for x, kind in zip(out, (pa.int32(), pa.int64(), pa.binary()))], ["tree", "prefix", "items"])

        return index.select("rid", "v").mapInArrow(run, "tree int, prefix long, items binary")

    def asked_rows(ids, v, strings_at, deep, floors):
        """Arrow rows of ASKED: strings_at are (row, tree, prefix at `deep`, whole string)."""
        code, scale = coded(v / unit)
        row, tree, prefix, h = strings_at
        blobs = [c.tobytes() for c in code]
        for a in range(0, len(row), 4096):
            r = row[a : a + 4096]
            columns = [ids[r], tree[a : a + 4096].astype(np.int32), prefix[a : a + 4096], deep[r].astype(np.int32), floors[r].astype(np.float32), tail(h[a : a + 4096], cut).astype(np.int64), scale[r]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array([blobs[i] for i in r], pa.binary())], [x.split()[0] for x in ASKED.split(", ")])

    def scouted(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                v = matrix(piece.column(1), dims)
                order, cost, h = hashing(known_dims, trees).branches(lifted(v, True), scouts)
                met = Hashing.descents(order, cost, h, BITS)[..., :2] if cut else h[..., None]
                row, tree, _ = np.indices(met.shape)
                n = len(v)
                yield from asked_rows(piece.column(0).to_numpy(), v, (row.ravel(), tree.ravel(), met.ravel() >> (BITS - cut), met.ravel()), np.full(n, BITS), np.full(n, -np.inf))

    def matched(limit_to: int, share_enough: int):
        def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
            out = ([], [], [])
            if left.num_rows and right.num_rows:
                items = np.frombuffer(b"".join(right["items"].to_pylist()), dtype=kind_of_row(dims))
                items = items[np.argsort(items["rest"], kind="stable")]
                rids, v = items["rid"].copy(), items["code"].astype(np.float32) * items["scale"][:, None]
                ids, floors = left["query_id"].to_numpy(), left["floor"].to_numpy()
                q = np.frombuffer(b"".join(left["code"].to_pylist()), dtype=np.int8).reshape(-1, dims).astype(np.float32) * left["scale"].to_numpy()[:, None]
                inner = np.clip(left["deep"].to_numpy().astype(np.int64) - cut, 0, 32)
                lo, hi = in_bucket(items["rest"], left["rest"].to_numpy().astype(np.uint32), inner, share_enough)
                order = np.lexsort((hi, lo))
                starts = np.flatnonzero(np.append(True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])))
                for a, b in zip(starts, np.append(starts[1:], len(order))):
                    for c in range(a, b, 256):
                        own = order[c : min(b, c + 256)]
                        s = q[own] @ v[lo[own[0]] : hi[own[0]]].T
                        for i, line in zip(own, s):
                            some = np.flatnonzero(line >= floors[i])
                            some = some[nearest(line[some], rids[lo[i] + some], limit_to)]
                            out[0].append(np.full(len(some), ids[i]))
                            out[1].append(rids[lo[i] + some])
                            out[2].append(line[some].astype(np.float64))
            columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
            return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64))], ["query_id", "rid", "score"])

        return run

    def met(asked: DataFrame, first: int, limit_to: int, share_enough: int = 0) -> DataFrame:
        """Hits of queries in their buckets, both dealt by a salt where a bucket is crowded with vectors or with queries."""
        many = settle(asked.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("tree", "prefix", F.ceil(F.col("n") / most).cast("int").alias("qp")))
        salts = lambda df: df.join(crowded, ["tree", "prefix"], "left").join(many, ["tree", "prefix"], "left").withColumn("vp", F.coalesce("vp", F.lit(1))).withColumn("qp", F.coalesce("qp", F.lit(1)))
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        key = ["tree", "prefix", "vs", "qs"]
        shelves = salts(shelved(first)).withColumn("vs", F.pmod(F.xxhash64("items"), F.col("vp")).cast("int")).withColumn("qs", every("qp")).select(*key, "items")
        q_side = salts(asked).withColumn("qs", F.pmod(F.xxhash64("query_id"), F.col("qp")).cast("int")).withColumn("vs", every("vp")).select(*key, *[x.split()[0] for x in ASKED.split(", ") if x.split()[0] not in key])
        shelves, q_side = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (shelves, q_side))  # of own attributes
        return q_side.groupBy(*key).cogroup(shelves.groupBy(*key)).applyInArrow(matched(limit_to, share_enough), HITS)

    asked_first = queries.mapInArrow(scouted, ASKED)
    seen = met(asked_first, scouts, k + 1, enough).groupBy("query_id").agg(F.collect_list(F.struct("score", "rid")).alias("seen"))
    share = shares(known_dims, trees)
    slack = 0.08 / math.sqrt(dims)

    def ascending(batches):
        """Rows of ASKED for the second descent; a tree of -1 marks queries for the root."""
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                v, ids = matrix(piece.column(1), dims), piece.column(0).to_numpy()
                norm = np.maximum(np.linalg.norm(v / unit, axis=1) * math.sqrt(limit), 1e-300)
                best = np.full((len(v), k + 1), -np.inf)
                for i, found in enumerate(piece.column(2).to_pylist()):
                    own = sorted({x["rid"]: x["score"] for x in found or ()}.values(), reverse=True)[: k + 1]
                    best[i, : len(own)] = own
                cosines = np.where(np.isfinite(best), best / norm[:, None], 0)
                deep, probes = steps(share, cosines[:, 1:], trees, recall)
                known = np.isfinite(best[:, -1]) & (deep > 0) & (trees * probes < whole * 2.0**deep)
                floors = best[:, -1] - slack * norm
                order, cost, h = hashing(known_dims, trees).branches(lifted(v, True), trees)
                found = ([], [], [], [])
                for d in np.unique(deep[known]).tolist():
                    at = np.flatnonzero(known & (deep == d))
                    prefix = Hashing.descents(order[at], cost[at], h[at], d)
                    r, t, p = np.nonzero(np.arange(PROBES)[None, None, :] < probes[at][:, None, None] * np.ones((1, trees, 1)))
                    chosen = prefix[r, t, p]
                    fresh = np.unique(np.stack([r, t, chosen]), axis=1)
                    r, t, chosen = fresh
                    if d < cut:  # a prefix shorter than the cut names several buckets
                        r, t, chosen = (np.repeat(x, 1 << (cut - d)) for x in (r, t, chosen))
                        chosen = (chosen << (cut - d)) + np.tile(np.arange(1 << (cut - d)), len(chosen) >> (cut - d))
                    full = chosen << (BITS - max(d, cut))
                    for x, value in zip(found, (at[r], t, full >> (BITS - cut), full)):
                        x.append(value)
                root = np.flatnonzero(~known)
                for x, value in zip(found, (root, np.full(len(root), -1), np.zeros(len(root), dtype=np.int64), np.zeros(len(root), dtype=np.int64))):
                    x.append(value)
                yield from asked_rows(ids, v, [np.concatenate(x) for x in found], deep, floors)

    def scored(batches):
        for batch in batches:
            s = (matrix(batch.column(1), dims) * matrix(batch.column(2), dims)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), batch.column(3), batch.column(4)], ["query_id", "score", "vec_id", "members"])

    def ranked(hits: DataFrame) -> DataFrame:
        """The best by codes, then by the vectors themselves; the members of a class stand in for its row."""
        by_code = W.partitionBy("query_id").orderBy(F.desc("score"), "rid")
        best = hits.groupBy("query_id", "rid").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= 2 * k + 8)
        pairs = best.select("query_id", "rid").join(index, "rid").join(queries.withColumnRenamed("v", "q"), "query_id")
        exact = pairs.select("query_id", "q", "v", "vec_id", "members").mapInArrow(scored, "query_id long, score double, vec_id long, members array<long>")
        each = exact.select("query_id", "score", F.explode(F.coalesce("members", F.array("vec_id"))).alias("vec_id")).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    second = settle(queries.join(seen, "query_id", "left").select("query_id", "v", "seen").mapInArrow(ascending, ASKED))
    found = settle(ranked(met(second.where("tree >= 0"), trees, 2 * k)))
    # Queries that came to the root, or found fewer than k, are held against all rows.
    full = found.where(F.col("rank") == k).select("query_id")
    rest = settle(queries.join(full, "query_id", "left_anti"))
    left = rest.count()
    if report is not None:
        report += [queries.count(), left]
    found = found.join(full, "query_id", "left_semi") if left else found
    blocks = -(-left // block)
    for b in range(blocks):
        part = rest.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part["query_id"].to_numpy(), matrix(part["v"], dims) / unit))

        def scanned(batches, sent=sent):
            ids, q = sent.value
            for batch in batches:
                rids, v = batch.column(0).to_numpy(), matrix(batch.column(1), dims) / unit
                for a in range(0, len(q), 1024):
                    s = q[a : a + 1024] @ v.T
                    some = [nearest(row, rids, 2 * k) for row in s]
                    at = np.concatenate(some)
                    who = np.repeat(np.arange(len(some)), [len(x) for x in some])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + who]), pa.array(rids[at]), pa.array(s[who, at])], ["query_id", "rid", "score"])

        found = found.unionByName(ranked(index.select("rid", "v").mapInArrow(scanned, HITS)))
    return found


def op9_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
