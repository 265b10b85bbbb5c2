"""Exact n-gram Jaccard join in a metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

Distances are 1 - Jaccard; a link is a distance of at most t. A pivot that is a document is no help for the mass of
documents, which lie at distance 1 from nearly all others, so the first level takes every shingle as a pivot of one
element. A document's nearest such pivots are its own shingles; ties go by one order of all shingles, rare ones first. By
the triangle inequality a partner within t lacks at most n - ceil((1 - t) n) of its shingles, so its window is that many
pivots and SHARED more, and partners meet in at least SHARED regions. The order comes from counts of all shingles of all
documents in a table of 2 ** BITS slots, whose size does not grow; wrong counts cost time only.

Within the regions the second level takes documents as pivots: each region's hub, whose shingles are the commonest, as
those of the original of a group of near copies are. Members are verified against it, and links to hubs join most members
of dense groups into components without pairs. Then regions that still hold several components are joined recursively:
members of different components whose sizes fit and whose verified distances to a common hub differ by at most t meet
pairwise and are verified. Pairs inside a component are never made; they cannot change it. All others with a link are.

Two documents of sizes n and m within t share a = ceil((1 - t) / (2 - t) * (n + m)) shingles, so of their windows at least
k = min(a - n + w_n, a - m + w_m), and the first j of these stand before place w - k + j of either window. Rows carry
their place, and documents meet only in regions that early: hubs and members in j = min(SHARED, k) of them, others in the
first (j = 1), whose windows as a whole must then share k. This is exact, and keeps the members of a large group of copies
apart where each has too much of its own.

Documents with equal sets are one class from the first shuffle on (a partition sends each once). Sets are never stored:
they are computed again from the texts of documents with candidates. Only the slot counts come to the driver.

Null texts and texts without words: an empty set, linked with nothing. Rows that share a doc_id are each a document under
that id. Null ids take part in classes but never name a component. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.shared import MIX_B, encoded, ids_and_text, mixed, portions, settle, shingle_hashes, table, word_hashes

BITS = 18
SHARED = 3
SLICES = 32
#: Ids of documents to fetch are sent to all tasks up to this many (8 bytes each), and joined beyond.
SENT_IDS = 400_000


def sets_of(texts: list[bytes], words: int):
    """Each text's sorted distinct shingle hashes."""
    for a, z in portions(texts):
        h, at = word_hashes(texts[a:z])
        for k in range(z - a):
            yield np.unique(shingle_hashes(h[at[k] : at[k + 1]], words))


def fingerprint(own: np.ndarray) -> int:
    """Of a set: order-free, 63 bits."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed(own ^ MIX_B).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0] >> np.uint64(1))


def summaries(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, f) of every row, and the levels of the slots: 0 to 255, growing with the count."""

    def counted(batches):
        counts = np.zeros(1 << BITS, dtype=np.uint32)
        for batch in batches:
            n, f = [], []
            for own in sets_of(encoded(batch.column(1)), words):
                np.add.at(counts, own >> np.uint64(64 - BITS), 1)
                n.append(len(own))
                f.append(fingerprint(own))
            m = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["doc_id", "n", "f", "part", "counts"])
        if counts.any():
            pieces = [p.tobytes() for p in np.minimum(counts, 65535).astype("<u2").reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64())] * 3 + [pa.array(range(SLICES), pa.int32()), pa.array(pieces, pa.binary())], ["doc_id", "n", "f", "part", "counts"])

    rows = settle(docs.mapInArrow(counted, "doc_id long, n long, f long, part int, counts binary"))

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(data, dtype="<u2").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    pieces = rows.where("part is not null").select("part", "counts").repartition(SLICES, "part").mapInArrow(summed, "part int, counts binary").collect()
    counts = np.zeros((SLICES, (1 << BITS) // SLICES), dtype=np.int64)
    for part, data in pieces:
        counts[part] = np.frombuffer(data, dtype="<i8")
    return rows.where("part is null").select("doc_id", "n", "f"), np.minimum(255, 8 * np.log2(1 + counts.ravel())).astype(np.uint8)


def windows(docs: DataFrame, levels: np.ndarray, words: int, num: int, den: int, shared: int) -> DataFrame:
    """(s, f, n, i, q): each class in the regions of its window's pivots, with its place there and the mean level of the
    class's shingles; once from each partition at most."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def placed(batches):
        rank, seen = sent.value, set()
        for batch in batches:
            s, f, n, i, q = [], [], [], [], []
            for own in sets_of(encoded(batch.column(1)), words):
                own_f = fingerprint(own)
                if not len(own) or own_f in seen:
                    continue
                seen.add(own_f)
                size = min(len(own), len(own) + num * len(own) // -den + shared)
                level = rank[own >> np.uint64(64 - BITS)]
                key = level.astype(np.uint64) << np.uint64(56) | mixed(own) >> np.uint64(8)
                first = np.argpartition(key, size - 1)[:size]
                s.append(own[first[np.argsort(key[first])]])
                f.append(np.full(size, own_f))
                n.append(np.full(size, len(own)))
                i.append(np.arange(size))
                q.append(np.full(size, int(100 * level.mean())))
            if s:
                columns = [np.concatenate(x).view(np.int64) for x in (s, f)] + [np.concatenate(x).astype(np.int32) for x in (n, i, q)]
                for a in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in columns], ["s", "f", "n", "i", "q"])

    return docs.mapInArrow(placed, "s long, f long, n int, i int, q int")


def meeting(num: int, den: int, shared: int):
    """Conditions on sizes and places of two rows of one region (see above), and the number of regions a pair must meet in."""

    def width(n):
        return F.least(n, n - F.ceil(n * num / den) + shared)

    def kept(n, m):
        a = F.ceil((n + m) * num / (num + den))
        return F.least(a - n + width(n), a - m + width(m))

    def meets(n, i, m, j, need=shared):
        early = F.least(F.lit(need), kept(n, m)) - kept(n, m)
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & (i < width(n) + early) & (j < width(m) + early)

    return meets, kept


def with_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(f, own): the sets of the classes in needed (f, doc_id), from their documents' texts; other texts under the same id are passed over."""
    few = needed.limit(SENT_IDS + 1).count() <= SENT_IDS
    chosen = docs.join(F.broadcast(needed) if few else needed, "doc_id").select("f", "text")

    def computed(batches):
        for batch in batches:
            own = [(f, x.tobytes()) for f, x in zip(batch.column(0).to_pylist(), sets_of(encoded(batch.column(1)), words)) if fingerprint(x) == f]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], ["f", "own"])

    return settle(chosen.mapInArrow(computed, "f long, own binary").dropDuplicates(["f"]))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union for each pair (a, b) of classes."""
    pairs = settle(pairs)
    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct().join(classes, "f"))
    sets = with_sets(docs, needed, words)
    both = pairs.join(sets.select(F.col("f").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("f").alias("b"), F.col("own").alias("y")), "b")

    def compared(batches):
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                total.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    return settle(both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, common long, total long"))


def jaccard_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for each row; documents link when den * intersection >= num * union."""
    docs = ids_and_text(docs, id_col, text_col)
    shared = max(1, min(SHARED, -(-num // max(1, den - num))))
    every, levels = summaries(docs, words)
    classes = settle(every.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"))
    meets, kept = meeting(num, den, shared)
    region = W.partitionBy("s")
    rows = windows(docs, levels, words, num, den, shared)
    hub = F.max(F.struct("q", "f")).over(region)
    pivot = rows.withColumn("pf", hub["f"]).withColumn("lo", F.min("f").over(region)).withColumn("hi", F.max("f").over(region)).where("lo <> hi").select("s", "f", "n", "i", "pf")
    regions = settle(pivot.distinct())
    hubs = regions.where("f = pf").select("s", F.col("n").alias("pn"), F.col("i").alias("pi"))
    stars = regions.where("f <> pf").join(hubs, "s").where(meets(F.col("n"), F.col("i"), F.col("pn"), F.col("pi"))).groupBy(F.col("pf").alias("a"), F.col("f").alias("b"), "pn", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.least(F.lit(shared), kept(F.col("n"), F.col("pn")))).select("a", "b")
    linked = F.col("common") * den >= F.col("total") * num
    first = verified(stars, docs, classes, words)
    roots = components(first.where(linked).select("a", "b"))
    # Recursion: in what regions still hold several components, across these, past what the pivots' distances rule out.
    named = regions.join(roots.select(F.col("node").alias("f"), "root"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    far = first.select(F.col("a").alias("pf"), F.col("b").alias("f"), (1 - F.col("common") / F.col("total")).alias("d"))
    named = named.join(far, ["pf", "f"], "left").withColumn("d", F.when(F.col("f") == F.col("pf"), F.lit(0.0)).otherwise(F.col("d")))
    mixed_ = named.withColumn("lo", F.min("root").over(region)).withColumn("hi", F.max("root").over(region)).where("lo <> hi").select("s", "f", "n", "i", "root", "d")
    open_ = settle(mixed_)
    left, right = open_.alias("l"), open_.alias("r")
    reach = (den - num) / den + 1e-9
    apart = F.coalesce(F.abs(F.col("l.d") - F.col("r.d")) > reach, F.lit(False)) | (F.coalesce(F.least("l.d", "r.d") == 0, F.lit(False)) & F.col("l.d").isNotNull() & F.col("r.d").isNotNull())
    pairs = left.join(right, F.col("l.s") == F.col("r.s")).where((F.col("l.f") < F.col("r.f")) & (F.col("l.root") != F.col("r.root")) & meets(F.col("l.n"), F.col("l.i"), F.col("r.n"), F.col("r.i"), 1) & ~apart)
    pairs = pairs.select(F.col("l.f").alias("a"), F.col("r.f").alias("b"), F.col("l.n").alias("n"), F.col("r.n").alias("m")).distinct()
    # Windows whole, not only their first places, must have k regions in common; a window's regions are as many as it is wide.
    lists = regions.groupBy("f").agg(F.collect_set("s").alias("own"))
    for x in "ab":
        pairs = pairs.join(lists.select(F.col("f").alias(x), F.col("own").alias(f"{x}s")), x)
    pairs = pairs.where(F.size(F.array_intersect("as", "bs")) >= kept(F.col("n"), F.col("m"))).select("a", "b")
    second = verified(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), docs, classes, words)
    whole = components(first.unionByName(second).where(linked).select("a", "b"))
    # A component is named by the smallest doc_id of its classes; a class without links stands for itself.
    least = classes.join(whole.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    names = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = least.select("f", "root", F.col("doc_id").alias("class_id")).join(names, "root").select("f", "class_id", "component_id")
    full = every.join(by_class, "f", "left")
    own = (F.col("n") == 0) | F.col("component_id").isNull()
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
