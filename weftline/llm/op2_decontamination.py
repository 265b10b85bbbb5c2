"""Benchmark decontamination by spaced-seed hashing.

A fixed mask over word positions hashes the words at its ones and ignores those at its zeros, so a substituted word at a
zero does not hide a hit. Seeds of the benchmark are joined with seeds at every position of every document; each hit
names a diagonal (document place minus item place), on which the overlap is verified word by word: a segment must hold
`min_words` equal words at a share of `min_share`. That is the best segment under +1 for an equal and -3 for a differing
word where it does, else the one of most equal words at that share. With ten words and a share of 0.8 the masks together
hit every such segment, whatever its substitutions (a test goes through all), so the result is that of all diagonals.
Items shorter than the masks get one mask of their own length and must stand in the document word for word; those of
under `least` words, which chance may bring about, must be all of it.

The benchmark is cut into blocks of about `block_mb` MB by hashed text. Block by block, its sorted seeds are sent to all
tasks, every document meets it, overlaps are written and the block is let go, so any benchmark size is exact and what is
held is one block. Documents are not shuffled but by what overlaps: overlaps, which depend on the text only, come back
under its two hashes. Hits are expanded `most` at a time, and not for items that a document is known to hold whole.

Null or empty texts and items without words match nothing. Items without an id are searched and named null. Items of equal
text count as one, under the smallest item_id. Repeated documents and null ids pass through, one result for each row. An
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.op7_quality import PUNCTUATION
from weftline.llm.shared import MIX_A, encoded, ids_and_text, mixed, portions, settle, table, word_hashes

MASKS = ("110111", "11101011", "110110101", "1011001101", "11110011")
#: Overlaps up to this many (some 10 MB) are sent to all tasks, and joined beyond.
SENT_ENTRIES = 200_000
HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int64()), ("words", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64())]))
HITS_DDL = "array<struct<item_id:long,matched:long,words:long,doc_start:long,item_start:long>>"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    m = len(words) - len(mask) + 1
    if m < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(m, len(mask), dtype=np.uint64)
        for k, one in enumerate(mask):
            if one == "1":
                out = (out ^ (out >> np.uint64(30))) * MIX_A + words[k : k + m]
        return mixed(out)


def best_segment(equal: np.ndarray, penalty: int = 3) -> tuple[int, int]:
    """[from, to) of the segment with the largest sum of +1 and -penalty; the first of those."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -penalty))])
    gain = total - np.minimum.accumulate(total)
    to = int(gain.argmax())
    return int(total[: to + 1].argmin()), to


def widest_segment(equal: np.ndarray, share: float) -> tuple[int, int]:
    """[from, to) of the segment with most equal words at a share of at least `share`, without a differing word at its ends."""
    held = np.concatenate([[0], np.cumsum(equal)])
    over = held - share * np.arange(len(held))
    lo = np.searchsorted(-np.minimum.accumulate(over), -(over + 1e-9))  # the first start from which each end holds the share
    to = int((held - held[lo]).argmax())
    start = int(lo[to])
    return start + int(equal[start:to].argmax()) if to > start else start, to


class Seeds:
    """Sorted seeds of a block of items for each mask, and the items' words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        texts = [(t or "").encode() for _, t in items]
        words, at = word_hashes(texts, PUNCTUATION)
        self.ids = [i for i, _ in items]
        self.words = [words[a:b] for a, b in zip(at, at[1:])]
        longest = max(map(len, MASKS))
        by: dict[str, list[tuple[np.ndarray, int]]] = {}
        for n, own in enumerate(self.words):
            for mask in MASKS if len(own) >= longest else ["1" * len(own)] * bool(len(own)):
                by.setdefault(mask, []).append((seeds(own, mask), n))
        self.masks = {}
        for mask, found in by.items():
            h = np.concatenate([x for x, _ in found])
            item = np.concatenate([np.full(len(x), n) for x, n in found])
            place = np.concatenate([np.arange(len(x)) for x, _ in found])
            order = np.argsort(h, kind="stable")
            table_ = np.zeros(1 << 20, dtype=bool)
            table_[h >> np.uint64(44)] = True
            self.masks[mask] = (h[order], item[order], place[order], table_)

    def hit(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For texts whose words lie at the offsets `at`: whether any seed, perhaps one across two texts, hits."""
        places = [np.zeros(0, dtype=np.int64)]
        for mask, (h, _, _, quick) in self.masks.items():
            own = seeds(words, mask)
            near = np.flatnonzero(quick[own >> np.uint64(44)])
            found = np.searchsorted(h, own[near])
            places.append(near[h[np.minimum(found, len(h) - 1)] == own[near]])
        out = np.zeros(len(at) - 1, dtype=bool)
        out[np.searchsorted(at, np.concatenate(places), "right") - 1] = True
        return out

    def diagonals(self, words: np.ndarray, done=frozenset(), most: int = 1 << 20):
        """Distinct (places of item 0 in words, items) with a hit under any mask, from about `most` hits at a time; without the items that `done` has by then."""
        for mask, (h, item, place, quick) in self.masks.items():
            own = seeds(words, mask)
            at = np.flatnonzero(quick[own >> np.uint64(44)])
            lo, hi = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
            total = np.cumsum(hi - lo)
            for a in range(0, int(total[-1]) if len(total) else 0, most):
                x, z = np.searchsorted(total, [a, a + most], "right")
                n = (hi - lo)[x : z + 1]
                if n.sum():
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[x : z + 1], n)
                    near = np.stack([np.repeat(at[x : z + 1], n) - place[k], item[k]])
                    if done:
                        near = near[:, ~np.isin(near[1], [*done])]
                    yield np.unique(near, axis=1)

    def overlaps(self, words: np.ndarray, min_words: int, min_share: float, least: int) -> list[dict]:
        """The verified overlaps; one for each item, that with most equal words, the first of those in the document."""
        best: dict[int, dict] = {}
        whole: set[int] = set()
        for near in self.diagonals(words, whole):
            for start, n in zip(*near.tolist()):
                own = self.words[n]
                if n in whole and start >= best[n]["doc_start"] - best[n]["item_start"] or len(own) < least and len(words) != len(own):
                    continue
                a, b = max(0, -start), min(len(own), len(words) - start)
                equal = own[a:b] == words[start + a : start + b]
                need = min(min_words, len(own))
                lo, hi = best_segment(equal)
                matched = int(equal[lo:hi].sum())
                if matched < need or matched < min_share * (hi - lo):
                    lo, hi = widest_segment(equal, min_share)
                    matched = int(equal[lo:hi].sum())
                found = {"item_id": self.ids[n], "matched": matched, "words": hi - lo, "doc_start": start + a + lo, "item_start": a + lo}
                if matched >= need and (n not in best or (-matched, found["doc_start"]) < (-best[n]["matched"], best[n]["doc_start"])):
                    best[n] = found
                    if matched == len(own):
                        whole.add(n)
        return [best[n] for n in sorted(best)]


def overlapping(sent, min_words: int, min_share: float, least: int):
    """From batches of text: rows of two hashes of a text and its overlaps with one block of items, where it has any."""

    def found(batches):
        for batch in batches:
            known, texts = sent.value, encoded(batch.column(2))
            rows = []
            for a, z in portions(texts):
                words, at = word_hashes(texts[a:z], PUNCTUATION)
                for k, hit in enumerate(known.hit(words, at)):
                    if hit and (own := known.overlaps(words[at[k] : at[k + 1]], min_words, min_share, least)):
                        rows.append((a + k, own))
            which = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array([x for _, x in rows], HITS)], ["t1", "t2", "found"])

    return found


def overlaps_with(texts: DataFrame, benchmark: DataFrame, min_words: int = 10, min_share: float = 0.8, least: int = 4, block_mb: float = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame | None:
    """(t1, t2, overlaps) for the texts (t1, t2, text) that overlap an item; None where there are no items."""
    spark = benchmark.sparkSession
    items = ids_and_text(benchmark, id_col, text_col).where("text is not null").groupBy("text").agg(F.min("doc_id").alias("item_id"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // int(block_mb * 1e6)))
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        rows = sorted(((i, t) for t, i in block.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            sent = spark.sparkContext.broadcast(Seeds(rows))
            parts.append(settle(texts.mapInArrow(overlapping(sent, min_words, min_share, least), f"t1 long, t2 long, found {HITS_DDL}")))
            sent.unpersist()
    if not parts:
        return None
    # Texts are told apart by both hashes; those that occur twice count once.
    once = reduce(DataFrame.unionAll, [p.dropDuplicates(["t1", "t2"]) for p in parts])
    return once.groupBy("t1", "t2").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("overlaps"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """row (struct of all input columns), doc_id, overlaps (by item_id, null first), contaminated for each row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    source = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), *keys)
    found = overlaps_with(docs.select(*keys, text.alias("text")), benchmark, **options)
    none = F.array().cast(HITS_DDL)
    if found is None:
        return source.select("row", "doc_id", none.alias("overlaps"), F.lit(False).alias("contaminated"))
    found = settle(found)
    entries = found.agg(F.sum(F.size("overlaps"))).first()[0] or 0
    done = source.join(F.broadcast(found) if entries <= SENT_ENTRIES else found, ["t1", "t2"], "left").select("row", "doc_id", F.coalesce("overlaps", none).alias("overlaps"))
    return done.withColumn("contaminated", F.size("overlaps") > 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "contaminated", F.size("overlaps").cast("long").alias("n_items"), F.transform("overlaps", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda x: x["matched"])), F.lit(0)).cast("long").alias("most_matched"),
    )
