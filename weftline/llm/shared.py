"""Helpers shared by the training-data operators: table access, lineage cuts, word hashing."""

from __future__ import annotations

import functools
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
STEP = 0x100000001B3
PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    made = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage. The files stay until the folder goes, or, with
    spark.cleaner.referenceTracking.cleanCheckpoints, until the driver lets go of df."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns used, under fixed names, so further columns can never clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix of an unsigned array."""
    x = (x ^ (x >> np.uint64(31))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=None)
def byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, 257, dtype=np.uint64) * MIX_B)


@functools.lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[1], np.full(n - 1, STEP)]).astype(np.uint64), dtype=np.uint64)


@functools.lru_cache(maxsize=None)
def classes(extra: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Tables over bytes: lower case of A-Z only; True for the separators (ASCII white space and extra)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[*range(9, 14), 32, *extra]] = True
    return lower, space


def word_hashes(texts: list[bytes], extra: bytes = b"", prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the lower-cased words of all texts, the word offsets of each text (one more than texts), and
    hashes of the words' first bytes for each length in prefixes. Bytes are looked at PIECE at a time, words of any length."""
    lower, space = classes(extra)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, sizes, sums = [], [], [[] for _ in (0, *prefixes)]
    open_ = 0  # bytes so far of a word that a piece has cut
    with np.errstate(over="ignore"):
        for a in range(0, len(buf), PIECE):
            piece = buf[a : a + PIECE]
            at = np.flatnonzero(~space[piece])
            if len(at):
                first = np.flatnonzero(np.diff(at, prepend=-5) > 1)
                lengths = np.diff(first, append=len(at))
                place = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
                each = byte_values()[lower[piece[at]]] * powers(1 << max(8, int(lengths.max()).bit_length()))[place]
                own = [np.add.reduceat(each, first)] + [np.add.reduceat(np.where(place < n, each, np.uint64(0)), first) for n in prefixes]
                begun = at[first] + a
                if open_ and at[0] == 0:  # the rest of the word before
                    rest = [np.where(place[: lengths[0]] + open_ < n, each[: lengths[0]], np.uint64(0)).sum(dtype=np.uint64) for n in prefixes]
                    for column, more in zip(sums, [own[0][0], *rest]):
                        column[-1][-1] += more * np.uint64(pow(STEP, open_, 1 << 64))
                    sizes[-1][-1] += lengths[0]
                    own, begun, kept = [x[1:] for x in own], begun[1:], lengths[1:]
                else:
                    kept = lengths
                if len(kept):
                    starts.append(begun)
                    sizes.append(kept)
                    for column, x in zip(sums, own):
                        column.append(x)
            open_ = int(sizes[-1][-1]) if len(at) and at[-1] == len(piece) - 1 else 0
        if not starts:
            none = np.zeros(0, dtype=np.uint64)
            return none, np.zeros(len(texts) + 1, dtype=np.int64), *(none for _ in prefixes)
        whole, *heads = (np.concatenate(x) for x in sums)
        h = mixed(whole + np.concatenate(sizes).astype(np.uint64) * MIX_A)
        return h, np.searchsorted(np.concatenate(starts), begins), *(mixed(x + np.uint64(n)) for x, n in zip(heads, prefixes))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(30))) * MIX_A + words[k : k + m]
        return mixed(out)


def encoded(batch_column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in batch_column.cast("binary").to_pylist()]


def portions(texts: list[bytes], most: int = 1 << 21):
    """(from, to) ranges of texts of about `most` bytes, so that arrays over bytes stay small; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
