"""WARC round trip and validation; forest recall against brute force."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import op5_warc as op5
from weftline.llm.op9_hash_forest import Hashing, op9_hash_forest, search

SF = "/root/testdata/sf0.001"


def expected(rows, least=0):
    top = {}
    for p, h in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        first = top.get(h or "")
        same = len(b) < least or p == first
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else first))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://é/\r\nEvil: 1", None), (None, "u", "<p>x</p>"), (None, "u", "lone"), (7, "u", ""), (8, "u", "é\0\r\n\r\n" * 30_000), (8, "u", "é\0\r\n\r\n" * 30_000), (9, "u", "WARC/1.1\r\n\r\n")]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i % 30} " + "lorem ipsum dolor " * 20) for i in range(90)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    for least in (0, 20):
        folder = str(tmp_path / f"w{least}")
        made = op5.write_archives(df, folder, least).collect()
        assert sum(r.records for r in made) == len(rows)
        back = op5.read_archives(spark, folder).collect()
        assert sorted([tuple(r)[:5] for r in back], key=str) == expected([(p, h) for p, _, h in rows], least)
    uris = {r.page_id: r.target_uri for r in back}
    assert uris[2] == "about:blank" and "\n" in uris[3]
    archive = max((tmp_path / "w0").rglob("*.zst"), key=lambda p: p.stat().st_size).read_bytes()
    with pytest.raises(ValueError):
        list(op5.parsed(archive[:-3]))
    with pytest.raises(ValueError):
        list(op5.parsed(archive + b"abcd"))
    assert op5.write_archives(df.limit(0), str(tmp_path / "none")).count() >= 0


def test_dictionary_frame():
    import struct

    import zstandard

    words = op5.dictionary([b"<html><body>page %d with some words of text %d</body></html>" % (i, i * 7) * 20 for i in range(60)])
    assert words
    raw = op5.record(5, "http://a/", b"<html>hello</html>", op5.sha1_base32(b"<html>hello</html>"), None)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(raw)
    for stored in (words, zstandard.ZstdCompressor().compress(words)):
        data = struct.pack("<II", op5.SKIPPABLE, len(stored)) + stored + frame * 3
        assert [r[0] for r in op5.parsed(data)] == [5, 5, 5]
    with pytest.raises(ValueError):
        list(op5.parsed(frame))  # without its dictionary
    for broken in (raw.replace(b"hello", b"hallo"), raw.replace(b"Content-Length: ", b"Content-Length: 1", 1), raw[:-1], b"x" + raw):
        with pytest.raises(ValueError):
            op5.read_record(broken)
    lines = raw.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]
    for line in lines:
        if not line.startswith((b"WARC-Date", b"Content-Type")):
            with pytest.raises(ValueError):
                op5.read_record(raw.replace(line + b"\r\n", b"", 1))
    plain = zstandard.ZstdCompressor()
    for broken in (raw.replace(b"Content-Length: 18", b"X-Length: 18", 1), raw.replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(ValueError):
            list(op5.parsed(plain.compress(broken)))
    for cut in range(1, len(whole := plain.compress(raw))):
        with pytest.raises(ValueError):
            list(op5.parsed(whole[:cut]))


def test_archives_roll_over(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "".join(chr(97 + (i * k) % 26) for k in range(3000)) + str(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = tmp_path / "w"
    assert sum(r.records for r in op5.write_archives(df, str(folder), archive_mb=0.02).collect()) == 700
    assert len(list(folder.rglob("*.warc.zst"))) > 4 and all(p.stat().st_size < 90_000 for p in folder.rglob("*.warc.zst"))
    assert sorted((tuple(r)[:5] for r in op5.read_archives(spark, str(folder)).collect()), key=str) == expected([(p, h) for p, _, h in rows])


def test_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert sorted([tuple(r) for r in op5.op5_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str) == expected(rows)


def brute(ids, v, queries, k):
    out = {}
    for q in queries:
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def recall(got, want):
    return np.mean([len({x for x, _ in want[q]} & {x for x, _ in got.get(q, [])}) / max(1, len(want[q])) for q in want])


@pytest.mark.parametrize("block,most", [(20_000, 8192), (7, 60)])
def test_recall(spark, block, most):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    v = np.concatenate([centres[rng.integers(20, size=1200)] + 0.05 * rng.standard_normal((1200, 24)), rng.standard_normal((300, 24)) * rng.uniform(0.5, 2, (300, 1))])
    v[100:400] = v[100]  # a large class of equal vectors
    ids = rng.permutation(len(v))
    rows = [(int(i), [float(x) for x in r], 1) for i, r in zip(ids, v)]
    rows += [(90_000, None, 1), (90_020, [0.0] * 24, 1), (90_040, [1.0] * 23 + [None], 1), (90_060, [float("nan")] * 24, 1), (90_080, [float("inf")] * 24, 1), (None, [1.0] * 24, 1), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    found = search(df, F.col("vec_id") % 20 == 0, k=5, bucket=64, enough=48, block=block, most=most).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, v, np.flatnonzero(ids % 20 == 0), 5)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95 and all(len(x) == 5 for x in got.values())
    by = dict(zip(ids.tolist(), v))
    assert all(abs(s - by[q] @ by[i]) < 1e-9 for q, x in got.items() for i, s in x)


def test_whole_and_small(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float), np.flatnonzero(t.vec_id % 20 == 0), 20)
    got = {}
    for r in op9_hash_forest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, want) >= 0.9
    shape = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], shape), F.lit(True)).count() == 0
    few = search(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])], shape), F.col("vec_id") <= 2, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3)]


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_the_forest_answers(spark, kind):
    """Twenty thousand vectors: few queries go to all rows, and what the trees give holds against brute force."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((20_000, 64))
    if kind == "clusters":
        v = rng.standard_normal((200, 64))[rng.integers(200, size=20_000)] + 0.3 * v
    df = spark.createDataFrame(zip(range(len(v)), v.tolist()), "vec_id long, embedding array<double>").repartition(4)
    report = []
    found = search(df, F.col("vec_id") % 100 == 0, report=report).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.arange(len(v)), v, range(0, 20_000, 100), 20)
    print(kind, "queries", report[0], "of them held against all rows", report[1], "recall", recall(got, want))
    assert report[0] == 200 and report[1] < 0.05 * report[0] and recall(got, want) >= 0.9 and len(found) == 4000


def test_descents():
    known = Hashing(40, 3)
    x = np.random.default_rng(2).standard_normal((50, 40))
    order, cost, h = known.branches(x, 3)
    assert (h == known.strings(x, 3)).all()
    for deep in (1, 5, 6, 7, 20, 48):
        met = Hashing.descents(order, cost, h, deep)
        assert met.shape == (50, 3, 3) and (met[..., 0] == h >> (48 - deep)).all() and met.min() >= 0 and met.max() < 1 << deep


def test_norms_beyond_squares(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [0.0, 1e200]), (3, [0.0, 1e-200]), (4, [5.0]), (4, [0.0, 0.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 0.0), (2, 2, 0.0)]
    assert search(spark.createDataFrame(rows[-1:], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
