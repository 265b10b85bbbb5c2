"""Quality classifier: held-out accuracy; decontamination: planted passages with substitutions, and brute force."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.cases import SCHEMA, documents
from weftline.llm import shared
from weftline.llm.op2_decontamination import MASKS, PUNCTUATION, Seeds, best_segment, decontaminate, widest_segment
from weftline.llm.op7_quality import Ordinal, features, fit_quality, score_quality

SF = "/root/testdata/sf0.01"


def test_ordinal_fit_recovers():
    rng = np.random.default_rng(5)
    texts, grade = [], []
    for _ in range(600):
        g = int(rng.integers(3))
        words = [f"w{rng.integers(400)}" for _ in range(60)] + [("bad", "dull", "fine")[g]] * 2
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        grade.append(g)
    grade = np.array(grade)
    index, ends = features(texts)
    model = Ordinal.fit(index, ends, grade)
    expected, tail = model.score(index, ends)
    assert (np.diff(model.thresholds) > 0).all() and ((expected >= 0) & (expected <= 2)).all()
    assert np.mean((tail >= 0.5) == (grade == 2)) > 0.97 and expected[grade == 0].mean() < expected[grade == 1].mean() < expected[grade == 2].mean()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit, held = labels.where("doc_id % 4 > 0"), {r.doc_id: r for r in labels.where("doc_id % 4 = 0").collect()}
    done = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, fit)).collect()}
    assert len(done) == docs.count()
    clean = [done[i].keep for i, r in held.items() if r.quality and not r.toxic]
    toxic = [done[i].keep for i, r in held.items() if r.toxic]
    poor = [done[i].keep for i, r in held.items() if not r.quality]
    assert np.mean(clean) > 0.9 and np.mean(poor) < 0.2 and np.mean(toxic) < 0.7


@pytest.mark.parametrize("sf,good,poor,toxic", [("sf0.01", 0.96, 0.2, 0.35), ("sf0.1", 0.98, 0.1, 0.1)])
def test_quality_by_folds(sf, good, poor, toxic):
    """Every label held out once; with a few hundred labels some fifty are toxic and some fifty poor."""
    docs, labels = (pq.read_table(f"/root/testdata/{sf}/{name}.parquet").to_pandas() for name in ("documents", "labels"))
    texts = docs.set_index("doc_id").text.loc[labels.doc_id]
    grade = np.where(labels.toxic == 1, 0, np.where(labels.quality == 0, 1, 2))
    index, ends = features([(t or "").encode() for t in texts])
    part = lambda rows: (np.concatenate([index[ends[i] : ends[i + 1]] for i in rows]), np.cumsum([0] + [ends[i + 1] - ends[i] for i in rows]))
    kept = np.zeros(len(grade), dtype=bool)
    for fold in range(4):
        out = labels.doc_id.to_numpy() % 4 == fold
        kept[out] = Ordinal.fit(*part(np.flatnonzero(~out)), grade[~out]).score(*part(np.flatnonzero(out)))[1] >= 0.5
    shares = [kept[grade == g].mean() for g in (2, 1, 0)]
    print(sf, "kept of good, poor, toxic:", shares)
    assert shares[0] > good and shares[1] < poor and shares[2] < toxic


def test_quality_edges(spark):
    rows = spark.createDataFrame(documents(), SCHEMA)
    none = score_quality(rows, fit_quality(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert none.where("keep").count() == rows.count()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    done = score_quality(rows, fit_quality(rows, labels))
    assert done.count() == rows.count() and done.where("tail is null or isnan(tail)").count() == 0
    assert score_quality(rows.limit(0), fit_quality(rows, labels)).count() == 0


def test_overlaps(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 9, 15, 40])))) for i in range(40)]
    plain = " ".join(word() for _ in range(300))
    rows, want = [(0, plain), (1, None), (2, ""), (3, plain)], {}
    for i, t in items:
        words = t.upper().split()
        if len(words) > 12:
            for k in range(6, len(words), 7):  # a substitution in every seven words
                words[k] = word()
        rows.append((100 + i, f"{plain} ({', '.join(words)}). {plain}"))
        want[100 + i] = i
    items += [(99, items[0][1]), (98, None), (97, " . "), (None, "nobody")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "e", "s", 1, "f", "s", 1, 2, 3) for i, t in rows], SCHEMA)
    for mb in (8, 0.0005):
        got = {r.doc_id: {x.item_id for x in r.overlaps} for r in decontaminate(df, bench, block_mb=mb).collect()}
        assert len(got) == len(rows) and all(got[i] == {n} for i, n in want.items()) and not any(got[i] for i in range(4))
    assert decontaminate(df, bench.limit(0)).where("contaminated").count() == 0 and decontaminate(df.limit(0), bench).count() == 0


def test_hits_and_segments():
    assert best_segment(np.array([0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1], dtype=bool)) == (4, 8)
    known = Seeds([(1, "a b c d e f g h i j k l m n")])
    found = np.unique(np.concatenate([*known.diagonals(Seeds([(0, "x y a b c d e f g h i j k l m n")]).words[0])], axis=1), axis=1)
    assert found.tolist() == [[2], [0]]


def test_runs_within_a_weak_segment(spark):
    differs = lambda n: [k % 9 in (4, 8) for k in range(n)]  # noqa: E731 # runs of 4 and 3 between substitutions
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (22, 58, 184)}
    docs = [(n, " ".join("x" if d else w for d, w in zip(differs(n), own))) for n, own in items.items()]
    apart = [f"a{k}" for k in range(30)]
    # Two substitutions in twelve words, and far off a run of nine that is better by itself but too short.
    docs.append((30, " ".join([*apart[:5], "x", *apart[6:9], "x", *apart[10:12], *"xxxxxxxxx", *apart[21:]])))
    docs.append((1, " ".join(f"z{k}" for k in range(20))))
    bench = [(n, " ".join(own)) for n, own in items.items()] + [(30, " ".join(apart)), (None, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.overlaps] for r in decontaminate(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {22: [22], 58: [58], 184: [184], 30: [30], 1: [None]}


def test_widest_segment_is_brute_force():
    rng = np.random.default_rng(3)
    for n in range(1, 40):
        equal = rng.random(n) < rng.choice([0.5, 0.75, 0.9])
        lo, hi = widest_segment(equal, 0.8)
        most = max(int(equal[a:b].sum()) for a in range(n) for b in range(a + 1, n + 1) if equal[a:b].sum() >= 0.8 * (b - a) - 1e-9 or b == a + 1)
        assert equal[lo:hi].sum() == most and most >= 0.8 * (hi - lo) - 1e-9


def test_masks_miss_no_segment():
    """Strings of equal (1) and differing words that no mask hits never hold ten equal ones at a share of 0.8: the best
    value of ones - 0.8 * length over all of them, by their last nine places and up to ten ones."""
    shapes = [(len(m), int(m, 2)) for m in MASKS]
    best = {("", 0): 0}
    for _ in range(80):
        longer = {}
        for (last, ones), value in best.items():
            for bit in "01":
                now = last + bit
                if not any(len(now) >= n and int(now[-n:], 2) & mask == mask for n, mask in shapes):
                    key = (now[-9:], min(10, ones + int(bit)))
                    longer[key] = max(longer.get(key, -999), value + (1 if bit == "1" else -4))  # in fifths: 5 * one - 4
        best = longer
        assert not any(ones == 10 and value >= 0 for (_, ones), value in best.items())


def all_diagonals(rows, items, need=10, share=0.8, least=4):
    """Items that overlap each document, from every diagonal and every segment on it."""
    split = lambda t: "".join(" " if c in PUNCTUATION.decode() else c for c in (t or "").lower()).split()
    out = []
    for d, t in rows:
        doc, found = split(t), []
        for i, own in [(i, split(x)) for i, x in items]:
            if not own or len(own) < least and len(own) != len(doc):
                continue
            hit = False
            for start in range(1 - len(own), len(doc)):
                held = np.concatenate([[0], np.cumsum([0 <= start + k < len(doc) and doc[start + k] == w for k, w in enumerate(own)])])
                for a in range(len(own)):
                    n = held[a + 1 :] - held[a]
                    hit |= bool(((n >= min(need, len(own))) & (n >= share * np.arange(1, len(own) - a + 1) - 1e-9)).any())
            found += [i] * hit
        out.append((d, sorted(found)))
    return sorted(out)


def test_against_all_diagonals(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)]  # few words, so that chance overlaps abound
    some = lambda n: [rng.choice(words) if rng.random() < 0.5 else f"z{rng.randrange(500)}" for _ in range(n)]
    items = [(k, some(n)) for k, n in enumerate([1, 2, 3, 4, 7, 9, 10, 11, 12, 15, 20, 30, 45, 60])]
    rows = []
    for _, own in items * 4:
        copy = [w if rng.random() < rng.choice([0.75, 0.85, 0.95]) else "other" for w in own]
        rows.append(" ".join(some(rng.randrange(20)) + copy + some(rng.randrange(20))))
    rows += [" ".join(own) for _, own in items] + ["w1 " * 30, "w0. w0, W0!", "", None]
    rows = list(enumerate(rows))
    bench = [(k, " ".join(own)) for k, own in items] + [(50, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (51, "w0"), (52, " ")]
    want = all_diagonals(rows, bench)
    assert 20 < sum(bool(x) for _, x in want) < len(rows)
    for mb in (8, 0.0001):
        done = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_mb=mb)
        assert sorted((r.doc_id, sorted(x.item_id for x in r.overlaps)) for r in done.collect()) == want


def test_repetitive_and_very_long_texts(spark):
    rng = random.Random(8)
    same, item = "the " * 1_000_000, " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    long_ = " ".join(f"v{rng.randrange(10**7)}" for _ in range(1_500_000)) + f" {item} " + "x" * 5_000_000
    df = spark.createDataFrame([(1, same), (2, long_), (3, "the")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, "the " * 100), (8, item), (9, "the")], "item_id long, text string")
    got = {r.doc_id: [(x.item_id, x.matched, x.doc_start) for x in r.overlaps] for r in decontaminate(df, bench).collect()}
    assert got == {1: [(7, 100, 0)], 2: [(8, 30, 1_500_000)], 3: [(9, 1, 0)]}


def test_words_are_cut_by_no_piece(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abC \n\t", weights=[9, 9, 9, 1, 1, 1], k=rng.randrange(60))).encode() for _ in range(200)]
    whole = shared.word_hashes(texts, b"c", (4, 5))
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(shared, "PIECE", size)
        assert all((a == b).all() for a, b in zip(whole, shared.word_hashes(texts, b"c", (4, 5))))
