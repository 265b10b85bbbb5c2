"""Line dedup and secret scan against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

from tests.llm.cases import SCHEMA, documents
from weftline.llm.op4_secret_scan import BLANK, KINDS, op4_secret_scan, scan_secrets
from weftline.llm.op4_secret_scan import PATTERNS as SCAN
from weftline.llm.op6_line_dedup import SortedRuns, dedup_lines, op6_line_dedup

SF = "/root/testdata/sf0.001"
STRIP = "".join(map(chr, [32, *range(9, 14)]))


def line_key(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(STRIP))


def lines_by_hand(rows, least, docs):
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= least:
                held[line_key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(line_key(x), ())) < docs or d == max(held[line_key(x)])]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines(spark):
    for seed in (1, 2):
        rows = documents(seed=seed)
        done = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), min_length=20, min_docs=3).collect()
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done) == lines_by_hand([r[:2] for r in rows], 20, 3)
        assert sum(r.n_dropped for r in done) > 5 and done[0].row.row == 1
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, m in lines_by_hand(rows, 40, 5)]
    assert sorted(tuple(r) for r in op6_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want


def test_runs(spark):
    runs = SortedRuns(fan=2)
    shape = "h1 long, h2 long, docs long, top long"
    for b in range(4, -1, -1):  # ids fall from batch to batch
        runs.add(spark.createDataFrame([(h, h, 1, b) for h in range(b, b + 3)], shape))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.h1 for run in runs.runs() for r in run.collect()) == list(range(7))  # no hash in two runs
    assert {r.h1: (r.docs, r.top) for r in runs.state().collect()} == {0: (1, 0), 1: (2, 1), 2: (3, 2), 3: (3, 3), 4: (3, 4), 5: (2, 4), 6: (1, 4)}
    batch = spark.createDataFrame([(3, 3, 1, 9), (8, 8, 1, 9)], shape)
    assert [r.h1 for r in runs.unseen(batch).collect()] == [8] and [r.h1 for r in runs.seen(batch).collect()] == [3]
    assert "LeftAnti" in runs.unseen(batch)._jdf.queryExecution().executedPlan().toString()


def test_shared_and_missing_ids(spark):
    line = "a line that is long enough to be looked at by everyone"
    texts = [(1, line), (1, f"x\n{line}"), (2, line), (2, line), (3, f"{line}\n{line}\ny"), (None, line), (None, f"{line}\n"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    done = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df, min_docs=4).collect()))
    assert done == [(0, "", 1, 0), (0, "", 1, 1), (0, "", 2, 1), (1, "", 1, 1), (1, "x", 2, 1), (2, "", 1, 1), (2, "", 1, 1), (3, texts[4][1], 3, 0)]
    assert all(not r.n_dropped for r in dedup_lines(df, min_docs=5).collect())  # ids 1, 2, 3 and one for all without


def test_a_text_of_many_lines(spark):
    many = "\n".join(f"this is line number {k:06d} of a very long document" for k in range(200_000))
    df = spark.createDataFrame([(d, many) for d in range(5)] + [(9, "short")], "doc_id long, text string").repartition(6)
    done = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in dedup_lines(df).collect()}
    assert done == {**{d: (200_000, 200_000, 0) for d in range(4)}, 4: (200_000, 0, len(many)), 9: (1, 0, 5)}


SECRETS = [
    "é password = 'abcd1234' tok token:\"xyz_12345.=\" \U0001f389 api_key=short apikey: longenough1",
    "token=secret: abcdefgh12 SECRET=ABCDEFGH", "AKIAABCDEFGHIJKL12 AKIA12 xAKIAAKIAAKIAAKIA1", "deadbeef" * 5 + " " + "0" * 31 + " " + "a" * 32,
    "id ABCD1234EFGH5678IJ key " + "aB3" * 13 + "z see https://a.example/x?y=1 end", "lonely ABCD1234EFGH5678IJ", "lonely\n\nABCD1234EFGH5678IJ\n \npassword=abcdefgh99", "ABCD1234EFGH5678IJ " + "w " * 300 + "password=abcdefgh99",
    "https://x.example/ password=abcdefgh99", "ABCD1234EFGH5678IJ\npassword=abcdefgh99\nhttp://x.example/", None, "", "password=", "a" * 50_000, "password=abcdefgh1 " * 400,
]
PATTERNS = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))


def base_by_hand(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            if (len(m[2]) >= 8, len(m[0]) >= 16, len(m[0]) >= 32)[k] if k == 0 else len(m[0]) >= (0, 16, 32)[k]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_secrets(spark):
    rows = [(i, t, 1, 2) for i, t in enumerate(SECRETS)]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, s int, rid int")).collect()}
    for i, t in enumerate(SECRETS):
        assert sorted((x.s, x.k, x.e) for k in ("assign", "access", "hex") for x in got[i][k]) == [x[:3] for x in base_by_hand(t)], t
    linked = {i: sorted((SECRETS[i][x.s : x.e], x.k) for x in r.linked) for i, r in got.items() if r.linked}
    assert linked == {4: [("ABCD1234EFGH5678IJ", 3), ("aB3" * 13 + "z", 4), ("https://a.example/x?y=1", 5)], 9: [("ABCD1234EFGH5678IJ", 3), ("http://x.example/", 5)]}
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_whole(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op4_secret_scan(spark, SF).collect():
        base = base_by_hand(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in base).encode()).hexdigest()
        assert {f"{x[3]}:{x[0]}:{x[2]}" for x in base} <= set(r.spans.split(","))


def linked_by_hand(t, reach=200):
    """Pairwise: every candidate against every other part of its block."""
    spans = [x[:3] for x in base_by_hand(t)]
    spans += [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) if k > 2 for m in re.finditer(SCAN[kind], t)]
    starts = [0, *(m.end() for m in re.finditer(BLANK, t))]
    block = lambda x: max(s for s in starts if s <= x[0])
    out = []
    for c in spans:
        others = [x for x in spans if x != c and block(x) == block(c)]
        near = lambda kinds, d: any((c[0] - x[2] if x[:2] < c[:2] else x[0] - c[2]) < d for x in others if x[1] in kinds)  # noqa: B023, E731
        ids, secrets = near((1, 3), reach), near((0, 2, 4), reach)
        if c[1] > 2 and not near((0, 1, 2), 0) and (secrets, ids, ids and secrets)[c[1] - 3]:
            out.append(c)
    return sorted(out)


def test_links_by_hand(spark):
    rng = random.Random(4)
    make = [
        lambda: "".join(rng.choices("ABCDEF0123456789", k=rng.randint(14, 34))), lambda: "".join(rng.choices("aBcD01+/", k=40)), lambda: f"https://h{rng.randrange(99)}.example/p",
        lambda: f"{rng.choice(['password', 'API_KEY', 'token'])}{rng.choice([' = ', ':', '='])}{'ab12' * rng.randint(1, 4)}", lambda: "AKIA" + "Z9" * rng.randint(4, 9), lambda: "0af" * rng.randint(9, 14),
        lambda: "\n\n", lambda: "\n \t\n", lambda: "word " * rng.randint(1, 60), lambda: "é🎉 ", lambda: "\n",
    ]
    texts = ["".join(rng.choice(make)() + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    want = {i: linked_by_hand(t) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 100
    for r in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        assert [(x.s, x.k, x.e) for x in r.linked] == want[r.doc_id], texts[r.doc_id]
        assert sorted((x.s, x.k, x.e) for k in ("assign", "access", "hex") for x in r[k]) == [x[:3] for x in base_by_hand(texts[r.doc_id])]


def test_many_matches_in_one_text(spark):
    text = "password = abcd1234 https://a.example/x ABCD1234EFGH5678IJ\n" * 60_000
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (len(r.assign), len(r.linked), r.linked[-1].e if r.linked else 0) for r in scan_secrets(df).collect()}
    assert got == {1: (60_000, 120_000, len(text) - 1), 2: (0, 0, 0)}
