"""Token counts and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.bpe import tokenizer_path, vocabulary
from weftline.llm.op8_token_counts import count_tokens
from weftline.llm.op10_packing import balanced, differenced, pack

LIBRARY = Tokenizer.from_file(tokenizer_path())
SCHEMA = "doc_id long, text string, n_tokens string, `offset` int"
ROWS = [
    (1, "Hello world, it's   here.\n\n  A_b __ 12ab ½ ² x'll", "x", 1), (2, None, None, None), (3, "", "x", 1), (None, "a  \t\tb", "x", 1), (1, "Hello", "x", 1), (1, "Hello", "x", 1),
    (5, "x" * 30_000, "x", 1), (6, "<|endoftext|>a<|endoftext|> <|endoftext|", "x", 1), (7, "日本語 ñandú  \x1c \xa0 𝔘𝔫𝔦 🎉🎉", "x", 1), (8, "a b\0c " * 5000, "x", 1), (9, "ñu é" * 2500, "x", 1),
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    got = sorted(map(tuple, count_tokens(spark.createDataFrame(ROWS, SCHEMA), tokenizer_path(), limit=100).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(ids(t)), n > 100) for d, t, *_ in ROWS]
    assert got == sorted(want, key=str)
    assert count_tokens(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 'sté\n\t_1<|endoftext|>", max_size=60))
def test_same_as_library(text):
    v = vocabulary(tokenizer_path())
    assert v.count(text) == len(ids(text))
    assert np.frombuffer(v.encode(text), dtype="<u4").tolist() == ids(text)


def test_pack(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(ROWS)], "doc_id long, text string").repartition(3)
    rows = pack(df, tokenizer_path(), capacity=64).collect()
    by, windows = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for i, (_, text, *_) in enumerate(ROWS):
        want, at = [*ids(text), 0], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_differencing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 257, 300).tolist()
    for k in (1, 2, 7, 40):
        found = differenced(sizes, k)
        assert sorted(i for _, w in found for i in w) == list(range(300)) and all(n == sum(sizes[i] for i in w) for n, w in found)
        assert len(found) == k and max(n for n, _ in found) - min(n for n, _ in found) <= 40
    windows = balanced(sizes, 1024)
    assert all(sum(sizes[i] for i in w) <= 1024 for w in windows) and len(windows) <= -(-sum(sizes) // 1024) + 1
