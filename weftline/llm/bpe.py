"""Byte-level BPE over a tokenizer file: piece splitting, heap-based merge counting, ids of pieces."""

from __future__ import annotations

import functools
import heapq
import json
import re

#: Characters for which `re` and the tokenizer's own splitter agree; a text with any other goes to the tokenizer's splitter.
OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ]")
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
KEPT_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next of the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, and bounded caches of pieces seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        ids = model["vocab"]
        self.alphabet = byte_alphabet()
        self.table = {i: c for i, c in enumerate(self.alphabet)}
        self.back = {c: i for i, c in enumerate(self.alphabet)}
        self.first = [ids[c] for c in self.alphabet]
        self.width = 1 << max(ids.values()).bit_length()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {ids[a] * self.width + ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.counts: dict[str, int] = {}
        self.packed: dict[str, bytes] = {}

    def segments(self, text: str):
        """(text, None) for ordinary stretches and (token, id) for special strings, which the library finds by default."""
        if not self.parts or not any(t in text for t in self.added):
            yield text, None
            return
        for k, part in enumerate(self.parts.split(text)):
            if part:
                yield part, self.added[part] if k % 2 else None

    def pieces(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return PIECES.findall(text)
        return ["\0" + bytes(self.back[c] for c in p).decode("latin-1") + "\0" for p, _ in self.splitter.pre_tokenize_str(text)]

    @staticmethod
    def raw(piece: str) -> bytes:
        """Bytes of a piece; those of the tokenizer's splitter may cut characters and come as marked Latin-1."""
        return piece[1:-1].encode("latin-1") if piece[:1] == "\0" else piece.encode()

    def merged(self, piece: bytes) -> int:
        """Tokens of a piece: symbols minus merges. The heap holds rank and place; links skip symbols merged away."""
        n = len(piece)
        if n < 2:
            return n
        sym = [self.first[b] for b in piece]
        get, width = self.merges.get, self.width
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found[0] << 40) + i for i in range(n - 1) if (found := get(sym[i] * width + sym[i + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j < 0:
                continue
            found = get(sym[i] * width + sym[j])
            if not found or found[0] != top >> 40:
                continue
            sym[i], sym[j] = found[1], -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := get(sym[i] * width + sym[k]):
                    heapq.heappush(heap, (found[0] << 40) + i)
            h = before[i]
            if h >= 0 and (found := get(sym[h] * width + sym[i])):
                heapq.heappush(heap, (found[0] << 40) + h)
        return left

    def count(self, text: str) -> int:
        total, counts = 0, self.counts
        for part, special in self.segments(text):
            if special is not None:
                total += 1
                continue
            pieces = self.pieces(part)
            try:
                total += sum(map(counts.__getitem__, pieces))
            except KeyError:
                for p in pieces:
                    n = counts.get(p)
                    if n is None:
                        n = self.merged(self.raw(p))
                        if len(counts) < KEPT_WORDS and len(p) < 64:
                            counts[p] = n
                    total += n
        return total

    def ids_of(self, piece: str) -> bytes:
        found = self.packed.get(piece)
        if found is None:
            mapped = self.raw(piece).decode("latin-1").translate(self.table)
            found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped))
            if len(self.packed) < KEPT_WORDS and len(piece) < 64:
                self.packed[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The library's ids, each as four little-endian bytes."""
        out, packed = [], self.packed
        for part, special in self.segments(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
                continue
            pieces = self.pieces(part)
            try:
                out.append(b"".join(map(packed.__getitem__, pieces)))
            except KeyError:
                out.append(b"".join(map(self.ids_of, pieces)))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker, kept between tasks."""
    return Vocabulary(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
