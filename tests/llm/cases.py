"""Documents with the awkward cases every operator must stand: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, s string, `row` int, gone int, hits int"


def documents(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared = [prose(14) for _ in range(4)]
    texts = []
    for _ in range(n):
        words = "\n".join(prose(rng.randint(3, 12)) for _ in range(rng.randint(1, 9)))
        texts.append(words + rng.choice(["", "\n", "\n" + rng.choice(shared), "\n  " + rng.choice(shared).upper() + "\t"]))
    for k in range(n // 3):  # near and exact copies
        words = texts[k].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", " \n\t ", "one", "one two", "One  TWO", "x" * 5000, "ab " * 3000, "é à ß 🎉 日本 " * 40, prose(4000), texts[0], texts[0], "\n\n\n", "\0a\x1fb"]
    rows = [(i, t, "en", "src", len(t or ""), "x", None, 1, 2, None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows
