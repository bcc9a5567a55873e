"""Small corpora that hold what the operators must bear: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string"
WORDS = ["alpha", "beta", "gamma", "delta", "été", "über", "in", "of", "the", "niño"]


def rows(texts):
    """Documents with extra columns whose names clash with those of results."""
    return [(i, t, "en", f"src{i % 12}", len(t or ""), "x", "y") for i, t in enumerate(texts)]


def texts(seed: int = 1, n: int = 60) -> list:
    rnd = random.Random(seed)
    base = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(1500))
    out = [None, "", "short", "\n\n \t", "one\ntwo\none\none", "x" * 5000]
    for _ in range(n):
        t = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(3, 90)))
        for _ in range(rnd.randint(0, 2)):
            a, size, at = rnd.randint(0, len(base) - 700), rnd.choice([150, 199, 200, 201, 263, 264, 400]), rnd.randint(0, len(t))
            t = t[:at] + base[a : a + size] + t[at:]
        out.append(t)
    return [*out, out[8], out[8], "a" * 1000, "ab" * 300, " ".join(["word"] * 3000)]
