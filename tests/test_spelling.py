"""Keys of spelling: no close pair is lost, a word has a few keys a letter, and keys are never broadcast."""

import difflib
import random

import pytest

from quillspark.operators import spelling


@pytest.mark.parametrize("cutoff", [0.88, 0.75])
def test_close_words_share_a_key(cutoff):
    rng, asked, known, close = random.Random(3), spelling.Keys(False, cutoff), spelling.Keys(True, cutoff), 0
    for _ in range(1500):
        word = [rng.choice("abcde") for _ in range(rng.randint(4, 26))]
        other = list(word)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(other) - 1)
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c", "d"])
        a, b = "".join(other), "".join(word)
        if a != b and difflib.SequenceMatcher(None, b, a).ratio() >= cutoff:
            close += 1
            assert asked.of(a) & known.of(b), (a, b)
    assert close > 300


def test_keys_are_few():
    known, asked = spelling.Keys(True), spelling.Keys(False)
    for n in range(6, 17):
        word = "abcdefghijklmnop"[:n]
        assert len(known.of(word)) <= 3 * n and len(asked.of(word)) <= 9 * n


def test_keys_are_not_broadcast(spark):
    words = spark.createDataFrame([("abcdefgh",), ("qrstuvwxyz",)], "w string")
    plan = spelling.corrections(words, words)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
