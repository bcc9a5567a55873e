"""What needs Python: Unicode normal forms and close matches of words. Arrow functions, a batch at a time."""

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F


def normal_form(form: str):
    """A column function for NFC, NFKC and so on; null stays null."""

    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normalise


def close_match(vocabulary: tuple[str, ...], cutoff: float = 0.88):
    """A column function: the one word of the vocabulary that is close to a word, else the word. The vocabulary is a fixed list."""

    @F.pandas_udf("string")
    def correct(s: pd.Series) -> pd.Series:
        def one(word):
            if word is None or word.lower() in vocabulary or len(word) < 6 or not word.isascii() or not word.isalpha():
                return word
            near = difflib.get_close_matches(word.lower(), sorted(vocabulary), n=2, cutoff=cutoff)
            return near[0] if len(near) == 1 else word

        return s.map(one)

    return correct
