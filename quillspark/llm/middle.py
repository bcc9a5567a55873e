"""Fill-in-the-middle: a text is cut at two of its lines, and its middle goes to the end behind marks.

A text is one big integer for each class of bytes, bit i for byte i: bytes.translate writes the class as digits, and the
digits are read in base two. Shifting the mask of line feeds by one byte and setting bit 0 marks where lines begin;
bit_count gives how many; the place of the line with a given rank is found by halving the mask, going on in the half that
holds it. The mask of bytes that begin a code point counts the characters of a piece. All steps are linear in the text's
length, without a loop over its bytes.

Lines end with their line feed; the last may have none. Where to cut, whether to cut and in which order to write the
pieces comes from the SHA-256 of seed and id, so that it is the same in every run. Null text is empty, empty text is plain,
as is text that holds one of the marks: an exact rebuilding must be possible. A null id counts as an empty one. Each input
row gives a row, also rows that are alike, which give the same output. An empty table gives none. Columns named as the
results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import append_columns

SEED = 7
#: Of a hundred texts, how many are cut, and of those that are cut, how many begin with the suffix.
RATE, SUFFIX_FIRST = 100, 50
#: Fixed marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")

_FEEDS = bytes(49 if c == 10 else 48 for c in range(256))
_POINTS = bytes(48 if c & 0xC0 == 0x80 else 49 for c in range(256))

FIELDS = [
    T.StructField("fim_output", T.StringType()),
    T.StructField("fim_form", T.StringType()),
    T.StructField("fim_lines", T.LongType()),
    T.StructField("fim_prefix_chars", T.LongType()),
    T.StructField("fim_middle_chars", T.LongType()),
]


def mask(text: bytes, digits: bytes) -> int:
    """Bit i is the class of byte i; digits maps a byte to 48 or 49."""
    return int(text[::-1].translate(digits) or b"0", 2)


def line_starts(text: bytes) -> int:
    """Bit i is set where a line begins."""
    return (mask(text, _FEEDS) << 1 | 1) & ((1 << len(text)) - 1)


def place(bits: int, rank: int, width: int) -> int:
    """The place of the set bit with that rank, from 0; width if there is none. bits has no more than width bits."""
    at, end = 0, width
    if rank >= bits.bit_count():
        return width
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        held = low.bit_count()
        if rank < held:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - held, at + half, width - half
    return min(at, end)


def cut(text: bytes, key: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, bytes, bytes, bytes]:
    """Form, number of lines, prefix, middle and suffix of a text; a plain text is all prefix."""
    starts = line_starts(text)
    n = starts.bit_count()
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", n, text, b"", b""
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = place(starts, first, len(text)), place(starts, second, len(text))
    return "spm" if h[3] % 100 < suffix_first else "psm", n, text[:a], text[a:b], text[b:]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with fim_output, fim_form, fim_lines, fim_prefix_chars and fim_middle_chars (null for a plain text)."""
    own = docs.drop(*[f.name for f in FIELDS]).withColumn("__f_key", F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    # The key stands before the text, in one column: what is appended is made from one column.
    own = own.withColumn("__f_in", F.concat(F.col("__f_key"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))).drop("__f_key")

    def work(rows: list[bytes | None]) -> list:
        made: list[list] = [[], [], [], [], []]
        for row in rows:
            key, _, body = row.partition(b"\n")
            form, n, prefix, middle, suffix = cut(body, key.decode(), rate, suffix_first)
            plain = form == "plain"
            whole = body if plain else b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
            made[0].append(whole.decode("utf-8", "replace"))
            made[1].append(form)
            made[2].append(n)
            made[3].append(None if plain else mask(prefix, _POINTS).bit_count())
            made[4].append(None if plain else mask(middle, _POINTS).bit_count())
        return made

    return append_columns(own, "__f_in", lambda: work, FIELDS).drop("__f_in")


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from what was made of it and its form. No piece holds a mark, so that each mark is found where it was set."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    body = F.substring(output, len(p) + 1, 2**31 - 1)
    psm, spm = F.split(body, f"{s}|{m}", 3), F.split(body, f"{p}|{m}", 3)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
