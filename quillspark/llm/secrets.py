"""Secret scans with DataFrame functions only: key patterns, and the entropy of sliding windows over candidate strings.

Three patterns give the base spans: an assignment to a password-like name, an access key, a long hexadecimal string.
Candidates for the entropy scan are runs of 20 or more characters of keys outside the base spans. A window of 16
characters slides over each: the counts of its characters are carried from step to step, and so is the sum of
c * log2(c) over them, in integers, so that nothing drifts. A candidate is reported as `entropy` if its
most random window reaches the threshold of its character class, and if the allow list (placeholders, UUIDs, date stamps,
paths and names in words) doesn't suppress it. In names digits may end a part. Letters are words if at most one pair of
neighbours in them, or one in twenty characters, is one that words hardly have, and if capitals begin no more than one word
in five characters.

Positions are code points, ends exclusive. Null text is empty: no spans. Each input row gives one row, also rows that are
alike; an empty table gives none. A very long candidate costs time in proportion to its length; many matches in one text
cost n * sqrt(n) copied references for n of them. No pattern repeats a group that can be given back, as the JVM's engine
would need stack for each turn. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import let, running

#: Kind, pattern, group that is measured, its least length. In the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of fewer fails as a whole, so that this is the run of 20 or more
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 16
#: Bits a window must reach, by the class of the candidate's characters; 16 characters have 4 bits at most.
#: Ten digits reach 3.25 in a window.
THRESHOLDS = {"digits": 2.5, "hex": 3.0, "letters": 3.3, "alphanumeric": 3.4, "base64": 3.4}
LEAST = 20
#: The characters of candidates; all others count as one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Sums of c * log2(c) are integers with so many bits after the point.
FRACTION = 40
BLOCK = 4096

_DATE = r"(?:(?:19|20)\d\d[-/_](?:0?[1-9]|1[0-2])[-/_](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/_](?:0?[1-9]|[12]\d|3[01])[-/_](?:19|20)\d\d)"
#: Candidates that are no secrets: placeholders, UUIDs, dates with times or other dates.
ALLOW = rf"(?<![A-Za-z])(?i:example|sample|placeholder|dummy|changeme|your[_-]|x{{6,}})(?![a-z])|(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$|^{_DATE}(?:[-/_T+]+(?:{_DATE}|[0-5]?\d)(?!\d))*+(?:[-/_+]\d{{3,6}})?Z?$"
#: Names in words, if their letters are those of words.
NAME = r"^[A-Za-z/_+=-]*\d{0,4}$"
#: Pairs of letters that words hardly have.
ODD_PAIRS = r"q[a-tv-z]|[bdf-hj-mp-tv-z]q|j[b-df-hj-np-tv-z]|[cfhjkpqvwxz]j|v[b-df-hj-np-qtv-xz]|[cjqvwx][vfz]|p[vz]|x[bdfgj-nqrsvwz]|[b-df-hj-mp-tv-z]x|z[cjqrsvx]|w[cgjpqvxz]|[jqvx][whbcdgmp]|[jpqvwx]k|[kh][cjqvxz]|f[cjpqvwx]|[bdgmt]c"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Start, end and word of the matches: what lies between them has the lengths that split() gives."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else found

    def placed(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: x["gap"] + F.coalesce(F.length(x["word"]), F.lit(0))))
        full = F.zip_with(rows, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["word"])).alias("end"), x["word"].alias("word"), F.length(x["m"]).alias("m")))
        return F.filter(full, lambda x: x["word"].isNotNull() & (x["m"] >= least))

    return let(F.arrays_zip(gaps.alias("gap"), found.alias("word"), measured.alias("m")), placed)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, start: Column, size: Column) -> Column:
    """size characters of a text in blocks, without a walk from its start."""
    first = F.floor(start / BLOCK).cast("int")
    own = F.array_join(F.slice(blocks, first + 1, F.floor((start + size - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(size > 0, F.substring(own, start % BLOCK + 1, size)).otherwise(F.lit(""))


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """text with by(span, its characters not replaced so far) in the place of each span; spans are sorted by start."""

    def whole(blocks: Column, own: Column, done: Column) -> Column:
        def part(s: Column, k: Column) -> Column:
            at = F.element_at(done, k + 1)
            return F.array(_piece(blocks, at, s["start"] - at), by(s, s["end"] - F.greatest(s["start"], at)))

        last = F.array_max(F.transform(own, lambda s: s["end"]))
        return F.concat(F.array_join(F.flatten(F.transform(own, part)), ""), _piece(blocks, last, F.length(text) - last))

    made = let(spans, lambda own: let(_blocks(text), lambda blocks: let(running(F.transform(own, lambda s: s["end"]), True), lambda done: whole(blocks, own, done))))
    return F.when(F.size(spans) > 0, made).otherwise(text)


def window_entropy(text: Column, window: int = WINDOW, enough: Column | float | None = None) -> Column:
    """The largest entropy of a window, in bits; 0 for text shorter than a window. The first window with enough bits ends it.

    The state is a string with the counts of the window's characters but the last, one character for each of ALPHABET.
    """
    scale = 1 << FRACTION
    weight = [round(c * math.log2(c) * scale) if c else 0 for c in range(window + 1)]
    gain = F.array(*[F.lit(b - a).cast("long") for a, b in itertools.pairwise(weight)])  # by the count before, from 1
    zero = F.lit(0).cast("long")
    limit = zero - 1 if enough is None else F.floor((F.lit(math.log2(window)) - enough) * F.lit(float(window * scale))).cast("long")

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code, 1)) - 48

    def put(counts: Column, code: Column, n: Column) -> Column:
        return F.overlay(counts, F.chr(n + 48), code, 1)

    def add(acc: Column, code: Column) -> Column:
        held = count(acc["counts"], code)
        return F.struct(put(acc["counts"], code, held + 1).alias("counts"), (acc["sum"] + F.element_at(gain, held + 1)).alias("sum"), acc["least"].alias("least"))

    def step(acc: Column, x: Column, limit: Column) -> Column:
        held, gone, same = count(acc["counts"], x["new"]), count(acc["counts"], x["old"]), x["new"] == x["old"]
        total = acc["sum"] + F.element_at(gain, held + 1)
        counts = F.when(same, acc["counts"]).otherwise(put(put(acc["counts"], x["new"], held + 1), x["old"], gone - 1))
        moved = F.struct(counts.alias("counts"), F.when(same, acc["sum"]).otherwise(total - F.element_at(gain, gone)).alias("sum"), F.least(acc["least"], total).alias("least"))
        return F.when(acc["least"] <= limit, acc).otherwise(moved)

    def scan(codes: Column, limit: Column) -> Column:
        moves = F.zip_with(F.slice(codes, F.lit(window), F.size(codes)), F.slice(codes, F.lit(1), F.size(codes) - window + 1), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
        empty = F.struct(F.lit("0" * (len(ALPHABET) + 1)).alias("counts"), zero.alias("sum"), F.lit(2**62).alias("least"))
        return F.aggregate(moves, F.aggregate(F.slice(codes, 1, window - 1), empty, add), lambda acc, x: step(acc, x, limit), lambda acc: F.lit(math.log2(window)) - acc["least"] / F.lit(float(window * scale)))

    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1)
    return F.when(F.length(text) >= window, let(limit, lambda bound: let(codes, lambda own: scan(own, bound)))).otherwise(F.lit(0.0))


#: Digits at the end of a part of a name.
PART_DIGITS = r"(?<=[A-Za-z])\d{1,3}(?![A-Za-z0-9])"
#: Names in small letters and at least two underscores; no more than a quarter of them digits.
SNAKE = "^[a-z0-9]*_[a-z0-9]*_[a-z0-9_]*$"


def _allowed(word: Column) -> Column:
    odd = F.size(F.regexp_extract_all(word, F.lit(f"(?i)(?=({ODD_PAIRS}))"), F.lit(1)))
    capitals = F.size(F.regexp_extract_all(word, F.lit("[a-z](?=[A-Z])"), F.lit(0)))
    snake = word.rlike(SNAKE) & (F.size(F.regexp_extract_all(word, F.lit("[0-9]"), F.lit(0))) * 4 <= F.length(word))
    named = snake | F.regexp_replace(word, PART_DIGITS, "").rlike(NAME)
    return word.rlike(ALLOW) | (word.rlike("[A-Za-z]") & named & (odd <= F.greatest(F.lit(1), F.floor(F.length(word) / 20))) & (capitals * 5 <= F.length(word)))


def _is_secret(word: Column) -> Column:
    bar = (
        F.when(word.rlike("^[0-9+/_=-]+$"), THRESHOLDS["digits"])
        .when(word.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), THRESHOLDS["hex"])
        .when(word.rlike("^[A-Za-z]+$"), THRESHOLDS["letters"])
        .when(word.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alphanumeric"])
        .otherwise(THRESHOLDS["base64"])
    )
    random = let(bar, lambda bits: window_entropy(word, enough=bits) >= bits)
    return F.when(word.rlike("[A-Za-z0-9]") & ~_allowed(word), random).otherwise(False)


def _scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    lower = F.lower(t)
    named = reduce(lambda a, b: a | b, [lower.contains(x) for x in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    long_run = F.exists(F.split(t, " "), lambda x: F.length(x) >= LEAST) & t.rlike(CANDIDATE)
    # Each step keeps the text beside small arrays; nothing is shuffled.
    base = own.select(
        "doc_id",
        "text",
        long_run.alias("long_run"),
        F.when(named, _spans(_matches(t, ASSIGN, 2, 6), 0)).otherwise(_none()).alias("assign"),
        F.when(t.contains("AKIA"), _spans(_matches(t, ACCESS), 1)).otherwise(_none()).alias("access"),
        F.when(t.rlike(HEX), _spans(_matches(t, HEX), 2)).otherwise(_none()).alias("hex"),
    )
    base = base.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = _matches(_replaced(t, F.col("base"), lambda s, n: F.repeat(F.lit(" "), n)), CANDIDATE)
    added = F.when(F.col("long_run"), _spans(F.filter(free, lambda x: _is_secret(x["word"])), 3)).otherwise(_none())
    return base.select("doc_id", "text", "assign", "access", "hex", F.array_sort(F.concat(F.col("base"), added)).alias("spans"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans by kind, and spans, all by start and kind: one row for each row of docs.

    A span is (start, kind, end), its kind a place in KINDS. Plain substring tests tell most texts without a match apart.
    """
    return _scanned(docs, doc_id, text).drop("text")


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets; spans that overlap go as one, named by the first."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    own = _scanned(docs, doc_id, text)
    before = running(F.transform("spans", lambda s: s["end"]), True)
    marked = F.zip_with("spans", before, lambda s, at: F.struct(s["start"].alias("start"), F.when(s["start"] >= at, s["kind"]).otherwise(-1).alias("kind"), s["end"].alias("end")))
    done = _replaced(F.col("text"), marked, lambda s, n: F.when(s["kind"] >= 0, F.element_at(names, s["kind"] + 1)).otherwise(F.lit("")))
    return own.select("doc_id", done.alias("text"))
