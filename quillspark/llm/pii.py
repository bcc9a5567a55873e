"""Personal data, and terms that give it away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers in fixed patterns. Each value found is a
protected entity. The corpus then tells how strongly the terms of the documents that hold it reveal it. With n(e, t) the
documents that hold entity e and, outside all base spans, term t, n(t) those that hold t anywhere, n(e) those that hold e
and N all of them, P(e | t) is estimated as (n(e, t) - 1) / n(t): the document by which a pair was found is left out, so
that terms of a single document tell nothing, however rare they are. In n(e, t), n(t) and n(e) near copies (see copies)
count as one document: what only the copies of one text hold tells nothing either. The pointwise mutual information
log2(P(e | t) * N / n(e)) is compared with the information content of the entity, log2(N / n(e)). A term that carries
GENERALISE of it or more is generalised, and from REMOVE on removed: wherever it stands outside base spans, in all
documents, as it reveals the entity there as well.

All counts are over all documents. A term is counted among texts without copies first; only what may then still reveal an
entity is counted by class among texts with copies, which a bitmap of hashes tells (a text that it takes for one with
copies is counted by its own hash, which gives the same). Terms that are counted or marked are broadcast up to TERMS of them; beyond, a join
with all words counts or marks them.

Null text is empty: no spans, the digest of nothing. Each input row gives one row and counts as a document, also repeated
rows. An empty table gives none. A very long text costs time in proportion to its length. Of two shares of a term the
stronger action is taken. Overlaps within a kind don't occur; overlaps between kinds stay. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import as_bytes, slices
from quillspark.llm.copies import bands, classes, text_hash
from quillspark.llm.decontaminate import _NORMAL
from quillspark.session import write_shared

GENERALISE, REMOVE = 0.8, 0.95
TERMS = 200_000
KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns. An e-mail address is looked for around each @, so that long runs of letters cost nothing; a number
#: starts where its digits start, as no later start can match if that one does not.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS."""
    found: list[list[tuple[int, int]]] = [list(_emails(text)) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        found[1] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found[2].append(m.span())
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _entity(kind: int, value: str) -> int:
    plain = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - 2**63


_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str, spans: list[list[tuple[int, int]]]):
    """Term, start and end of the words outside the spans."""
    taken = sorted(s for kind in spans for s in kind)
    k, end = 0, 0  # end: of the spans that start before the word's end
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            end = max(end, taken[k][1])
            k += 1
        if end <= a:
            yield m[0].translate(_LOWER), a, b


_FOUND = T.StructType(
    [
        T.StructField("h", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("entities", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
    ]
)

_MARKED = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def _scan(docs: DataFrame, schema: T.StructType, row) -> DataFrame:
    """What row(uid, doc_id, text as bytes) gives for each row of docs, without None."""

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        uid, fields = TaskContext.get().partitionId() << 40, to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    if (own := row(uid, doc_id, text or b"")) is not None:
                        rows.append(own)
                    uid += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return docs.mapInArrow(run, schema)


def _detected(docs: DataFrame) -> DataFrame:
    """The text's hash and groups of minima, and entities and terms of the documents that hold an entity."""

    def row(uid, doc_id, data):
        text = data.decode("utf-8", "replace")
        spans = base_spans(text)
        known = text_hash(data), bands(data)
        if any(spans):
            return *known, sorted({_entity(k, text[a:b]) for k, own in enumerate(spans) for a, b in own}), sorted({t for t, _, _ in _terms(text, spans)})
        return *known, None, None

    return _scan(docs, _FOUND, row)


def _marked(docs: DataFrame, wanted: dict[str, str] | None) -> DataFrame:
    """Base spans and, of the wanted terms (t, action), all occurrences; with None, all words instead."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    some = docs.sparkSession.sparkContext.broadcast(frozenset(t.encode() for t in wanted or ()))

    def row(uid, doc_id, text):
        actions, words, marks = shared.value, [], []
        any_term = actions is None or (actions and not some.value.isdisjoint(text.translate(_NORMAL).split()))
        text = text.decode("utf-8", "replace")
        spans = base_spans(text)
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for k, own in enumerate(spans) for a, b in own)
        if actions is None:
            words = [{"t": t, "start": a, "end": b} for t, a, b in _terms(text, spans)]
        elif any_term:
            marks = sorted((actions[t], a, b) for t, a, b in _terms(text, spans) if t in actions)
        return uid, doc_id, *map(len, spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(filter(None, [base, *(f"{k}:{a}:{b}" for k, a, b in marks)])), words

    return _scan(docs, _MARKED, row)


#: Bits of the map that tells texts with copies.
COPY_BITS = 1 << 26


def _copy_map(classes_: DataFrame) -> np.ndarray:
    """Bit h % COPY_BITS is set for the hash h of each text with copies: at most COPY_BITS / 64 rows reach the driver."""
    at = F.pmod(F.col("h"), F.lit(COPY_BITS))
    words = classes_.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {COPY_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()
    bits = np.zeros(COPY_BITS // 64, np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _held_terms(docs: DataFrame, some: list[bytes], copies: np.ndarray, alone: bool) -> DataFrame:
    """t, n: how many texts without copies hold each of some terms; or else t, h: which texts with copies hold them."""
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(some), copies))

    def run(batches):
        (wanted, bits), counts, pairs = shared.value, Counter(), set()

        def seen():
            out = sorted(pairs)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([t.decode() for t, _ in out], pa.string()), pa.array([h for _, h in out], pa.int64())], names=["t", "h"])

        for batch in batches:
            for part in slices(batch, 1):
                for text in as_bytes(part.column(1)):
                    h = text_hash(text or b"")
                    at = h % COPY_BITS
                    if bool(int(bits[at >> 6]) >> (at & 63) & 1) != alone:
                        held = wanted.intersection((text or b"").translate(_NORMAL).split())
                        if alone:
                            counts.update(held)
                        else:
                            pairs.update((t, h) for t in held)
                if len(pairs) >= 1 << 16:
                    yield seen()
        if alone:
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["t", "n"])
        elif pairs:
            yield seen()

    return docs.mapInArrow(run, "t string, n long" if alone else "t string, h long")


def _by_class(pairs: DataFrame, classes_: DataFrame) -> DataFrame:
    """t, n: classes that hold each term. pairs: t, h."""
    own = pairs.distinct().join(classes_, "h", "left").select("t", F.coalesce("class", "h").alias("class"))
    return own.distinct().groupBy("t").agg(F.count("*").alias("n"))


def _pairs_of_words(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """t, h of all documents, by a join."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([pa.array([text_hash(x or b"") for x in as_bytes(part.column(1))], pa.int64()), part.column(2)], names=["h", "words"])

    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), words.alias("words")).mapInArrow(run, "h long, words array<string>")
    return hashed.select(F.explode("words").alias("t"), "h").join(terms, "t", "left_semi")


def disclosures(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, most: int = TERMS) -> DataFrame:
    """e, t, share, action: terms that reveal an entity; share is the part of its information that the term carries."""
    total = docs.count()
    alike = classes(found.select("h", "bands"))
    own = found.filter("entities is not null").select("h", "entities", "terms").join(alike, "h", "left").select(F.coalesce("class", "h").alias("class"), "entities", "terms")
    own = write_shared(own.groupBy("class", "entities", "terms").agg(F.count("*").alias("rows")), "pii-alike")  # copies go on as one row
    each = own.select(F.explode("entities").alias("e"), "class").distinct().groupBy("e").agg(F.count("*").alias("n_e")).filter("n_e > 1")  # with one document, P = 0
    each = write_shared(each, "pii-entities")
    pairs = own.select(F.explode("entities").alias("e"), "terms", "class").join(each.select("e"), "e", "left_semi").select("e", F.explode("terms").alias("t"), "class").distinct()
    both = write_shared(pairs.groupBy("e", "t").agg(F.count("*").alias("n_et")).filter("n_et > 1").join(each, "e"), "pii-pairs")
    info = F.log2(F.lit(float(total)) / F.col("n_e"))

    def share(n: Column) -> Column:
        return F.round(F.when(info > 0, F.log2((F.col("n_et") - 1) / n * float(total) / F.col("n_e")) / info).otherwise(0.0), 12)

    terms = both.select("t").distinct()
    some = [r["t"].encode() for r in terms.limit(most + 1).collect()]  # at most `most` + 1 rows
    if len(some) <= most:
        copies = _copy_map(alike)
        alone = write_shared(_held_terms(docs, some, copies, True).groupBy("t").agg(F.sum("n").alias("alone")), "pii-alone")
        # No more texts than those without copies: a term that is too frequent among them can't reveal its entity.
        able = write_shared(both.join(alone, "t", "left").filter(share(F.greatest(F.coalesce("alone", F.lit(0)), F.col("n_et"))) >= generalise), "pii-able")
        rest = [r["t"].encode() for r in able.select("t").distinct().collect()]  # at most `most` rows
        copied = _by_class(_held_terms(docs, rest, copies, False), alike)
        counted = able.join(copied, "t", "left").withColumn("n_t", F.coalesce("alone", F.lit(0)) + F.coalesce("n", F.lit(0)))
    else:
        counted = both.join(_by_class(_pairs_of_words(docs, terms), alike), "t").withColumn("n_t", F.col("n"))
    joined = counted.withColumn("share", share(F.greatest(F.col("n_t"), F.col("n_et")))).select("e", "t", "share").filter(F.col("share") >= generalise)
    return joined.withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, most: int = TERMS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and terms (start, end, action): a row for each row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = write_shared(_detected(own), "pii")
    reveal = disclosures(found, own, generalise, remove, most).groupBy("t").agg(F.max("action").alias("action"))  # 'remove' over 'generalise'
    reveal = write_shared(reveal, "pii-terms")
    wanted = {r["t"]: r["action"] for r in reveal.limit(most + 1).collect()}  # at most `most` + 1 rows
    columns = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256"]
    if len(wanted) <= most:
        return _marked(own, wanted).select(*columns, "spans")
    marked = write_shared(_marked(own, None), "pii-words")
    words = marked.select("uid", F.explode("words").alias("x")).select("uid", "x.*")
    terms = words.join(reveal, "t").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("action", "start", "end"))).alias("terms"))
    added = F.transform("terms", lambda x: F.concat_ws(":", x["action"], x["start"].cast("string"), x["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("spans") != "", F.col("spans")), F.when(F.size("terms") > 0, F.array_join(added, ",")))
    return marked.drop("words").join(terms, "uid", "left").select(*columns, spans.alias("spans"))


def sanitise(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """docs with text sanitised by spans (doc_id, spans; ids must be unique): entities and generalised terms by their kind, removed terms gone."""
    joined = docs.join(spans.select("doc_id", F.col("spans").alias("__p_spans")), "doc_id", "left")
    names = docs.columns
    kinds = {**{k: f"<{k}>" for k in KINDS}, "generalise": "<term>", "remove": ""}

    def run(batches):
        for batch in batches:
            texts, marks = batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist()
            out = []
            for t, m in zip(texts, marks, strict=True):
                if t is not None and m:
                    at, parts = 0, []
                    for kind, a, b in sorted((x.split(":") for x in m.split(",")), key=lambda x: (int(x[1]), -int(x[2]))):
                        if int(a) >= at:
                            parts += [t[at : int(a)], kinds[kind]]
                            at = int(b)
                    t = "".join([*parts, t[at:]])
                out.append(t)
            columns = [pa.array(out, batch.column(k).type) if n == text else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*[F.col(f"`{c}`") for c in names], "__p_spans").mapInArrow(run, docs.schema)
