"""Text functions on columns: normalisation, tokens, detectors. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import terms as D

TOKEN = r"[a-z][a-z0-9-]*|[가-힣]{2,}"


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean(text: Column) -> Column:
    """White space of any kind as one space, none at the ends. Text is taken to be in composed form."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def lower_clean(text: Column) -> Column:
    return F.lower(clean(text))


def is_hangul(word: Column) -> Column:
    return word.rlike("^[가-힣]+$")


def without_particle(word: Column, particles: str = D.TEXT_PARTICLES) -> Column:
    return F.regexp_replace(word, f"(?:{particles})$", "")


def anchors(text: Column) -> Column:
    """Anchors named in text. Longer aliases come first, and what one has matched no other can match."""
    aliases = sorted(((k, a) for k, own in D.ALIASES.items() for a in own), key=lambda x: -len(x[1]))
    own = [(key, r"\s*".join(alias.replace(" ", "")) if not alias.isascii() else rf"(?<![a-z0-9])\Q{alias}\E(?![a-z0-9])") for key, alias in aliases]
    none = F.array().cast("array<string>")

    keys = _array([key for key, _ in own])

    def step(acc: Column, k: Column) -> Column:
        # A case for each pattern: each is a literal, compiled once.
        left = reduce(lambda cases, x: cases.when(k == x[0], F.regexp_replace(acc["rest"], x[1], " ")), [(i, pattern) for i, (_, pattern) in enumerate(own)], F)
        return let(left, lambda rest: F.struct(rest.alias("rest"), F.when(rest != acc["rest"], F.concat(acc["found"], F.array(F.element_at(keys, k + 1)))).otherwise(acc["found"]).alias("found")))

    start = F.struct(lower_clean(text).alias("rest"), none.alias("found"))
    return F.when(may_name(text), F.array_distinct(F.aggregate(F.sequence(F.lit(0), F.lit(len(own) - 1)), start, step, lambda acc: acc["found"]))).otherwise(none)


def may_name(text: Column) -> Column:
    """False only of texts without Hangul that name no anchor, which are most: parts of words are looked for before any pattern is."""
    heads = sorted({a.split()[0] for own in D.ALIASES.values() for a in own if a.isascii()})
    parts = [h for h in heads if not any(o in h for o in heads if o != h)]
    hangul = "[가-힣]"

    def of(low: Column) -> Column:
        some = reduce(lambda x, y: x | y, [F.contains(low, F.lit(h)) for h in parts])
        return low.rlike(hangul) | (some & low.rlike(rf"(?<![a-z0-9])(?:{'|'.join(heads)})(?![a-z0-9])"))

    return let(F.lower(text), of)


def compatible(question: Column, text: Column) -> Column:
    wanted = anchors(question)
    return (F.size(wanted) == 0) | F.arrays_overlap(wanted, anchors(text))


def lexical_tokens(text: Column, entities: bool = True) -> Column:
    """Words; Korean words without their particle, and their pairs of letters; anchors."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))  # no token holds white space: nothing to clean

    def of(word: Column) -> Column:
        base = without_particle(word)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.concat(F.lit("ko:"), F.substring(word, i, F.lit(2))))
        return F.when(is_hangul(word), F.concat(F.array(F.when(base == "", word).otherwise(base)), pairs)).otherwise(F.array(word))

    own = F.when(text.rlike("[가-힣]"), F.flatten(F.transform(words, of))).otherwise(words)
    return F.concat(own, F.transform(anchors(text), lambda a: F.concat(F.lit("entity:"), a))) if entities else own


def query_terms(question: Column) -> Column:
    """At most 32 distinct terms of two letters or more; the aliases of anchors are added."""
    words = F.filter(F.regexp_extract_all(lower_clean(question), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*D.STOP_TERMS))

    def base(word: Column) -> Column:
        short = without_particle(word, D.QUESTION_PARTICLES)
        return F.when(is_hangul(word) & ~word.isin(*D.INTENT_TERMS) & (F.length(short) >= 2), short).otherwise(word)

    table = F.create_map(*[x for k, own in D.ALIASES.items() for x in (F.lit(k), _array(own))])
    more = F.flatten(F.transform(anchors(question), lambda a: table[a]))
    return F.slice(F.array_distinct(F.filter(F.concat(F.transform(words, base), more), lambda w: F.length(w) > 1)), 1, 32)


def minimal_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9-]*|[가-힣]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def term_matches(word: Column, text: Column) -> Column:
    """Korean terms as a part of the text without spaces, others as a whole word."""
    low = lower_clean(text)
    hangul = word.rlike("^[가-힣 ]+$")
    inside = F.contains(F.regexp_replace(low, r"\s+", ""), F.regexp_replace(word, r"\s+", ""))
    return F.when(hangul, inside).otherwise(F.regexp_count(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), word, F.lit(r"\E(?![a-z0-9])"))) > 0)


def looks_like_heading(line: Column) -> Column:
    own = F.trim(line)
    return (F.length(own) <= 60) & ~own.rlike(D.SENTENCE_END) & (own.rlike(D.NUMBERED_LINE) | own.isin(*D.HEADINGS))


def looks_like_running_header(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= 60) & (F.size(F.split(text, "\n")) <= 2) & ~text.rlike(D.HEADER_SENTENCE_END)


def page_label_candidate(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= 60) & ~F.contains(text, F.lit(" | ")) & ~text.rlike(D.SENTENCE_END) & ~text.rlike(D.DOSE) & text.rlike("[가-힣A-Za-z]")


def substantive_body(text: Column, headings: Column) -> Column:
    """What is left of the lines without headings and captions has 8 characters and a letter."""
    lines = F.filter(F.transform(F.split(text, "\n"), clean), lambda x: (x != "") & ~F.array_contains(headings, x) & ~x.rlike(D.CAPTION))
    body = F.array_join(lines, " ")
    return (F.length(body) >= 8) & body.rlike("[가-힣a-zA-Z]")


# What looks like the data of a patient, and identifiers by type.
PRIVATE = (
    r"(?<!\d)\d{6}\s*[-–]?\s*[1-8]\d{6}(?!\d)",
    r"(?<!\d)01[016789][ -]?\d{3,4}[ -]?\d{4}(?!\d)",
    r"(?i)(?:환자\s*(?:등록)?번호|등록번호|차트번호|MRN)\s*[:：#]?\s*\d{4,}",
    r"(?:환자\s*(?:성명|이름)|환자명)\s*[:：]\s*[가-힣]{2,5}",
    r"병실\s*번호\s*[:：#]\s*\d{2,}",
)


def looks_private(text: Column) -> Column:
    out = F.lit(False)
    for pattern in PRIVATE:
        out = out | text.rlike(pattern)
    return out


# Words and forms that set something before, during or after an event.
_EDGE = r"(?=$|[\s·‧/(),.\[\]]|으로|인|의)"
_STOP = r"(?=$|[\s·‧/(),.?!\[\]])"
_SUBJECT = r"[가-힣a-zA-Z0-9()/-]{2,}(?:\s+[가-힣a-zA-Z0-9()/-]{2,}){0,3}\s+"
PHASES = {
    "before": (r"(?<![가-힣a-z0-9])(?:사전|이전)(?![가-힣a-z0-9])", rf"(?<![가-힣])전(?:에|에는){_STOP}", rf"(?:하|되|시행|수행)기\s*전{_STOP}", rf"{_SUBJECT}전{_EDGE}", rf"[·‧/]\s*전{_EDGE}"),
    "during": (r"(?<![가-힣a-z0-9])동안(?![가-힣a-z0-9])", rf"(?<![가-힣])중(?:에)?{_STOP}", rf"(?:하는|시행하는|수행하는)\s*동안{_STOP}", rf"{_SUBJECT}중{_EDGE}", rf"[·‧/]\s*중{_EDGE}"),
    "after": (r"(?<![가-힣a-z0-9])이후(?![가-힣a-z0-9])", rf"(?<![가-힣])후(?:에)?{_STOP}", rf"(?:하고|한|시행하고|수행하고)\s*나서{_STOP}", rf"{_SUBJECT}후{_EDGE}", rf"[·‧/]\s*후{_EDGE}"),
}
_AT_EVENT = rf"(?<![가-힣a-zA-Z0-9])([가-힣a-zA-Z0-9()/-]{{2,}})\s*(?:시|할\s*때|하는\s*동안){_STOP}"
NO_EVENT = ("필요", "회복", "동의")


def temporal_phases(text: Column) -> Column:
    """Which of before, during and after the text names."""
    low = lower_clean(text)
    found = []
    for phase, patterns in PHASES.items():
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | low.rlike(pattern)
        if phase == "during":
            hit = hit | F.exists(F.regexp_extract_all(low, F.lit(_AT_EVENT), F.lit(1)), lambda s: ~s.isin(*NO_EVENT))
        found.append(F.when(hit, F.lit(phase)))
    return F.array_compact(F.array(*found))


def action_families(text: Column, roots: dict[str, tuple[str, ...]]) -> Column:
    def any_of(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(name)) for name, words in roots.items()]))


def split_attached_aspects(question: Column) -> Column:
    """A topic and the aspect written onto it become two words."""
    suffixes = "|".join(sorted(D.ASPECTS, key=len, reverse=True))
    particles = r"(?:에서는|으로는|에는|에서|은|는|을|를|이|가|에|의)?"
    return clean(F.regexp_replace(question, rf"(?<![가-힣])([가-힣]{{2,}}?)({suffixes})(?={particles}(?:\s|[?!,.]|$))", "$1 $2"))


def embedding_question(question: Column) -> Column:
    text = F.array_join(query_terms(question), " ")
    spaced = F.regexp_replace(text, r"([가-힣]{2,})(간호|관리|절차|목적)(?= |$)", "$1 $2")
    return F.when(spaced != "", spaced).otherwise(question)


def prefixed(text: Column, prefix: str) -> Column:
    """Text with the prefix, once."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length))


def keyword_counts(text: Column, word: Column) -> tuple[Column, Column]:
    """Occurrences as written, and without regard to white space."""

    def count(t: Column, w: Column) -> Column:
        return F.when(F.length(w) > 0, ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("long")).otherwise(F.lit(0).cast("long"))

    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return count(text, word), count(bare(text), bare(word))


def sentences(text: Column) -> Column:
    """Lines, cut after full stops, question and exclamation marks; trimmed, none empty."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def unwrapped_lines(text: Column, bullets: bool = True) -> Column:
    """Lines, each with those that go on from it: after a connective, or (with bullets) within a list item without an end.

    A line that starts a unit of its own, rows of tables, and what stands after an end mark or a blank line begin anew.
    """
    none = F.array().cast("array<string>")

    def joins(last: Column, line: Column) -> Column:
        open_item = last.rlike(D.BULLET) & ~last.rlike(D.TITLE_END) if bullets else F.lit(False)
        apart = line.rlike(D.UNIT_START) | F.contains(last, F.lit("|")) | last.rlike(D.TERMINAL)
        return (line != "") & (last != "") & ~apart & (last.rlike(D.GOES_ON) | open_item)

    def step(acc: Column, line: Column) -> Column:
        on = F.struct(acc["out"].alias("out"), F.concat_ws(" ", acc["last"], line).alias("last"))
        new = F.struct(F.when(acc["last"] != "", F.concat(acc["out"], F.array(acc["last"]))).otherwise(acc["out"]).alias("out"), line.alias("last"))
        return F.when(joins(acc["last"], line), on).otherwise(new)

    lines = F.transform(F.split(text, r"\R"), clean)
    folded = F.aggregate(lines, F.struct(none.alias("out"), F.lit("").alias("last")), step, lambda acc: F.when(acc["last"] != "", F.concat(acc["out"], F.array(acc["last"]))).otherwise(acc["out"]))
    return F.when(text.rlike(r"(?m)[가-힣]|^\s*[-•●▪Ÿ*※]"), folded).otherwise(F.filter(lines, lambda x: x != ""))  # no other text can have lines to join


def source_units(text: Column, bullets: bool = True) -> Column:
    """Statements of a source: its unwrapped lines, cut after end marks, but not after the point of a number."""
    cut = F.transform(unwrapped_lines(text, bullets), lambda x: F.split(x, r"(?<=[.!?。！？])(?<!\d\.)\s+"))
    return F.filter(F.transform(F.flatten(cut), clean), lambda x: x != "")


def selectable_unit(unit: Column, names: Column, first: Column, before: Column) -> Column:
    """True for whole statements and list items that aren't a name of the source, a title, or (for the first) an end of one before."""
    bare = lambda x: F.btrim(F.lower(clean(x)), F.lit(" .:："))
    named = F.array_contains(F.transform(names, bare), bare(unit))
    repeated = first & F.exists(F.coalesce(before, F.array().cast("array<string>")), lambda x: F.endswith(clean(x), unit))
    item = unit.rlike(r"^\s*[-•●▪Ÿ*※]\s*\S.{3,}") & ~unit.rlike("[→⇒]")
    return (unit != "") & ~named & ~repeated & (unit.rlike(D.STATEMENT_END) | item) & ~unit.rlike(D.TITLE_UNIT)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
