import hashlib
import math
import random
import re
from collections import Counter

import pytest
from corpora import SCHEMA
from pyspark.sql import functions as F

from quillspark.llm import boilerplate, copies, decontaminate, language, licences, pii, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.mark.parametrize("shard", [2_000_000, 200])
def test_decontamination_matches_brute_force(spark, shard):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["Ünïcode", "ΩMEGA"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate((13, 14, 30, 3, 1, 20))] + [(6, None), (7, ""), (8, "!!"), (9, None), (10, "w1 w2 w3")]
    items.append((11, items[2][1]))
    docs = [None, "", "?? --", "w1"]
    for _ in range(40):
        own = [rnd.choice(vocab) + "x" for _ in range(rnd.randint(0, 60))]
        k = rnd.choice([1, 2, 3, 5, 13, 20])
        item = words(items[rnd.randint(0, 5)][1])
        a = rnd.randint(0, len(item) - 1)
        at = rnd.randint(0, len(own))
        docs.append(" ,".join([*own[:at], *[w.upper() if w.isascii() else w for w in item[a : a + k]], *own[at:]]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(df, bench, shard_bytes=shard).collect()}
    for i, t in enumerate(docs):
        w, hit, found = words(t), set(), set()
        for item_id, body in items:
            own = words(body)
            n = min(13, len(own))
            wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item_id))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found)), i
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert sum(len(words(t[s["start"] : s["end"]])) for s in r["spans"]) == len(hit)
    clean = decontaminate.decontaminated(df, bench, shard_bytes=shard)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i in got if not got[i]["contaminated"]}
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == len(docs)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark):
    rnd = random.Random(4)
    bits = ["a.b@c.de", "@", "x@y", "x@y.", "@y.com", "a@b.c@d.e", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "++12 345 678 90", "é", " ", "--", "9" * 25, "\n"]
    docs = [None, "", *["".join(rnd.choice(bits) + rnd.choice([" ", "", "x"]) for _ in range(rnd.randint(1, 12))) for _ in range(300)], "a" * 20000, "1" * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, t in enumerate(docs):
        base = brute_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (i, t, got[i]["spans"], base)
        assert got[i]["spans"].startswith(base)
    assert pii.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_pii_terms_that_reveal_are_marked(spark, most):
    rnd = random.Random(20)
    apart = lambda: " ".join(rnd.sample([f"w{k}" for k in range(40)], 12))  # noqa: E731  no copies of one text
    docs = [f"filler{i} {apart()} here. Write to zorblatt qux@mail.com about quuxly things, {apart()}" for i in range(6)] + [f"plain {apart()} write to here about things, {apart()} filler{i}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(df, most=most).collect()}
    t = docs[0]
    assert f"remove:{t.index('zorblatt')}:{t.index('zorblatt') + 8}" in found[0] and "things" not in [t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in found[0].split(",")]
    assert all(found[i] == "" for i in range(6, len(docs)))
    safe = {r["doc_id"]: r["text"] for r in pii.sanitise(df, pii.find(df, most=most)).collect()}
    assert "zorblatt" not in safe[0] and "<email>" in safe[0] and safe[7] == docs[7]


@pytest.mark.parametrize("most", [200_000, 0])
def test_pii_terms_far_from_the_entity_are_marked_in_all_documents(spark, most):
    rnd = random.Random(5)
    gap = " ".join(["plain", "words", "here"] * 10)
    mixed = lambda: " ".join(rnd.sample(["plain", "words", "here", *[f"n{k}" for k in range(20)]], 15))
    docs = [f"Zorblatt {mixed()} qux@mail.com {mixed()} zorblatt é" for _ in range(4)] + [f"{gap} only ZORBLATT, twice zorblatt"] + [f"{mixed()} é only twice {rnd.randint(0, 10**9)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(df, most=most).collect()}
    for i, t in enumerate(docs[:5]):
        want = [f"{m.start()}:{m.end()}" for m in re.finditer("zorblatt", t, re.I)]
        assert [x.partition(":")[2] for x in found[i].split(",") if not x.startswith("email") and t[int(x.split(":")[1]) : int(x.split(":")[2])].lower() == "zorblatt"] == want
    assert found[0].startswith("email:") and all(found[i] == "" for i in range(5, len(docs)))
    safe = {r["doc_id"]: r["text"] for r in pii.sanitise(df, pii.find(df, most=most)).collect()}
    assert not any("zorblatt" in safe[i].lower() for i in safe)


def brute_pii_spans(texts):
    """Base spans, then all occurrences of the terms that reveal an entity, by counts over all documents."""
    held = []
    for t in texts:
        base = [tuple(x.split(":")) for x in brute_pii(t or "").split(",") if x]
        taken = [(int(a), int(b)) for _, a, b in base]
        entities = {(k, t[int(a) : int(b)].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[int(a) : int(b)])) for k, a, b in base}
        terms = [(m[0].translate(LOWER), m.start(), m.end()) for m in WORD.finditer((t or "").translate(LOWER)) if all(b <= m.start() or a >= m.end() for a, b in taken)]
        held.append((base, frozenset(entities), terms, frozenset(x for x, _, _ in terms)))
    anywhere = [set(words(t)) for t in texts]
    copy, by = list(range(len(texts))), {}

    def least(k):
        while copy[k] != k:
            k = copy[k]
        return k

    for k, t in enumerate(texts):  # near copies count as one: texts that are equal or share a group of minima
        for band in [("text", t or ""), *enumerate(copies.bands((t or "").encode()))]:
            a, b = sorted((least(k), least(by.setdefault(band, k))))
            copy[b] = a
    copy = [least(k) for k in range(len(texts))]
    action = {}
    for e in {e for _, own, _, _ in held for e in own}:
        of = [k for k in range(len(texts)) if e in held[k][1]]
        n_e = len({copy[k] for k in of})
        info = math.log2(len(texts) / n_e)
        for term in set().union(*(held[k][3] for k in of)):
            both = {copy[k] for k in of if term in held[k][3]}
            if len(both) > 1 and info > 0:
                p = (len(both) - 1) / len({copy[k] for k, x in enumerate(anywhere) if term in x})
                share = round(math.log2(p * len(texts) / n_e) / info, 12)
                if share >= pii.GENERALISE:
                    action[term] = max(action.get(term, ""), "remove" if share >= pii.REMOVE else "generalise")
    return [",".join([*(":".join(x) for x in base), *(f"{k}:{a}:{b}" for k, a, b in sorted((action[x], a, b) for x, a, b in terms if x in action))]) for base, _, terms, _ in held]


@pytest.mark.parametrize("most", [200_000, 0])
def test_all_spans_of_personal_data_match_brute_force(spark, most):
    rnd = random.Random(18)
    people = [(f"p{i}@x{i}.org" if i % 2 else f"10.0.0.{i}", [f"nick{i}", f"town{i}", "É" + "x" * i]) for i in range(12)]
    common = [f"word{i}" for i in range(40)]
    texts = [None, "", "no data"]
    for _ in range(260):
        own = rnd.choices(common, k=rnd.randint(3, 30)) + [f"rare{rnd.randint(0, 400)}" for _ in range(3)]
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            entity, near = rnd.choice(people)
            own += [entity if rnd.random() < 0.9 else ""] + [x.upper() if rnd.random() < 0.3 and x.isascii() else x for x in near if rnd.random() < 0.7]
        rnd.shuffle(own)
        texts.append(" ".join(own))
    texts += [texts[10]] * 5 + [texts[k] + f" more{k}" for k in (20, 21, 22) for _ in range(3)] + ["single@copy.net unheardof words"]
    df = spark.createDataFrame([(i % 250, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip long").repartition(5)
    got = sorted((r["doc_id"], r["spans"]) for r in pii.find(df, most=most).collect())
    want = brute_pii_spans(texts)
    assert got == sorted((i % 250, s) for i, s in enumerate(want))
    assert sum("remove" in s for s in want) > 20 and sum("generalise" in s for s in want) > 20
    assert want[-1] == "email:0:15"


def test_copies_of_one_text_reveal_nothing(spark):
    rnd = random.Random(21)
    fill = [f"filler{i}" for i in range(300)]
    page = rnd.sample(fill, 60)
    near = []
    for _ in range(12):  # about one word of sixty is another: a similarity of 0.8
        near.append(" ".join(["zorblatt", *[w if rnd.random() > 0.016 else rnd.choice(fill) for w in page], "qux@mail.com", "wibble"]))
    spread = [" ".join(["wobble", *rnd.sample(fill, 30), "real@mail.com"]) for _ in range(4)]
    spread += [spread[0]] * 30  # copies don't hide a term that others reveal as well
    docs = near + near[:3] + spread + [" ".join(rnd.sample(fill, 40)) for _ in range(300)]
    marked = set()
    for r in pii.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect():
        marked |= {docs[r["doc_id"]][int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k != "email"}
    assert marked == {"wobble"}


def test_terms_are_marked_at_both_ends_without_the_fillers(spark):
    rnd = random.Random(19)
    fill = [f"filler{i}" for i in range(60)]
    docs = [f"zorblatt {' '.join(rnd.sample(fill, 30))} write to zorblatt qux@mail.com" for _ in range(6)] + [" ".join(["write", "to", *rnd.sample(fill, 30)]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in pii.find(df).collect():
        t = docs[r["doc_id"]]
        marked = [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k != "email"]
        assert marked == (["zorblatt"] * 2 if r["doc_id"] < 6 else [])


def test_secrets(spark):
    rnd = random.Random(6)
    bits = ["password=", "API_KEY : ", 'token = "', "secret: token: ", "passwd", "AKIA" + "A1" * 9, "AKIAAKIA12", "deadbeef" * 4, "abc123" * 5, "hunter2x", "short", " ", "é", "\n", "ÀÀ"]
    docs = [None, "", *["".join(rnd.choice(bits) + rnd.choice(["", " ", "="]) for _ in range(rnd.randint(1, 9))) for _ in range(150)]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan(df).select("doc_id", secrets.digest(F.col("spans")).alias("s")).collect()}
    kinds = [("assign", re.compile(secrets.ASSIGN), 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)]
    for i, t in enumerate(docs):
        want = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[2] if n == "assign" else m[0]) >= least)
        assert [x for x in got[i].split(",") if x and not x.startswith("entropy")] == [x for *_, x in want], (i, t)
    assert secrets.scan(df.limit(0)).count() == 0


def test_window_entropy_and_redaction(spark):
    def entropy(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))

    own = ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "aaaaaaaaaaaaaaaaaaaaa1", "short", "aZ9" * 20]
    for w, v in spark.createDataFrame([(w,) for w in own], "w string").select("w", secrets.window_entropy(F.col("w"))).collect():
        assert v == pytest.approx(max([entropy(w[i : i + 16]) for i in range(len(w) - 15)] or [0.0]))
    df = spark.createDataFrame([(1, "key aB3kZ9qLmN0pRtUvWxY2 and your_key_EXAMPLE_123456789 ok"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(df).orderBy("doc_id").collect()] == ["key [entropy] and your_key_EXAMPLE_123456789 ok", ""]


def test_secrets_of_digits_of_letters_and_beside_base_spans(spark):
    key, other, code = "kqXvTzRwPjLmNbHsYdGfcAeQiOuVxZrW", "aB3kZ9qLmN0pRtUvWxY2", "0123456789abcdef" * 2
    secret = [key, key.lower(), key.upper(), "83920175648203917465", "4929-1384-8076-5521-0937", f"{key}42", other]
    names = ["self-contained-backward-compatible", "src/main/java/org/apache/spark", "AbstractSingletonProxyFactoryBean", "internationalizationOfThings12", "Donaudampfschifffahrtsgesellschaft", "=" * 30, "2024-01-02_10-11-12-123", "2024-01-02/2024-02-03", "your_key_EXAMPLE_83920175648203917465"]
    run = f"{other}_{code}_{key}"
    docs = [f"see {w} there" for w in secret + names] + [f"x {run} y", f"{key}_token={code}"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan(df).select("doc_id", secrets.digest(F.col("spans")).alias("s")).collect()}
    for i, w in enumerate(secret + names):
        assert got[i] == (f"entropy:4:{4 + len(w)}" if w in secret else ""), w
    assert got[len(docs) - 2] == "entropy:2:23,hex:23:55,entropy:55:88"
    assert got[len(docs) - 1].startswith(f"entropy:0:{len(key) + 1},assign:{len(key) + 1}:")


def brute_secrets(t):
    """All spans: base patterns, then windows counted anew at each place of the runs outside them."""
    kinds = [("assign", re.compile(secrets.ASSIGN), 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)]
    found = [(m.start(), k, m.end()) for k, (n, p, least) in enumerate(kinds) for m in p.finditer(t) if len(m[2] if n == "assign" else m[0]) >= least]
    free = list(t)
    for a, _, b in found:
        free[a:b] = " " * (b - a)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", "".join(free)):
        w = m[0]
        letters = re.search("[A-Za-z]", w)
        odd = sum(bool(re.match(secrets.ODD_PAIRS, w[i : i + 2], re.I)) for i in range(len(w) - 1))
        plain = re.sub(r"(?<=[A-Za-z])[0-9]{1,3}(?![A-Za-z0-9])", "", w)
        snake = re.fullmatch("[a-z0-9_]*", w) and w.count("_") >= 2 and 4 * len(re.findall("[0-9]", w)) <= len(w)
        words = letters and (snake or re.fullmatch(r"[A-Za-z/_+=-]*[0-9]{0,4}", plain)) and odd <= max(1, len(w) // 20) and 5 * len(re.findall("[a-z](?=[A-Z])", w)) <= len(w)
        if not re.search("[A-Za-z0-9]", w) or words or re.search(r"(?<![A-Za-z])(?i:example|sample|placeholder|dummy|changeme|your[_-]|x{6,})(?![a-z])", w) or re.fullmatch("(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", w):
            continue
        bar = 2.5 if not letters else 3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else 3.3 if w.isalpha() else 3.4
        most = max(math.log2(16) - sum(v.count(c) * math.log2(v.count(c)) for c in set(v)) / 16 for v in (w[i : i + 16] for i in range(len(w) - 15)))
        if most >= bar - 1e-9:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_all_spans_of_secrets_match_brute_force(spark):
    rnd = random.Random(16)
    alphabets = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", secrets.ALPHABET, "ab", "aB3", "aaaab1"]
    words = ["plain", "words", "token=", "password: ", 'secret="', "api_key=", "AKIA", "self-contained-backward-compatible", "your_key_EXAMPLE", "é", "\n", "123e4567-e89b-12d3-a456-426614174000", "deadbeef" * 3 + "apikey=abcdefg"]

    def key():
        return "".join(rnd.choices(rnd.choice(alphabets), k=rnd.choice([5, 15, 16, 19, 20, 24, 40, 90])))

    docs = ["".join((key() if rnd.random() < 0.6 else rnd.choice(words)) + rnd.choice([" ", " ", "", "_"]) for _ in range(rnd.randint(1, 40))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan(df).select("doc_id", secrets.digest(F.col("spans")).alias("s")).collect()}
    for i, t in enumerate(docs):
        assert got[i] == brute_secrets(t), (i, t)
    assert sum("entropy" in x for x in got.values()) > 50


def test_secrets_in_very_long_texts(spark):
    rnd = random.Random(17)
    n = 300_000
    docs = ["a-" * n + "1b2", "2024-01-02" + "-12" * n, "".join(rnd.choices(secrets.ALPHABET, k=n)), "aB3kZ9qLmN0pRtUvWxY2 token=abcdef12 " * 5000, "\n" * n]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan(df).select("doc_id", F.col("spans").alias("s")).collect()}
    assert [len(got[i]) for i in range(5)] == [0, 0, 1, 10_000, 0]
    assert tuple(got[3][-1]) == (len(docs[3]) - 15 - 0, 0, len(docs[3]) - 1)
    assert secrets.redact(df.filter("doc_id = 3")).first()["text"] == "[entropy] [assign] " * 5000


def test_language_held_out_accuracy(spark):
    rnd = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi", "re"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["eau", "tion", "ment", "oi"]}
    rows = []
    for i in range(400):
        name = rnd.choice(sorted(parts))
        rows.append((i, " ".join("".join(rnd.choice(parts[name]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(4, 60))), name))
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (1003, "kalomire " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(df, language.sample(df)).withColumn("held", language.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["held"] and r["lang"] and r["doc_id"] < 1000]
    assert len(held) > 50 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in language.predict(df, {}).collect())


def test_suffix_automaton_accepts_substrings():
    text = b"abracadabra banana"
    go = language.suffix_automaton(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            state = 0
            for c in text[i:j]:
                state = go[state][c]
    assert ord("z") not in go[0]


def test_licences(spark):
    docs = [(1, "Hello and welcome to this rather long first line.\nReleased under the MIT license!\nand bye to all"), (2, licences.TEMPLATES[1][1]), (3, "nothing of the kind"), (4, None), (5, ""), (6, "LICENSED under the Apache License -- version 2.0"), (6, "LICENSED under the Apache License -- version 2.0")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, licence string")
    got = sorted((r["doc_id"], r["line"], r["licence"]) for r in licences.scan(df).collect())
    assert got == [(1, 2, "MIT"), (2, 1, "Apache-2.0"), (6, 1, "Apache-2.0"), (6, 1, "Apache-2.0")]
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_as_they_stand_in_files(spark):
    import textwrap

    by = {}
    for name, body in licences.TEMPLATES:
        by[name] = max(by.get(name, ""), body, key=len)
    rnd = random.Random(21)
    noise = [" ".join(rnd.choice(["alpha", "of the", "copyright", "software", "license", "beta", "the terms", "public"]) for _ in range(60)) for _ in range(8)]
    mit = "The MIT License (MIT)\n\nCopyright (c) 2019 A. Nother\n\n" + textwrap.fill(by["MIT"], 78)
    docs = [
        (mit, {("MIT", 5)}),
        ("#!/usr/bin/env python\n" + textwrap.indent(textwrap.fill("Copyright 2020 X. " + by["GPL-3.0"], 70), "# ") + "\nimport os\n" * 50, {("GPL-3.0", 2)}),
        ("/*\n" + textwrap.indent(textwrap.fill(by["Apache-2.0"], 60), " * ") + "\n */\nint main() {}", {("Apache-2.0", 2)}),
        ("Copyright (c) 2001, The Regents\nAll rights reserved.\n\n" + textwrap.fill(by["BSD-3-Clause"].replace("copyright holder nor", "Regents nor"), 72), {("BSD-3-Clause", 4)}),
        (textwrap.fill(by["BSD-2-Clause"], 50), {("BSD-2-Clause", 1)}),
        ("Released under the MIT License. See the LICENSE file for details of the terms.", {("MIT", 1)}),
        ("\n".join([*noise[:3], mit, *noise[3:]]) + "\n" + textwrap.fill(by["Zlib"], 40), {("MIT", 8), ("Zlib", 8 + len(textwrap.wrap(by["MIT"], 78)) + 5)}),
        ("\n".join(noise * 400), set()),
        ("word\n" * 100_000 + by["ISC"], {("ISC", 100_001)}),
        (" ".join(by["MIT"].split()[:30]), set()),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(docs)], "doc_id long, text string, at int")
    got = licences.scan(df).collect()
    assert {i: {(r["licence"], r["line"]) for r in got if r["doc_id"] == i} for i in range(len(docs))} == {i: x for i, (_, x) in enumerate(docs)}
    assert all(r["dice"] >= 0.9 for r in got)
    for k, (name, body) in enumerate(licences.TEMPLATES):
        assert any(w in licences.words_of(body) for w in licences.needed_words(licences.TEMPLATES)), k


def test_line_dedup(spark, docs, no_docs):
    own = [(i, f"own text number {i} goes on and on\n  Subscribe now \nmore of {i} here\nrare {i % 3}", "en", f"s{i % 10}", 0, "", "") for i in range(40)] + [(100, "Subscribe now", "en", "s1", 0, "", ""), (101, None, "en", None, 0, "", ""), (102, "", "en", "s1", 0, "", "")]
    df = spark.createDataFrame(own, SCHEMA)
    got = {r["doc_id"]: r for r in boilerplate.clean(df, counts=True).collect()}
    assert len(got) == len(own)
    assert got[0]["text"] == "own text number 0 goes on and on\nmore of 0 here" and got[0]["__b_removed"] == 2
    assert got[100]["text"] == "" and got[101]["text"] is None and got[102]["text"] == ""
    assert boilerplate.clean(docs).columns == docs.columns and boilerplate.clean(docs).count() == docs.count()
    assert boilerplate.clean(no_docs).count() == 0


@pytest.mark.parametrize("clash", ["id", "mark", "pos", "site", "__x"])
def test_line_dedup_of_rows_with_one_id_long_texts_and_clashing_names(spark, clash):
    rnd = random.Random(9)
    shared = [f"shared {i}" for i in range(3000)]
    texts = ["\n".join(rnd.sample(shared, 2900) + [f"own {i} {j}" for j in range(200)]) for i in range(9)] + ["a\nshared 1\n\nshared 2", "shared 1\nb", "shared 1\nb", None]
    rows = [(5 if i > 8 else i, t, f"s{i}", "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, `{clash}` string").repartition(4)
    sites = {}
    for _, t, site, _ in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x.strip(" \t\r"), set()).add(site)
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x.strip(" \t\r")]) < 8)) for i, t, _, _ in rows]
    got = boilerplate.clean(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_lines_that_only_copies_spread_are_no_boilerplate(spark):
    import corpus_pipeline

    own = [(i, f"own text number {i} goes on and on\nSubscribe now\nAll rights reserved here", "en", f"s{i % 10}", 0, "", "") for i in range(40)]
    own += [(100, "Subscribe now\nshort\nAll rights reserved here", "en", "s1", 0, "", ""), (101, "Subscribe now", "en", "s2", 0, "", "")]
    own += [(i, "copy\nAll rights reserved here\nSubscribe now", "en", f"s{i % 3}", 0, "", "") for i in (102, 103)]
    own += [(200 + i, "a page of which\nthere are copies\n \non many sites", "en", f"s{i}", 0, "", "") for i in range(12)]
    own += [(220 + i, "on many sites\nthere are copies\na page of which", "en", f"t{i}", 0, "", "") for i in range(3)]
    df = spark.createDataFrame(own, SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert len(got) == len(own) and got[0] == ("own text number 0 goes on and on", 32)
    assert got[100] == ("short", 5) and got[101] == ("", 0) and got[102] == got[103] == ("copy", 4)
    assert all(got[i][0] == t for i, t, *_ in own if i >= 200)
    plain = {r["doc_id"]: r["text"] for r in boilerplate.clean(df).collect()}
    assert plain[200].strip() == "" and plain[0] == got[0][0]


def test_names_of_code_are_no_secrets_and_keys_are(spark):
    import string
    import sysconfig
    from pathlib import Path

    root = Path(sysconfig.get_paths()["stdlib"])
    names = set()
    for f in sorted(root.glob("*/*.py"))[:400]:
        names.add(f"usr/lib/python3/{f.relative_to(root).with_suffix('')}")
        names |= set(re.findall(r"\b[A-Za-z_][A-Za-z_0-9]{19,}\b", f.read_text(errors="replace")))
    names = random.Random(1).sample(sorted(n for n in names if re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", n)), 500)
    names += ["src/main/java/org/apache/spark/sql/catalyst", "getElementsByClassNameAndSelector", "/usr/local/lib/python3/site-packages/numpy/core", "com/google/android/gms/auth/api2/signin", "sha256-of-the-quick-brown-fox-jumps"]
    rnd = random.Random(2)
    kinds = {"b62": string.ascii_letters + string.digits, "b64": string.ascii_letters + string.digits + "+/", "small": string.ascii_lowercase, "letters": string.ascii_letters}
    rows = [("name", n) for n in names] + [(f"{k} {n}", "".join(rnd.choice(own) for _ in range(n))) for k, own in kinds.items() for n in (20, 32, 40) for _ in range(200)]
    df = spark.createDataFrame([(i, f"see {x} here") for i, (_, x) in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = Counter(rows[r["doc_id"]][0] for r in secrets.scan(df).collect() if any(x["kind"] == 3 for x in r["spans"]))
    assert found["name"] <= 0.05 * len(names)
    assert all(found[f"{k} {n}"] >= 0.97 * 200 for k in kinds for n in (32, 40)) and all(found[f"{k} 20"] >= 0.97 * 200 for k in ("b62", "b64"))
    assert found["small 20"] >= 0.8 * 200 and found["letters 20"] >= 0.9 * 200
    assert not any(x["kind"] == 3 for r in secrets.scan(spark.createDataFrame([(i, x) for i, x in enumerate(names[500:])], "doc_id long, text string")).collect() for x in r["spans"])
