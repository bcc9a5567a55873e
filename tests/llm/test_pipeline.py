import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_jaccard import brute as brute_groups
from test_packing import ids_of
from test_rules import brute as measured

import corpus_pipeline as P

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns, name
        assert docs.count() <= seen and docs.count() > 0
        seen = docs.count()
    packed = P.STAGES[-1][1](spark, docs, DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    run = P.run(spark, DIR)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string"


def corpus():
    """Rows for each rule, boilerplate of many sites, copies exact and near, contaminated rows, nulls and repeated rows."""
    rnd = random.Random(31)
    vocab = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    items = [(k, prose(n)) for k, n in enumerate((30, 14, 13, 6))] + [(9, None)]
    rows = [(i, f"{prose(40)}\nShared notice of all the sites\n{prose(30)}", f"site{i % 12}") for i in range(40)]
    page = "\n".join(prose(12) for _ in range(6))
    rows += [(100 + i, page, f"site{i}") for i in range(10)]  # lines of a copy are on many sites, too
    near = prose(200).split()
    rows += [(200 + i, " ".join(w if (k + i) % 97 else "changed" for k, w in enumerate(near)), f"site{i % 3}") for i in range(6)]
    rows += [(300 + k, f"{prose(20)} {t} {prose(20)}", "site1") for k, t in items if t]
    rows += [(400, "short", "a"), (401, None, "a"), (402, "", None), (403, "word " * 60, "a"), (404, "# $ % " * 40 + prose(30), "a"), (405, prose(30).upper(), "a"), (406, "Shared notice of all the sites\n" * 2 + prose(25), None)]
    rows += [rows[0], rows[41], (7, prose(50), "a"), (None, prose(60), "b"), (500, prose(20_000), "c")]
    return [(i, t, "xx", s, len(t or ""), "clash") for i, t, s in rows], items


def brute_rules(t):
    n_words, _, n_symbols, _, n_repeat = measured(t)
    t = t or ""
    return n_words >= 20 and 100 * n_repeat <= 30 * n_words and 100 * n_symbols <= 30 * n_words and len(re.findall("[A-Z]", t)) <= len(re.findall("[a-z]", t))


def brute_lines(rows):
    bare = lambda x: x.strip(" \t\r")
    sites, sets = defaultdict(set), defaultdict(set)
    for r in rows:
        own = [bare(x) for x in (r[1] or "").split("\n")]
        for x in own:
            sites[x].add(r[3] or "")
            sets[x].add(frozenset(own) - {""})
    out = []
    for r in rows:
        t = r[1]
        if t is not None:
            t = "\n".join(x for x in t.split("\n") if not bare(x) or len(sites[bare(x)]) < 8 or len(sets[bare(x)]) < 8)
        out.append((r[0], t, r[2], r[3], len(t) if t is not None else None, r[5]))
    return out


def brute_copies(rows):
    """One row of each group: of the rows with the group's least key, where rows with one id and text are one."""
    own = sorted({(r[0] is None, r[0] or 0, r[1] or ""): r for r in rows}.values(), key=str)
    found = brute_groups([r[1] for r in own], 5, 80)
    groups = defaultdict(list)
    for r, (n, c) in zip(own, found, strict=True):
        groups[c if n else ("alone", r[0], r[1])].append(r)
    return groups


def brute_contaminated(t, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words_of = lambda x: word.findall((x or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit = words_of(t), set()
    for _, body in items:
        own = words_of(body)
        n = min(13, len(own))
        wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_run_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = brute_lines([r for r in rows if brute_rules(r[1])])
    groups = brute_copies(kept)
    assert any(len(own) >= 9 for own in groups.values()) and sum(len(own) > 3 for own in groups.values()) == 2
    possible = [[r for r in own if not brute_contaminated(r[1], items)] for own in groups.values()]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    got = Counter(tuple(r) for r in docs.collect())
    for own in possible:
        assert sum(got[r] for r in own) <= 1
    sure = {own[0] for own in possible if len(own) == 1 and len({r for g in groups.values() if own[0] in g for r in g}) == 1}
    assert sure <= set(got) <= {r for own in possible for r in own} and max(got.values()) == 1
    clean = [own for own, whole in zip(possible, groups.values(), strict=True) if len(own) == len(whole)]
    assert all(any(got[r] for r in own) for own in clean)
    want = Counter((r[0], len(ids), zlib.crc32(np.array(ids[a : a + 1024], "<u4").tobytes())) for r, ids in zip(got, ids_of([r[1] for r in got]), strict=True) for a in range(0, len(ids), 1024) if len(ids) - a >= 1024)
    pieces = P.run(spark, str(tmp_path)).collect()
    assert want <= Counter((p["doc_id"], p["doc_tokens"], p["ids_crc32"]) for p in pieces)
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r[0] for r in got)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids_of([r[1] for r in got])))
    filled = Counter()
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    assert sorted(filled.values())[1:] == [1024] * (len(filled) - 1)
