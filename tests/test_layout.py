"""Layout from positioned words, by hand and against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import layout as L

WORDS = "page long, text string, x0 double, x1 double, top double, bottom double"


def put(page, top, *segments):
    """Words of a line: segments are (x, text); letters are 6 wide."""
    out = []
    for x, text in segments:
        for word in text.split(" "):
            out.append((page, word, float(x), float(x + 6 * len(word)), float(top), float(top + 10)))
            x += 6 * (len(word) + 1)
    return out


def read(spark, words, seed=1):
    words = list(words)
    random.Random(seed).shuffle(words)
    rows = L.lines(spark.createDataFrame(words, WORDS)).cache()
    return rows, L.table_rows(L.cells(rows))


PAGE = [
    *put(1, 0, (50, "Doses of the ward")),
    *put(1, 40, (50, "drug"), (200, "dose"), (300, "unit")),
    *put(1, 52, (50, "first drug"), (205, "10"), (300, "mg")),
    *put(1, 64, (50, "second"), (300, "ml")),
    *put(1, 76, (50, "third"), (210, "see the note below")),
    *put(1, 110, (50, "After the table.")),
    *put(1, 122, (50, "Its end.")),
]


def test_text_of_a_page_keeps_rows_and_order(spark):
    rows, grid = read(spark, PAGE)
    want = "Doses of the ward\n\ndrug | dose | unit\nfirst drug | 10 | mg\nsecond |  | ml\nthird | see the note below | \n\nAfter the table.\nIts end."
    assert [r["text"] for r in L.page_text(rows, grid).collect()] == [want]


def test_a_cell_over_two_columns_spans_them(spark):
    rows, _ = read(spark, PAGE)
    found = {(r["row"], r["col"]): r["span"] for r in L.cells(rows).collect()}
    assert found[(3, 2)] == 2 and all(v == 1 for k, v in found.items() if k != (3, 2)) and (2, 2) not in found


def test_any_order_of_words_gives_the_same_page(spark):
    texts = set()
    for seed in range(3):
        rows, grid = read(spark, PAGE, seed)
        texts.add(L.page_text(rows, grid).first()["text"])
    assert len(texts) == 1


def test_no_word_of_a_random_page_is_lost(spark):
    rng, words, want = random.Random(4), [], {}
    for page in range(12):
        top, told = 0, []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                n, k = rng.randint(1, 5), rng.randint(2, 4)
                body = [[f"p{page}r{rng.randint(0, 999)}" for _ in range(k)] for _ in range(n)]
                for row in body:
                    words += put(page, top, *[(50 + 100 * i, c) for i, c in enumerate(row)])
                    top += 12
                told.append("\n".join(" | ".join(r) for r in body))
            else:
                text = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4))]
                for line in text:
                    words += put(page, top, (50, line))
                    top += 12
                if told and told[-1].startswith("\0"):
                    told[-1] += "\n" + "\n".join(text)
                else:
                    told.append("\0" + "\n".join(text))
            top += 30
        want[page] = "\n\n".join(told).replace("\0", "")
    rows, grid = read(spark, words)
    assert {r["page"]: r["text"] for r in L.page_text(rows, grid).collect()} == want


def chunks(spark, rows):
    return spark.createDataFrame(rows, "page long, position int, parent int, text string")


def kept(spark, words, of):
    rows, grid = read(spark, words)
    return sorted((r["page"], r["mode"], r["row"], r["text"], tuple(r["chunks"])) for r in L.records(rows, grid, chunks(spark, of)).collect())


def test_rows_are_linked_to_chunks_by_a_quarter_of_the_best_share(spark):
    of = [(1, 0, 0, "first drug ten mg"), (1, 1, 0, "second ml"), (1, 2, 1, "nothing alike")]
    got = {r[2]: r for r in kept(spark, PAGE, of)}
    assert got[1] == (1, "cells", 1, "first drug 10 mg", (0,)) and got[2][4] == (1,)
    assert got[3] == (1, "cells", 3, "third see the note below", (0, 1))  # shares none itself: what the whole table is linked to


def test_a_table_that_no_chunk_shares_a_word_with_is_linked_to_its_page(spark):
    assert {r[4] for r in kept(spark, PAGE, [(1, 5, 0, "other"), (1, 9, 0, "words")])} == {(5, 9)}


@pytest.mark.parametrize("body", [0, 3])
def test_header_alone_or_sparse_body_takes_the_chunks_of_a_parent(spark, body):
    words = put(1, 0, (50, "name"), (200, "value"))
    for k in range(body):
        words += put(1, 12 * (k + 1), (50, f"item{k}"))
    words += put(1, 80, (50, "alpha beta")) + put(1, 92, (50, "gamma delta")) + put(1, 900, (50, "far away words"))
    of = [(1, 0, 7, "alpha beta"), (1, 1, 7, "gamma delta"), (1, 2, 8, "far away"), (1, 3, 8, "words"), (1, 4, 9, "alpha beta gamma")]
    # Parent 8 lies below the region, parent 9 has one chunk.
    assert kept(spark, words, of) == [(1, "fallback", 1, "alpha beta", (0,)), (1, "fallback", 2, "gamma delta", (1,))]


def test_two_thin_rows_are_no_sparse_body(spark):
    words = put(1, 0, (50, "name"), (200, "value")) + put(1, 12, (50, "one")) + put(1, 24, (50, "two"))
    assert {r[1] for r in kept(spark, words, [(1, 0, 0, "one"), (1, 1, 0, "two")])} == {"cells"}


def test_of_equal_parents_the_first_is_taken(spark):
    words = put(1, 0, (50, "name"), (200, "value")) + put(1, 60, (50, "alpha beta"))
    of = [(1, 2, 3, "alpha"), (1, 3, 3, "beta"), (1, 0, 4, "alpha"), (1, 1, 4, "beta")]
    assert [r[4] for r in kept(spark, words, of)] == [(0,), (1,)]


def test_nulls_blanks_repeats_and_nothing_at_all(spark):
    rows, grid = read(spark, [(1, None, 0.0, 5.0, 0.0, 9.0), (1, " ", 0.0, 5.0, 0.0, 9.0), (None, "a", 0.0, 6.0, 0.0, 9.0), (1, "b", None, 6.0, 0.0, 9.0), (1, "c", 0.0, 6.0, 0.0, 9.0), (1, "c", 0.0, 6.0, 0.0, 9.0)])
    assert [(r["page"], r["text"]) for r in L.page_text(rows, grid).collect()] == [(1, "c c")]
    assert kept(spark, [], []) == [] and kept(spark, PAGE, []) == []


def test_other_columns_with_clashing_names_change_nothing(spark):
    words = spark.createDataFrame(PAGE, WORDS).withColumns({"line": F.lit("x"), "block": F.lit(None), "segments": F.lit(3), "row": F.lit(0)})
    rows = L.lines(words)
    assert L.page_text(rows, L.table_rows(L.cells(rows))).first()["text"].startswith("Doses of the ward\n\ndrug | dose | unit")
