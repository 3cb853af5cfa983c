import random

import numpy as np
import pyarrow as pa
import pytest

from rosterlens.llm import leakage, spans

rng = random.Random(4)
VOCAB = [f"w{i}" for i in range(400)] + ["a", "é", "Ünder", "x-y", "b."]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute_leaks(docs, items, n):
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(i, d) for d, t in docs for w in [leakage.words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_leaks_against_brute_force(spark):
    items = [(i, prose(30)) for i in range(30)] + [(30, None), (31, ""), (32, "too short"), (33, prose(12)), (34, "a a a a a a a a a a a a a a a")]
    docs = [(d, prose(80)) for d in range(100)]
    for d in range(0, 60):
        w, own = docs[d][1].split(), items[d % 30][1].split()
        n = 9 + d % 7
        docs[d] = (d, " ".join(w[:20] + [x.upper() + "," for x in own[5 : 5 + n]] + w[20:]))
    docs += [(200, None), (201, ""), (202, items[33][1]), (203, "a " * 40), (204, prose(60_000) + " " + items[3][1]), (0, docs[0][1])]
    a = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    rows = leakage.leaked(a.drop("item_id"), "doc_id", "text", b, "item_id", "text").collect()
    assert {(r.item_id, r.doc_id) for r in rows} == brute_leaks(docs, items, 12)
    assert all(r.run >= 12 and r.aligned >= 12 for r in rows)


def test_leaks_with_a_replaced_word_and_empty_tables(spark):
    item = prose(24)
    w = item.split()
    a = spark.createDataFrame([(1, " ".join([*w[:12], "other", *w[13:]])), (2, " ".join([*w[:6], "other", *w[7:12], "more", *w[13:18], "third", *w[19:]]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.aligned for r in leakage.leaked(a, "doc_id", "text", b, "item_id", "text", 20, 1).collect()}
    assert got == {1: 23}
    assert leakage.leaked(a.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leakage.leaked(a, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0


def brute_near(item, doc, edits):
    """(longest run of equal words, most equal words of a stretch with so many words replaced, inserted or dropped), over all cells."""
    a, b = leakage.words(item), leakage.words(doc)
    cell = {}
    run = best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            for e in range(edits + 1):
                n = cell.get((i - 1, j - 1, e), 0) + 1 if a[i] == b[j] else 0
                if e:
                    n = max(n, *(cell.get(k, 0) for k in ((i - 1, j - 1, e - 1), (i - 1, j, e - 1), (i, j - 1, e - 1))))
                cell[i, j, e] = n
            run, best = max(run, cell[i, j, 0]), max(best, cell[i, j, edits])
    return run, best


@pytest.mark.parametrize(("change", "aligned"), [("replaced", 23), ("inserted", 24), ("dropped", 23)])
def test_a_word_replaced_inserted_or_dropped(spark, change, aligned):
    w = [f"word{i}" for i in range(24)]
    doc = {"replaced": [*w[:11], "instead", *w[12:]], "inserted": [*w[:11], "additional", *w[11:]], "dropped": [*w[:11], *w[12:]]}[change]
    a = spark.createDataFrame([(1, "before " + " ".join(doc) + " after")], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = [(r.run, r.aligned) for r in leakage.leaked(a, "doc_id", "text", b, "item_id", "text", 20, 1).distinct().collect()]
    assert got == [(12 if change != "inserted" else 13, aligned)]


def test_many_items_are_taken_in_parts(spark):
    items = [(i, prose(20)) for i in range(30)]
    a = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaked(a, "doc_id", "text", b, "item_id", "text", most=500).collect()}
    assert got >= {(i, i) for i in range(30)} and got == brute_leaks([(i, f"x {t} y") for i, t in items], items, 12)


def test_near_passage_after_a_chance_match(spark):
    item = [f"word{i}" for i in range(21)]
    doc = [*item[:1], "xxxxx", *item[2:10], "yyyyyy", *item[11:]]
    a = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = [(r.run, r.aligned) for r in leakage.leaked(a, "doc_id", "text", b, "item_id", "text", 12, 1).collect()]
    assert got == [(10, 18)]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_near_against_brute_force(spark, edits):
    own = random.Random(11)
    # short words, so that no edit moves what follows further than allowed
    vocab = [f"w{i:04}" for i in range(300)]
    items = [(i, " ".join(own.choices(vocab, k=30))) for i in range(20)]
    docs = []
    for d in range(300):
        w = items[d % 20][1].split()
        for k in own.sample(range(30), 1 + d % 6):
            kind = own.randrange(3)
            w[k : k + 1] = [own.choice(vocab)] if kind == 0 else [w[k], own.choice(vocab)] if kind == 1 and k < len(w) else []
        docs.append((d, " ".join(own.choices(vocab, k=10) + w + own.choices(vocab, k=10))))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.doc_id): (r.run, r.aligned) for r in leakage.leaked(a, "doc_id", "text", b, "item_id", "text", 12, edits).collect()}
    want = {(i, d): v for i, x in items for d, y in docs if (v := brute_near(x, y, edits))[1] >= 12}
    assert got == want and len(want) > 80


def brute_spans(docs, n):
    words = {}
    for k, t in docs:
        if t is not None:
            words[k] = t.split()
    held = {}
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            held.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = set()
    for k, w in words.items():
        on = [False] * len(w)
        for i in range(len(w) - n + 1):
            if len(held[tuple(w[i : i + n])]) > 1:
                on[i : i + n] = [True] * n
        i = 0
        while i < len(on):
            if on[i]:
                j = i
                while j + 1 < len(on) and on[j + 1]:
                    j += 1
                out.add((k, i, j))
                i = j
            i += 1
    return out


@pytest.mark.parametrize(("cells", "most"), [(1 << 20, 1 << 28), (64 * 8, 1 << 28), (None, 1 << 28), (None, 1)])
def test_spans_against_brute_force(spark, cells, most):
    docs = [(d, prose(120)) for d in range(80)]
    notice = prose(33)
    for d in range(0, 70):
        w = docs[d][1].split()
        if d % 3 == 0:  # a passage that a third of all records hold
            w[40:40] = notice.split()
        if d % 5 == 1:
            w[10:10] = docs[d - 1][1].split()[5 : 5 + 28 + d % 6]
        docs[d] = (d, ("  " if d % 2 else "\n") + " ".join(w[:60]) + "  " + "\t".join(w[60:]) + " ")
    twice = prose(31)
    docs += [(200, None), (201, ""), (202, "short"), (203, twice + " mid " + twice), (204, docs[1][1]), (204, docs[1][1]), (205, "same " * 50), (206, " same" * 35)]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "id long, text string, hash int, at string")
    got = {(r.id, r.first_word, r.last_word) for r in spans.shared_spans(df, "id", "text", 30, most, cells).collect()}
    assert got == brute_spans(docs, 30) and got


def test_few_single_windows_pass_however_large_the_corpus(spark):
    """Sixteen times more minimizers than cells may go to the executors: the sketch is sharded, and hardly a window passes that stands once."""
    own = random.Random(3)
    docs = [(d, " ".join(f"w{own.randrange(10**6)}" for _ in range(200))) for d in range(400)]
    docs += [(d + 400, docs[d][1]) for d in range(10)]
    df = spark.createDataFrame(docs, "id long, text string")
    minimizers = sum(len(np.unique(spans.windows(pa.array([t]), 30)[1])) for _, t in docs)
    for kw in ({"most": minimizers // 16}, {}):
        got = spans.candidates(df, "id", "text", 30, **kw).groupBy("hash").count().collect()
        once = sum(r["count"] == 1 for r in got)
        assert len(got) - once == 10 * 171 and once < 0.1 * 390 * 171
    assert spans.cells_for(10**9, 30) >= 8 * 10**9 // 69 and spans.cells_for(10**12, 30) > spans.MOST_CELLS


def test_portion_and_empty_table(spark):
    p = prose(40)
    df = spark.createDataFrame([(1, p + " " + prose(40)), (2, p), (3, None), (4, "")], "id long, text string")
    s = spans.shared_spans(df, "id", "text", 30)
    got = {r.id: (r.words, r.shared_words, r.share) for r in spans.shared_portion(df, "id", "text", s).collect()}
    assert got == {1: (80, 40, 0.5), 2: (40, 40, 1.0), 3: (0, 0, None), 4: (0, 0, None)}
    assert spans.shared_spans(df.limit(0), "id", "text", 30).count() == 0


def test_portion_counts_words_between_any_white_space(spark):
    p = prose(40)
    texts = ["\n\t " + "  ".join(p.split()) + "\r\n", p.replace(" ", "\n", 9).replace(" ", "\t", 9).replace(" ", "\u00a0", 5).replace(" ", "\u3000", 5) + " \u2003\n own words", " \n\t\u00a0", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    s = spans.shared_spans(df, "id", "text", 30)
    got = {r.id: (r.words, r.shared_words, r.share) for r in spans.shared_portion(df, "id", "text", s).collect()}
    assert got == {0: (40, 40, 1.0), 1: (42, 40, 40 / 42), 2: (0, 0, None), 3: (1, 0, 0.0)}


def test_packing():
    for x in ([], [0], [3, 4, 900, 70_000, 5_000_000_000]):
        assert spans._unpack(spans._pack(np.array(x, np.int64))).tolist() == x
