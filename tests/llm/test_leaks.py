import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm.fm_index import FMIndex, suffix_array
from tessella.llm import leaks
from tessella.llm.leaks import LeakLimits, build_index, leaked, phrase_counts, removal_spans
from tessella.llm.words import Folder, fold


@pytest.mark.parametrize("seed", range(5))
def test_index_against_brute_force(seed):
    rng = random.Random(seed)
    docs = [[rng.choice("abcd") for _ in range(rng.randint(0, 120))] for _ in range(rng.randint(0, 8))]
    docs += docs[:2]  # equal documents
    fm = FMIndex.from_bytes(FMIndex.build(docs).to_bytes())
    phrases = [tuple(rng.choice("abcde") for _ in range(3)) for _ in range(40)]
    lo, hi = fm.search(fm.ids(phrases))
    row, at = fm.locate(lo, hi)
    want = [(k, int(fm.first[d]) + i) for k, p in enumerate(phrases) for d, w in enumerate(docs) for i in range(len(w) - 2) if tuple(w[i : i + 3]) == p]
    assert sorted(zip(row.tolist(), at.tolist())) == want
    text = np.array([rng.randint(1, 3) for _ in range(300)] + [0])
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_folding_is_the_same_for_what_scanning_confuses():
    pairs = [("nothing", "notliing"), ("whole", "wliolc"), ("committee", "cornmittcc"), ("schedule", "scliedule"), ("would", "w0u1d"), ("Öffnung", "offnung"), ("filed", "fíled")]
    assert all(fold(a.lower()) == fold(b.lower()) for a, b in pairs)
    assert fold("1984") == "" and fold("297th") == ""
    assert Folder().words("The win-\nters  of\xa0145 “JARS”, don’t.") == [fold(w) for w in ("the", "winters", "of", "jars", "don", "t")]
    assert Folder().words(None) == [] == Folder().words("")
    text = "A win-\nter of 145 jars"
    assert [text[a:b] for a, b in Folder().spans(text)] == ["A", "win-\nter", "of", "jars"]


WORDS = [a + b for a in ("bal", "dor", "fen", "gru", "kel", "mip", "nov", "ras", "sut", "tav") for b in ("ak", "ed", "in", "og", "up", "ysa", "elo", "orn", "ith", "amo")]


def corpus(spark, seed=0):
    rng = random.Random(seed)
    formula = "we now put the question that the words as printed be left out of the second clause"
    items = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(6)]
    items[5] = formula + " " + items[5]
    like = items[0].split()
    for i in range(0, 60, 5):
        like[i] = rng.choice(WORDS)
    items.append(" ".join(like))  # similar wording
    noise = lambda n: " ".join(rng.choice(WORDS[::-1]) for _ in range(n))
    docs, want = [], set()
    for d in range(600):
        text = noise(rng.randint(20, 120))
        if d % 5 == 0:
            text += " " + formula + ". " + noise(10)
        if d % 23 == 0:
            k = rng.randrange(6)
            w = items[k].split()[20:55]
            for i in range(4, 35, 9):
                w[i] = "altered"
            if d % 2:
                w[17:17] = "(laughter) another sentence came in between".split()
            text += " " + (" ".join(w).upper() if d % 3 else " ".join(w)) + " " + noise(15)
            want.add((d, k))
        elif d % 11 == 0:
            text += " " + " ".join(items[1].split()[:9]) + " " + noise(10)  # a short quote
        docs.append((d, text, "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "w " * 300_000, "x"), (3, docs[3][1], "x")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), want


def test_leaks_with_formulas_short_quotes_and_like_items(spark):
    docs, items, want = corpus(spark)
    found = leaked(docs.repartition(4), items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    cut = {r.doc_id: r for r in removal_spans(docs, found).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for d, _ in want:
        assert 20 <= len(text[d][cut[d].start : cut[d].end].split()) <= 45


def test_passages_in_copies_repetitions_or_many_texts_are_no_formulas(spark):
    docs, items, want = corpus(spark, 2)
    rng = random.Random(9)
    text = {r.item_id: r.text for r in items.collect()}
    noise = lambda n: " ".join(rng.choice(WORDS[::-1]) for _ in range(n))
    part = lambda k: " ".join(text[k].split()[15:50])
    speech = f"{noise(40)} {part(2)} {noise(40)}"
    more = [(2000 + i, speech) for i in range(60)]  # copies
    more += [(3000 + i, f"{speech} {noise(5)}") for i in range(200)]  # reissues
    more += [(4000, " ".join(f"{part(3)} {noise(3)}" for _ in range(90)))]  # one text again and again
    more += [(5000 + i, f"{noise(20)} {text[4]} {noise(20)}") for i in range(80)]  # a whole item in many texts
    held = docs.unionByName(spark.createDataFrame([(d, t, "x") for d, t in more], docs.schema))
    want = want | {(d, {2: 2, 3: 2, 4: 3, 5: 4}[d // 1000]) for d, _ in more}
    assert {(r.doc_id, r.item_id) for r in leaked(held.repartition(4), items).collect()} == want


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.words, tuple(r.doc_at)) for r in df.collect())


def test_common_phrases_and_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items, want = corpus(spark, 3)
    plain = rows_of(leaked(docs, items))
    assert {(d, i) for d, i, *_ in plain} == want
    assert rows_of(leaked(docs, items, block_words=300)) == plain  # several blocks, settled across them
    monkeypatch.setattr(leaks, "PAIRS", 0)  # every phrase counts as common
    assert rows_of(leaked(docs, items)) == plain


def test_documents_without_id_and_repeated_ids(spark):
    docs, items, _ = corpus(spark, 4)
    part = [(r.item_id, " ".join(r.text.split()[10:45])) for r in items.orderBy("item_id").limit(3).collect()]
    some = spark.createDataFrame([(None, part[0][1], "x"), (None, part[1][1], "x"), (7, part[0][1], "x"), (7, part[2][1] + " and more", "x"), (7, part[0][1], "x")], docs.schema)
    assert {(r.doc_id, r.item_id) for r in leaked(some, items).collect()} == {(None, 0), (None, 1), (7, 0), (7, 2)}
    twice = items.unionByName(items.filter("item_id = 1").selectExpr("100L as item_id", "text"))
    assert {(r.doc_id, r.item_id) for r in leaked(some, twice).collect()} == {(None, 0), (None, 1), (None, 100), (7, 0), (7, 2)}


def test_counts_are_exact(spark):
    docs, items, _ = corpus(spark, 1)
    texts = [Folder().words(r.text) for r in docs.collect()]
    phrases = [tuple(WORDS_[:2]) for WORDS_ in texts if len(WORDS_) > 2][:20]
    vocabulary = sorted({w for p in phrases for w in p})
    got = {r.phrase: r.n for r in phrase_counts(build_index(docs), vocabulary, np.array([[vocabulary.index(w) for w in p] for p in phrases])).collect()}
    for k, p in enumerate(phrases):
        assert got[k] == sum(tuple(t[i : i + 2]) == p for t in texts for i in range(len(t) - 1))


def test_empty(spark):
    docs, items, _ = corpus(spark)
    assert leaked(docs.limit(0), items).count() == 0
    assert leaked(docs, items.limit(0)).count() == 0
    assert leaked(docs.filter(F.col("text").isNull()), items, LeakLimits(words=5)).count() == 0


def case_by_case(docs, items, limits):
    """(document, item, places) by looking at every document and item, whatever they share."""
    p = leaks.Phrases.of(list(enumerate(items)))
    search, out = leaks.Search(p, [], limits), []
    for d, text in enumerate(Folder().words(x) for x in docs):
        at = {}
        for i in range(len(text) - limits.seed + 1):
            at.setdefault(tuple(text[i : i + limits.seed]), []).append(i)
        rows = []
        for k in range(len(items)):
            hits = sorted((i, -place) for place in range(p.begin[k + 1] - p.begin[k] - limits.seed + 1) for i in at.get(p.words(k, place, place + limits.seed), []))
            words = search.words(k, np.array([-x for _, x in hits], int), np.array([x for x, _ in hits], int))
            if words:
                rows.append((d, k, *map(list, zip(*words))))
        if rows:
            out += [(d, i, tuple(at)) for d, i, _, at in leaks.settle(pd.DataFrame(rows, columns=["doc_id", "item_id", "item_at", "doc_at", "equal"]), limits).itertuples(index=False)]
    return sorted(out)


def by_index(docs, items, limits):
    search, fm = leaks.Search(leaks.Phrases.of(list(enumerate(items))), [], limits), FMIndex.build([Folder().words(x) for x in docs])
    return sorted((d, i, tuple(at)) for d, group in search.found(fm) for i, at in leaks.settle_hits(group, search))


@pytest.mark.parametrize("held", [1, 5_000, 1_000_000])
def test_passages_of_nothing_but_common_phrases_are_found(held, monkeypatch):
    """Six phrases that stand in all of 60 items and 60 documents, and between them altered words."""
    monkeypatch.setattr(leaks, "PAIRS", held)
    rng = random.Random(5)
    parts = [" ".join(WORDS[3 * k : 3 * k + 3]) for k in range(6)]
    own = iter(a + b for a in WORDS[20:] for b in WORDS[20:])
    mixed = lambda order: " ".join(f"{parts[k]} {next(own)}" for k in order)
    orders = [rng.sample(range(6), 6) for _ in range(60)]
    items = [mixed(o) for o in orders]
    docs = [mixed(orders[7]), *[mixed(rng.sample(range(6), 6)) for _ in range(59)]]
    got = by_index(docs, items, LeakLimits())
    assert got == case_by_case(docs, items, LeakLimits())
    assert (0, 7) in {(d, i) for d, i, _ in got}


@pytest.mark.parametrize("seed", range(4))
def test_bounds_leave_out_no_case(seed):
    """Passages of about the least length with words altered, left out and put in."""
    rng = random.Random(seed)
    items = [" ".join(rng.choice(WORDS[:30]) for _ in range(40)) for _ in range(12)]
    docs = []
    for _ in range(150):
        a = rng.randrange(20)
        w = items[rng.randrange(12)].split()[a : a + rng.randint(14, 20)]
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([["altered"], [], [w[i], "added"]])
        docs.append(" ".join(["before", *w, "after"]))
    assert by_index(docs, items, LeakLimits()) == case_by_case(docs, items, LeakLimits())
