import math
import random
import re

import numpy as np
import pytest

from vislens.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, k):
    """All pairs, in whole numbers."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, t in held:
            m = 75 + (25 * len(t) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 12 * m)) for w in terms(text) if w in df and w in t
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -score) for rank, (score, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def fast(docs, items, **how):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ls.search(docs, items, **how).collect()), key=str)


def corpus(n=400, seed=1, mixed=True):
    dice = random.Random(seed)
    topics = [[f"w{t}x{i}" for i in range(40)] for t in range(6 if mixed else 4)]
    docs = []
    for d in range(n):
        own = dice.choice(topics)
        docs.append((d, " ".join(dice.choice(own if not mixed or dice.random() < 0.9 else dice.choice(topics)) for _ in range(dice.randrange(1, 40))).replace("x1", "X1")))
    items = [(i, " ".join(dice.choice(dice.choice(topics) if mixed else topics[i % 4]) for _ in range(dice.randrange(1, 9) if mixed else 25))) for i in range(40)]
    return docs, items


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 5, 20])
def test_ranks_equal_all_pairs(make_docs, make_items, k):
    docs, items = corpus()
    assert fast(make_docs(docs, extra=True), make_items(items), k=k) == slow(docs, items, k)


def test_several_passes_small_blocks_and_leaves(make_docs, make_items, monkeypatch):
    docs, items = corpus(200)
    want = slow(docs, items, 4)
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(ls, "BLOCK_TERMS", 10)
    assert fast(make_docs(docs), make_items(items), k=4, pass_bytes=300) == want


def test_ties_copies_nulls_and_repeated_rows(make_docs, make_items):
    docs = [(i, "red Apple, red") for i in range(60)] + [(99, "red apple red"), (99, "red apple red"), (None, "red apple red"), (None, "pear"), (7, ""), (8, None), (9, "!?"), (200, "blue\x00red")]
    items = [(1, "apple APPLE red"), (1, "apple APPLE red"), (2, None), (3, ""), (None, "pear"), (4, "nowhere"), (5, "rêd réd")]
    docs += [(300, "rêd-réd RÊD")]
    for k in (3, 25, 100):
        assert fast(make_docs(docs), make_items(items), k=k) == slow(docs, items, k)


def test_long_texts_and_empty_tables(make_docs, make_items):
    docs = [(1, "alpha " * 200_000 + "omega"), (2, "omega"), (3, "alpha beta")]
    items = [(1, "omega alpha"), (2, "beta " * 200)]
    assert fast(make_docs(docs), make_items(items), k=2) == slow(docs, items, 2)
    assert fast(make_docs([]), make_items(items)) == [] and fast(make_docs(docs), make_items([])) == [] and fast(make_docs([(1, "?")]), make_items(items)) == []


def walk(docs, items, k, **sizes):
    """The search of one task, without Spark."""
    one = ls.Pass([t.encode() for _, t in items])
    held = [ls.terms_of(t.encode()) for _, t in docs]
    df = [sum(t in set(h) for h in held) for t in one.vocabulary]
    weights = np.array([ls.weight(len(docs), n) for n in df])
    row, term, tf = [], [], []
    for r, h in enumerate(held):
        for t in dict.fromkeys(h):
            if t in one.vocabulary:
                row.append(r), term.append(one.vocabulary[t]), tf.append(h.count(t))
    n = sum(map(len, held))
    m = np.array([75 + 25 * len(h) * len(docs) // n for h in held])
    search = ls.Search(one.blocks(weights), len(items), k)
    row = np.array(row)
    search.feed(np.array([d for d, _ in docs]), row, np.array(term), ls.damped(np.array(tf), m[row]))
    return search


def test_node_bounds_leave_out_batches_of_pairs():
    docs, items = corpus(6000, mixed=False)
    search = walk(docs, items, 5)
    assert search.pairs < 0.7 * search.offered
    want = slow(docs, items, 5)
    got = sorted(((item, rank, int(d), int(s)) for item, (scores, ids) in search.best.items() for rank, (d, s) in enumerate(zip(ids, scores), 1)), key=str)
    assert got == want


def test_sums_beyond_doubles_are_whole_numbers():
    counts = [{0: 1 << 40, 1: 3}, {1: 1}]
    block = ls.Block(np.arange(2), counts, np.array([7000, 11]))
    assert not block.exact
    search = ls.Search([block], 2, 1)
    search.feed(np.array([5, 6]), np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([9, 5, 9]))
    assert search.best[0][0][0] == (1 << 40) * 7000 * 9 + 3 * 11 * 5 and search.best[0][1][0] == 5
