import itertools
import math
import random

import numpy as np
import pytest

from vislens.llm import crf, toxicity


def slow_marginals(e, moves):
    """Sums over all tag sequences."""
    total, marked, moved = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=len(e)):
        before, s = 0, 0.0
        for t, x in zip(tags, e):
            s += moves[before, t] + (x if t else 0)
            before = t
        w = math.exp(s)
        total += w
        marked += w * np.array(tags)
        for a, b in zip((0, *tags), tags):
            moved[a, b] += w
    return marked / total, moved / total


def test_marginals_equal_sums_over_all_sequences(monkeypatch):
    rng = np.random.default_rng(0)
    for row in (1, 2, 3, 128):
        monkeypatch.setattr(crf, "ROW", row)
        lengths = np.array([0, 3, 1, 9, 0, 7, 10])
        moves = rng.normal(size=(2, 2))
        e = rng.normal(size=lengths.sum()) * 3
        got, moved = crf.forward_backward(e, lengths, moves, True)
        want, want_moved, at = [], np.zeros((2, 2)), 0
        for n in lengths:
            m, x = slow_marginals(e[at : at + n], moves) if n else (np.zeros(0), np.zeros((2, 2)))
            want.append(m)
            want_moved += x
            at += n
        assert np.allclose(got, np.concatenate(want), atol=1e-9)
        assert np.allclose(moved, want_moved, atol=1e-8)
    assert crf.forward_backward(np.zeros(0), np.array([0, 0]), moves).shape == (0,)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["idiot", "scum"] + ["vejak" + "".join(rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        y = i % 4 == 0
        for _ in range(rng.randint(2, 4) if y else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(y)))
    return docs, labels, set(bad)


@pytest.fixture(scope="module")
def fitted(spark, make_docs):
    docs, labels, bad = corpus()
    y = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id bigint, toxic int")
    return docs, dict(labels), bad, toxicity.fit_toxicity(make_docs(docs), y)


def test_held_out_documents_are_told_apart_and_spans_lie_on_the_words(make_docs, fitted):
    docs, labels, bad, model = fitted
    texts = dict(docs)
    rows = toxicity.score_toxicity(make_docs(docs, extra=True), model).collect()
    held = [r for r in rows if r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == (labels[r.doc_id] == 1) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    words = [texts[r.doc_id][s.start : s.end] for r in held for s in r.spans]
    flat = [w.strip(".,") for x in words for w in x.split()]
    assert sum(w in bad for w in flat) >= 0.95 * len(flat) > 0
    assert all(sum(len(texts[r.doc_id][s.start : s.end].split()) for s in r.spans) == r.n_toxic_tokens for r in rows)


def test_empty_null_long_and_repeated_texts(make_docs, fitted):
    docs, _, _, model = fitted
    long = "plain words of no harm " * 60_000
    rows = [(1, ""), (2, None), (3, "  \n"), (4, long), (5, long + "idiot scum idiot vejakaei"), (None, "x"), (7, docs[0][1]), (7, docs[0][1])]
    got = toxicity.score_toxicity(make_docs(rows), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].score == by[2].score == by[3].score < 0.5
    assert by[4].n_toxic_tokens == 0 and by[5].n_toxic_tokens >= 3
    kept = toxicity.drop_toxic(make_docs(rows), model)
    scores = {r.doc_id: r.score for r in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if scores[d] < 0.5)
    assert toxicity.score_toxicity(make_docs([]), model).count() == 0


def test_without_labels_nothing_is_toxic(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(make_docs([(1, "a b c")]), none)
    assert toxicity.drop_toxic(make_docs([(1, "a b c"), (2, None)]), model).count() == 2
    clean = spark.createDataFrame([(1, 0), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(make_docs([(1, "a b c"), (2, "d")]), clean)
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(make_docs([(1, "a b c"), (2, "d")]), model).collect())


def test_copies_of_one_toxic_text_do_not_mark_its_words():
    copies = [chr(97 + i % 26) * (1 + i // 26) + "mnopq" for i in range(30)] + ["idiot"]
    texts = [copies] * 40 + [["idiot", f"a{i}", f"b{i}", "idiot"] for i in range(20)] + [[f"c{i}", "word"] for i in range(200)]
    assert toxicity.toxic_cues(texts, [1] * 60 + [0] * 200) == {"idiot"}


def test_rows_that_repeat_an_id_are_one_training_text(spark, make_docs, monkeypatch):
    docs = [(1, f"text {i} of one id") for i in range(40)] + [(i, f"own text {i}") for i in range(2, 8)]
    y = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id bigint, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda words, tags: seen.append(words) or fit(words, tags))
    toxicity.fit_toxicity(make_docs(docs), y, max_docs=4)
    toxicity.fit_toxicity(make_docs(docs[::-1]), y, max_docs=4)
    assert len(seen[0]) == 7 and seen[0] == seen[1]
    assert sum(w[-1] == "id" for w in seen[0]) == 1
