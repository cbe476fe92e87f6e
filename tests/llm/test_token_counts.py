import random

import numpy as np
import pytest

from vislens.llm import token_counts as tc

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Hello world.\nThis is a line.\n\n\nThe next one  with spaces \n",
    "naïve café\n日本語のテキスト\n🙂🙂 emoji\n",
    "\n\n\n",
    "x",
    "tabs\t\tand\r\nreturns\r\n\r\n",
    "a" * 500 + "\n" + "b" * 500,
    " \n \n \n",
]


def spans_of_other_library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).offsets


def test_offsets_equal_those_of_another_library():
    encoding, lengths = tc.load_encoding(P.path("byte_bpe_50k.tiktoken"))
    for text in TEXTS:
        a, b = tc.token_spans(text, encoding, lengths)
        ours, other = list(zip(a.tolist(), b.tolist())), spans_of_other_library(text)
        assert ours == [tuple(x) for x in other], text


def slow(spans, borders, rule):
    n = len(borders) - 1
    out, crossing = [0.0] * n, [0] * n
    for a, b in spans:
        own = [max(0, min(b, borders[k + 1]) - max(a, borders[k])) for k in range(n)]
        touched = [k for k in range(n) if own[k]]
        if len(touched) > 1:
            for k in touched:
                crossing[k] += 1
        if rule == "share":
            for k in touched:
                out[k] += own[k] / (b - a)
        elif rule == "start":
            out[touched[0]] += 1
        else:
            out[own.index(max(own))] += 1
    return out, crossing


@pytest.mark.parametrize("rule", tc.RULES)
def test_allocation_equals_brute_force(rule):
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randint(1, 30)
        cuts = sorted(rng.randint(0, size) for _ in range(rng.randint(0, 6)))
        borders = [0, *cuts, size]
        ends = sorted({rng.randint(1, size) for _ in range(8)} | {size})
        starts = [0, *ends[:-1]]
        starts = [max(0, s - (rng.random() < 0.1)) for s in starts]  # pieces of one character share it
        got = tc.allocate(np.array(starts), np.array(ends), np.array(borders), rule)
        want = slow(list(zip(starts, ends)), borders, rule)
        assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1]
        assert np.isclose(got[0].sum(), len(starts))


def test_lines_of_documents(make_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = [*enumerate(TEXTS), (20, None), (21, ""), (None, "no id\n"), (3, "x"), (22, "word and line\n" * 20_000)]
    got = {}
    for r in tc.section_tokens(make_docs(rows, extra=True), path).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    for d, text in enumerate(TEXTS):
        own = sorted(set(got[d]))
        borders = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        borders += [len(text)] if borders[-1] < len(text) else []
        want, crossing = slow(spans_of_other_library(text), borders, "majority")
        assert own == [(k, borders[k], borders[k + 1], want[k], crossing[k]) for k in range(len(want))]
    assert len(got[3]) == 2 and len(got[22]) == 20_000 and len(got[None]) == 1 and 20 not in got and 21 not in got
    assert tc.section_tokens(make_docs([]), path).count() == 0


def test_fields_share_and_wrong_rules(make_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = make_docs([(1, "some text\n\n", "source name"), (2, None, ""), (3, "", "only source")])
    for rule in tc.RULES:
        rows = tc.section_tokens(docs, path, fields=["source", "text", "lang"], rule=rule).collect()
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        assert sorted(by) == [1, 2, 3]
        assert sum(r.n_tokens for r in by[1]) == pytest.approx(len(spans_of_other_library("source name\nsome text\n\n\nen")))
    with pytest.raises(ValueError):
        tc.section_tokens(docs, path, rule="none")
