import hashlib
import random
import re

import numpy as np

from vislens.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text, rate=50, spm_rate=80, seed=42):
    """One text at a time, over code points."""
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    dice = random.Random(5)
    parts = ["a", "bé", "日本", " ", "  ", "\n", "\t\x0b", "<P", "P>", "<", ">", "M>", "<S>", "\x1c", " ", "🙂", "x<M>y"]
    for _ in range(400):
        yield "".join(dice.choice(parts[: dice.choice([6, 12, 17])]) for _ in range(dice.randrange(12)))


def check(rows, made):
    want = sorted(((d, *slow(d, t)) for d, t in rows), key=str)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=str)
    assert got == want
    assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in made) == sorted((d is None, d or 0, t or "") for d, t in rows)


def test_equals_a_slow_version_and_restores(make_docs):
    rows = [(i, t) for i, t in enumerate(texts())]
    made = fm.restore_middle(fm.fill_middle(make_docs(rows, extra=True))).collect()
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    check(rows, made)


def test_nulls_repeats_ties_long_texts_and_empty_tables(make_docs):
    rows = [(None, "a b c"), (None, None), (3, None), (4, ""), (5, "x " * 500_000), (5, "x " * 500_000), (5, "other"), (6, " \n "), (8, "<" * 9)]
    check(rows, fm.restore_middle(fm.fill_middle(make_docs(rows))).collect())
    assert fm.restore_middle(fm.fill_middle(make_docs([]))).count() == 0


def test_small_buffers_and_blocks_give_the_same(make_docs, monkeypatch):
    whole = [t.encode() for t in texts()]
    data, offsets = np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])
    h = np.random.default_rng(3).integers(0, 1 << 32, (len(whole), 4))
    first = fm.transform(data, offsets, h, 90, 50)
    monkeypatch.setattr(fm, "BLOCK", 7)
    again = fm.transform(data, offsets, h, 90, 50)
    assert first[3].tobytes() == again[3].tobytes() and first[2] == again[2]
    text, out = fm.restore(again[3], again[4], again[1])
    assert text.tobytes() == data.tobytes() and (out == offsets).all()
    for t, (low, high) in zip(whole, zip(again[4], again[4][1:])):
        assert sorted(again[3][low:high].tobytes().replace(b"<P>", b"").replace(b"<S>", b"").replace(b"<M>", b"")) == sorted(t.replace(b"<P>", b"").replace(b"<S>", b"").replace(b"<M>", b""))


def test_rates_and_seed_are_parameters(make_docs):
    rows = [(i, "one two three") for i in range(200)]
    forms = lambda **how: {r.form for r in fm.fill_middle(make_docs(rows), **how).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm_rate=0) == {"psm"} and forms(rate=100, spm_rate=100) == {"spm"}
    outputs = lambda **how: [r.output for r in fm.fill_middle(make_docs(rows), **how).orderBy("doc_id").collect()]
    assert outputs() != outputs(seed=7)
