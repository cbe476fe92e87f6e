import random

from vislens.llm import license_scan as ls


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        pairs = sorted({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 14))}, key=lambda p: (p[0], -p[1]))
        best = 0
        for mask in range(1 << min(len(pairs), 12)):
            s = [p for k, p in enumerate(pairs[:12]) if mask >> k & 1]
            if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(s, s[1:])):
                best = max(best, len(s))
        got = ls.increasing(pairs[:12])
        assert len(got) == best and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_patience_aligns_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 14))]
        b = a[:] if rng.random() < 0.6 else [rng.choice("abcdefghijklmnop") for _ in range(12)]
        for _ in range(rng.randint(0, 3)):
            if b:
                b[rng.randrange(len(b))] = rng.choice("xyz")
        pairs = ls.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        if a == b or len(set(a)) == len(a) == len(b):
            assert len(pairs) == lcs(a, b)
    # without unique words the longest common subsequence
    assert len(ls.patience(list("xaabbxx"), list("yabababy"))) == lcs("xaabbxx", "yabababy")


def test_notices_are_found_wherever_and_however_often(make_docs):
    rng = random.Random(3)
    filler = "the of and in to for be is under work this with public version use".split()
    rows, want = [], {}
    for d in range(60):
        words = [rng.choice(filler) for _ in range(rng.choice([0, 10, 400]))]
        for name in rng.sample(list(ls.TEMPLATES), rng.choice([0, 1, 2])):
            words += ls.TEMPLATES[name].split() + [rng.choice(filler) for _ in range(rng.choice([0, 10, 400]))]
            want.setdefault(d, set()).add(name)
        rows.append((d, " ".join(words)))
    got = {}
    texts = dict(rows)
    for r in ls.scan_licenses(make_docs(rows, extra=True)).collect():
        assert r.coverage == r.n_aligned / r.n_words >= 0.8
        assert 0 <= r.start < r.end <= len(texts[r.doc_id])
        got.setdefault(r.doc_id, set()).add(r.license)
    assert [(d, n) for d, names in want.items() for n in names - got.get(d, set())] == []
    # a notice may also lie in the header that quotes it
    implied = {"Apache-2.0-notice", "GPL-3.0-notice", "BSD-2-Clause", "BSD-3-Clause"}
    assert all(got[d] - want.get(d, set()) <= implied for d in got)


def test_repeated_damaged_and_odd_texts(make_docs):
    mit = ls.TEMPLATES["MIT-notice"]
    rows = [(1, f"{mit} {mit}\n{mit}"), (2, "Released under a MIT License"), (3, "MIT License under Released the"), (4, None), (5, ""), (6, mit.upper() + "é" * 5), (None, mit), (8, ("word " * 40 + mit + " ") * 300)]
    got = {}
    for r in ls.scan_licenses(make_docs(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_aligned))
    n = len(mit) - 1
    assert sorted(got[1]) == [(0, n, 5), (n + 2, 2 * n + 2, 5), (2 * n + 4, 3 * n + 4, 5)]
    assert got[2] == [(0, 28, 4)] and 3 not in got and 4 not in got and 5 not in got
    assert len(got[8]) == 300 and len(got[None]) == 1
    assert 6 not in got or got[6][0][2] >= 4
    assert ls.scan_licenses(make_docs([])).count() == 0
    assert ls.scan_licenses(make_docs(rows), templates={}).count() == 0
    assert ls.scan_licenses(make_docs(rows), templates={"none": "..."}).count() == 0


def free(words, taken, p, reach):
    """The window around word p between the matches that are taken."""
    low, high = max(0, p - reach), min(len(words), p + reach + 1)
    for a, b in taken:
        low, high = (max(low, b + 1), high) if b < p else (low, min(high, a)) if a > p else (p, p)
    return low, high


def test_a_scan_equals_windows_around_every_seed_in_both_directions():
    rng = random.Random(9)
    template = "a b c d a e f".split()
    scanner = ls.Scanner({"t": " ".join(template)}, 0.7)
    need, reach, hits = 5, len(template) + len(template) // 2 + 2, 0
    for _ in range(300):
        words = [rng.choice("abcdefxyz") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in template if rng.random() < 0.85]
        text = " ".join(words)  # one letter a word: word k is at 2 * k
        taken = [(start // 2, (end - 1) // 2) for _, _, n, start, end in scanner.scan(text)]
        hits += len(taken)
        assert all(a[1] < b[0] for a, b in zip(taken, taken[1:]))
        for first, last in taken:  # what is reported is there
            assert len(set(words[first : last + 1]) & set(template)) >= 4 and last - first + 1 >= need
        # what is there is reported: no window outside the matches still holds one; a match can't lack the rarest words, so they alone are seeds
        lacking, seeds = 0, []
        for w in sorted(set(template), key=lambda w: (words.count(w), w)):
            if lacking > len(template) - need:
                break
            lacking += template.count(w)
            seeds += [p for p, x in enumerate(words) if x == w]
        for p in seeds:
            low, high = free(words, taken, p, reach)
            assert high - low < need or len(ls.patience(template, words[low:high])) < need
    assert hits > 100


def test_copies_in_a_row_are_all_found(make_docs):
    for name in ("MIT-notice", "ISC", "CC-BY-NC-4.0-notice", "BSD-3-Clause"):
        text, rows = ls.TEMPLATES[name], []
        for n in (1, 2, 3, 7):
            rows += [(len(rows), " ".join([text] * n)), (len(rows) + 1, "Words before. " + " ".join([text] * n) + " Words behind.")]
        got = [r for r in ls.scan_licenses(make_docs(rows)).collect() if r.license == name]
        assert sorted((r.doc_id) for r in got) == sorted(d for d, t in rows for _ in range(t.count(text)))
        assert all(r.coverage == 1 for r in got)
