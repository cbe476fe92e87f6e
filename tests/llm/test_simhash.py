import random
import re

import numpy as np
import xxhash

from vislens.llm import simhash
from vislens.llm.graph import components


def slow_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or 9 <= ord(c) <= 13:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids_fps, radius=4):
    n = len(ids_fps)
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if group[i] > group[j] and bin(ids_fps[i][1] ^ ids_fps[j][1]).count("1") <= radius:
                    group[i], changed = group[j], True
    low = {}
    for g, (d, _) in zip(group, ids_fps):
        low[g] = min(low.get(g, d), d)
    return [low[g] for g in group]


TEXTS = ["", None, "one", "ONE", "a b c d", "a b c d e f", "É é x y z\tq\nr", "x " * 3000, "same words here again " * 4, "\x1c a\x85b c d e", " \t\n"]


def test_fingerprints_equal_a_slow_version(spark, make_docs):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    got = simhash.fingerprints(make_docs(list(enumerate(texts)), extra=True)).collect()
    want = {i: slow_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in got} == want


def test_groups_equal_brute_force(spark, make_docs):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(150)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in simhash.simhash_groups(make_docs(rows), tile=16).collect()}
    fps = [(d, slow_fingerprint(t or "")) for d, t in rows]
    want = slow_components(fps)
    assert [got[d].component_id for d, _ in rows] == want
    assert len(set(want)) < len(rows)
    assert all(got[d].group_size == want.count(c) for (d, _), c in zip(rows, want))


def test_forest_finds_every_link_at_the_edge_of_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for f in fps for k in (1, 4, 5)]
    every = np.unique(np.concatenate([fps, np.array(near, np.uint64)]))
    links = {(int(a), int(b)) for i, a in enumerate(every) for b in every[i + 1 :] if int(a ^ b).bit_count() <= 4}
    by_pop = {}
    for f in every:
        by_pop.setdefault(int(f).bit_count(), []).append(f)
    joined = {int(f): int(f) for f in every}

    def top(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for p, a in by_pop.items():
        for q, b in by_pop.items():
            if p <= q <= p + 4:
                nodes = a if p == q else [*a, *b]
                for u, v in zip(*simhash.forest(np.array(a, np.uint64), None if p == q else np.array(b, np.uint64), 4, rows=4)):
                    joined[top(int(nodes[u]))] = top(int(nodes[v]))
    slow = {int(f): int(f) for f in every}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(slow[a], slow[b])
            if slow[a] != m or slow[b] != m:
                slow[a] = slow[b] = m
                changed = True
    same = lambda f: {frozenset(x for x in f if f_of(f, x) == f_of(f, y)) for y in f}
    f_of = lambda f, x: top(x) if f is joined else f[x]
    assert same(joined) == same(slow)


def test_nulls_repeats_and_empty_tables(spark, make_docs):
    empty = simhash.simhash_groups(make_docs([]))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fp", "component_id", "group_size"]
    docs = make_docs([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, None), (7, ""), (None, "alone is this text")], extra=True)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.group_size) for r in simhash.simhash_groups(docs).collect())
    assert got == [(-1, -1, 1), (-1, 5, 3), (5, 5, 3), (5, 5, 3), (7, 7, 2), (9, 7, 2)]
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5, 7]  # one row of each group


def test_components_of_chains_hubs_and_cycles(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(1000, 1050)]
    links = chain + hub + [(3, 4), (4, 5), (5, 3), (9, 9), (None, 2), (2, None), (4, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(1000, 1050)} | {7: 7, 3: 3, 4: 3, 5: 3}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_clean_text_stays_when_its_id_also_has_a_near_copy(make_docs):
    copy, clean = "one two three four five six seven eight", "nothing of this is said in any other place here"
    docs = make_docs([(3, copy), (7, copy), (7, clean), (3, copy.upper())], extra=True)
    kept = [(r.doc_id, r.text.lower()) for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(kept) == [(3, copy), (7, clean)]


def slow_wide(text, k=5):
    words = re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).strip(" \t\n\v\f\r"))
    words = [w for w in words if w]
    if not words:
        return 0
    hs = [int.from_bytes(xxhash.xxh3_128_digest(s.encode()), "little") for s in {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def slow_wide_groups(rows):
    """The smallest id that each text reaches."""
    low = (1 << 64) - 1
    prints = [(d, slow_wide(t or "")) for d, t in rows]
    group = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for d, f in prints:
            for e, g in prints:
                if group[e] < group[d] and ((f ^ g) & low).bit_count() <= simhash.FIRST_RADIUS and (f ^ g).bit_count() <= simhash.WIDE_RADIUS:
                    group[d], changed = group[e], True
    return group


def test_wide_groups_equal_brute_force_and_catch_near_copies(make_docs):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(300)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    near = {}
    for i in range(30, 150):
        words = list(base[i % 30])
        for _ in range(rng.choice([1, 3, 5, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
        near[i] = jaccard(rows[-1][1], rows[i % 30][1])
    rows += [(500, ""), (501, None), (502, "one"), (503, "ONE"), (504, "two")]
    group = slow_wide_groups(rows)
    kept = {r.doc_id for r in simhash.drop_near_copies(make_docs(rows, extra=True), tile=16).collect()}
    assert kept == {d for d in group if group[d] == d}
    close = [i for i, j in near.items() if j >= 0.8]
    assert len(close) > 60 and sum(i not in kept for i in close) >= 0.9 * len(close)
    assert set(range(30)) <= kept and {500, 502, 504} <= kept
