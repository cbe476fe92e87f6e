import hashlib
import random

import pytest

from vislens.llm import content_dedup as cd


def slow(rows):
    """Groups by the lowered text in a dictionary; the first of the rows with the largest id stays."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        first = True
        for d in sorted(ids, key=lambda d: (d is None, -(d or 0))):
            out.append((d, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def fast(df, **how):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in cd.exact_groups(df, **how).collect()), key=str)


def rows(n=300):
    dice = random.Random(2)
    words = ["Aa", "aA", "b", "É", "é", "ß", ""]
    out = [(i, " ".join(dice.choice(words) for _ in range(dice.randrange(4)))) for i in range(n)]
    return out + [(n + i, None if i % 2 else "") for i in range(5)] + [(1000 + i, "Hot text") for i in range(200)]


@pytest.mark.parametrize("range_rows", [9, 60, 1 << 18])
def test_groups_equal_brute_force_whatever_the_ranges(make_docs, range_rows):
    data = rows()
    assert fast(make_docs(data, extra=True), range_rows=range_rows) == slow(data)


def test_a_run_over_many_ranges_is_one_group(make_docs):
    data = [(i, "same") for i in range(100)]
    got = fast(make_docs(data), range_rows=9)
    assert got == slow(data) and sum(r[3] for r in got) == 1


def test_long_texts_that_differ_at_the_end_only(make_docs):
    long = "x" * 300_000
    data = [(1, long + "a"), (2, long + "b"), (3, long.upper() + "A"), (4, long), (5, long + "a")]
    assert fast(make_docs(data), range_rows=2) == slow(data)
    assert fast(make_docs(data), range_bytes=1000) == slow(data)


def test_nulls_repeated_rows_and_empty_tables(make_docs):
    data = [(None, "a"), (None, "A"), (3, "a"), (3, "a"), (None, "only"), (None, "ONLY"), (4, None), (5, "")]
    for n in (1, 100):
        assert fast(make_docs(data), range_rows=n) == slow(data)
    assert fast(make_docs([])) == []


def test_ids_of_other_types(spark, make_docs):
    docs = make_docs([(1, "t"), (12, "t"), (2, "T")]).withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id").cast("string"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in cd.exact_groups(docs).collect()} == {("1", "2", False), ("12", "2", False), ("2", "2", True)}
