import random
import re

from vislens.llm import contamination


def words(text):
    return [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def slow(docs, items, share=0.8):
    own, said = {}, {}
    for i, t in items:
        if i is not None:
            own.setdefault(i, set()).update(shingles(t) or {x for x in [tuple(words(t))] if x})
    for d, t in docs:
        if d is not None:
            for k in range(1, 6):
                said.setdefault(d, set()).update(shingles(t, k))
    return {(d, i, len(s), len(s & u)) for d, u in said.items() for i, s in own.items() if s and len(s & u) >= share * len(s) - 1e-9}


def found(spark, docs, items, **how):
    df = spark.createDataFrame(items, "item_id bigint, text string, doc_id string, h string")
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in contamination.contained_items(docs, df, **how).collect()}


def test_containment_equals_brute_force(spark, make_docs):
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randint(0, n)}" for _ in range(1)][0]
    items = [(i, " ".join(word(3000) for _ in range(rng.choice([3, 5, 6, 9, 14, 30, 45])))) for i in range(60)]
    docs = []
    for d in range(150):
        words = [word(3000) for _ in range(rng.choice([0, 4, 60, 900]))]
        for _ in range(rng.choice([0, 1, 2])):
            quote = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                quote[rng.randrange(len(quote))] = "changed"
            cut = rng.choice([0, 0, len(quote) // 2])
            at = rng.randint(0, len(words))
            words[at:at] = quote[cut:]
            words += quote[: cut + 4] if cut else []  # the item in two parts
        docs.append((d, " ".join(words).title().replace(" W", ", W")))
    want = slow(docs, items)
    got = found(spark, make_docs(docs, extra=True), [(*i, "x", "y") for i in items])
    assert got == want and len(want) > 30
    assert found(spark, make_docs(docs), [(*i, "x", "y") for i in items], block_rows=400) == want
    assert found(spark, make_docs(docs), [(*i, "x", "y") for i in items], block_rows=40) == want  # too many blocks: a shuffle


def test_short_null_repeated_and_empty(spark, make_docs):
    docs = [(1, "a b c d e f g"), (1, "h i j k l"), (2, None), (None, "a b c d e f g"), (3, ""), (4, "a b c d")]
    items = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d"), (3, None), (None, "a b c d e"), (4, "h i j k l")]
    assert found(spark, make_docs(docs), [(*i, "x", "y") for i in items]) == slow(docs, items) == {(1, 1, 2, 2), (1, 2, 1, 1), (4, 2, 1, 1), (1, 4, 1, 1)}
    assert found(spark, make_docs([]), [(*i, "x", "y") for i in items]) == set()
    assert found(spark, make_docs(docs), []) == set()
    df = spark.createDataFrame(items, "item_id bigint, text string")
    kept = contamination.drop_contaminated(make_docs(docs), df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    assert kept.columns == make_docs([]).columns


def test_signature_is_long_enough_for_every_size(spark):
    rows = [(n, k, f"{n}-{k}") for n in (1, 2, 3, 5, 8, 9, 17, 33, 64, 65) for k in range(n)]
    shingled = spark.createDataFrame(rows, "item bigint, h bigint, s string")
    got = contamination.signatures(shingled, 0.8).groupBy("item").count().collect()
    for r in got:
        may_lack = r.item - -(-r.item * 8 // 10)
        assert may_lack < r["count"] <= r.item


def test_plan_runs_no_python(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    plan = contamination.contained_items(make_docs([(1, "a b c d e f g")]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_items_shorter_than_a_shingle_are_found_whole(spark, make_docs):
    docs = [(1, "They asked: who wrote Hamlet, and when?"), (2, "who wrote of hamlet"), (3, "Hamlet"), (4, "who wrote hamlet " * 3), (5, "")]
    items = [(1, "Who wrote Hamlet"), (2, "hamlet"), (3, "?"), (4, "who wrote hamlet and when was it"), (5, "asked who wrote hamlet")]
    assert found(spark, make_docs(docs), [(*i, "x", "y") for i in items]) == slow(docs, items) == {(1, 1, 1, 1), (4, 1, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (3, 2, 1, 1), (4, 2, 1, 1), (1, 5, 1, 1)}


def test_signatures_are_minimum_hashes_of_a_permutation(spark):
    shingled = spark.createDataFrame([(i, k, f"s{k}") for i in range(200) for k in range(20)], "item bigint, h bigint, s string")
    first = {tuple(sorted(r.hs)) for r in contamination.signatures(shingled, 0.8).groupBy("item").agg({"h": "collect_list"}).toDF("item", "hs").collect()}
    assert len(first) == 1  # equal sets have equal signatures
    assert first != {tuple(range(len(next(iter(first)))))}  # not simply the lowest values


def test_boilerplate_is_dealt_over_blocks(spark, make_docs):
    said = "which of the following is"
    items = [(i, f"{said} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(300)]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    shingles = contamination.item_shingles(df, "item_id", "text", 5)
    one = shingles.filter(f"s = '{said}'")
    sizes = [b.count() for b in contamination._blocks(one, 6)]
    assert sum(sizes) == 300 and max(sizes) < 90
    docs = [(1, items[7][1]), (2, said), (3, items[8][1] + " " + items[9][1])]
    want = slow(docs, items)
    assert len(want) == 3 and found(spark, make_docs(docs), [(*i, "x", "y") for i in items], block_rows=500) == want
