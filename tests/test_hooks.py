import unicodedata

import pytest
from pyspark.sql import functions as F

from vislens.functions import text as tx
from vislens.operators import quality as qa
from vislens.operators.hooks import Decision, checked, verified, with_hook
from vislens.sources.tables import read_corpus_files


def requests(spark):
    return spark.createDataFrame([(i, f"text {i}", i % 2 == 0) for i in range(9)], "item_key long, body string, poison boolean")


def test_verifier_sees_the_payload_alone_and_may_be_async(spark):
    seen = {r["item_key"]: r for r in verified(requests(spark), lambda x: {"passes": x.endswith(("1", "3")), "service_time_s": 0.5, "why": x}, "body").collect()}
    assert len(seen) == 9 and {k for k, r in seen.items() if r["passes"]} == {1, 3}
    assert seen[4]["service_time_s"] == 0.5 and seen[4]["metadata"] == {"why": "text 4"}

    async def slow(x):
        return Decision(x == "text 2", metadata={"n": 1})

    got = {r["item_key"]: r for r in verified(requests(spark), slow, "body").collect()}
    assert [k for k, r in got.items() if r["passes"]] == [2] and all(r["service_time_s"] >= 0 for r in got.values())
    assert verified(requests(spark).filter("item_key < 0"), slow, "body").count() == 0
    with pytest.raises(Exception, match="passes must be a bool"):
        verified(requests(spark), lambda x: {"passes": 1}, "body").collect()


@pytest.mark.parametrize("raw", ["yes", None, 1, {"ok": True}, {"passes": True, "metadata": 3}, {"passes": True, "service_time_s": -1}, Decision(True, float("nan")), Decision(True, True)])
def test_wrong_answers_are_refused(raw):
    with pytest.raises((TypeError, ValueError)):
        checked(raw, 0.1)


def test_hooks_add_and_never_replace(spark):
    df = requests(spark)
    out = with_hook(df, lambda d: d.withColumn("poison", F.lit(True)).withColumn("n", F.length("body")).filter("item_key < 5"), "item_key")
    assert out.columns == ["item_key", "body", "poison", "n"]
    assert {(r["item_key"], r["poison"], r["n"]) for r in out.collect()} == {(i, i % 2 == 0, 6 if i < 5 else None) for i in range(9)}
    assert with_hook(df, lambda d: d, "item_key").columns == df.columns
    for bad in (lambda d: d.select("body"), lambda d: d.withColumn("poison", F.lit("x"))):
        with pytest.raises(ValueError):
            with_hook(df, bad, "item_key")


def test_report_is_recomputed_and_planted_differences_are_found(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 5.0)], "k string, m double, n double")
    b = spark.createDataFrame([("x", 1.0 + 1e-9, None), ("y", 2.1, 5.0), ("z", None, 1.0)], "k string, m double, n double")
    got = {(r["section"], r["key"], r["field"]): r["same"] for r in qa.recompute_report({"s": a}, {"s": b}, {"s": ["k"]}).collect()}
    assert got == {("s", "x", "m"): True, ("s", "x", "n"): True, ("s", "y", "m"): False, ("s", "y", "n"): True, ("s", "z", "m"): False, ("s", "z", "n"): False}
    with pytest.raises(ValueError):
        qa.recompute_report({"s": a}, {"t": b}, {"s": ["k"]})


def test_raw_posts_are_latin1(spark, tmp_path):
    raw = bytes(range(32, 256))
    (tmp_path / "topic").mkdir()
    (tmp_path / "topic" / "post1").write_bytes(raw)
    row = read_corpus_files(spark, str(tmp_path)).first()
    assert (row["topic"], row["filename"], bytes(row["raw"]), row["text"]) == ("topic", "post1", raw, raw.decode("latin1"))


def test_case_folding_equals_python(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne ﬂow", "Cafe\u0301 CAFÉ", "İstanbul", "ŉa", "ſharp", "µm Μm", "ÀÉ ÿ", "plain", "", None, "ẞ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", tx.casefold("t").alias("c")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t).casefold() for i, t in enumerate(texts)}
