"""Registered queries: create-only writing, decoding, and user code at its fixed places."""

from __future__ import annotations

from pyspark.sql import functions as F

from vislens.functions import text as tx
from vislens.operators import detector as det
from vislens.operators import hooks
from vislens.plans.registry import query
from vislens.session import shared_dir
from vislens.sources import tables as src


@query("written_once", "SELECT id, topic, true AS refused FROM w_items")
def written_once(spark, d):
    """All items written to a new table and read back; writing there again is refused."""
    path = f"{shared_dir(spark)}/items"
    items = src.items(spark, d).select("id", "topic")
    src.write_new(items, path, partition_by=["topic"])
    try:
        src.write_new(items, path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).select("id", F.col("topic").cast(items.schema["topic"].dataType).alias("topic"), F.lit(refused).alias("refused"))


@query("decoded_latin1", "SELECT doc_id, octet_length(encode(text)) AS n_chars, length(text) = octet_length(encode(text)) AS ascii FROM documents")
def decoded_latin1(spark, d):
    """The bytes of every text read as Latin-1: one character a byte, the same text only where all of it is ASCII."""
    t = src.table(spark, d, "documents").select("doc_id", "text", tx.decode_latin1(F.encode("text", "UTF-8")).alias("decoded"))
    return t.select("doc_id", F.length("decoded").cast("bigint").alias("n_chars"), (F.col("decoded") == F.col("text")).alias("ascii"))


def judged(text: str):
    """A verifier in its three shapes: a bool, a decision, a mapping with a field of its own."""
    n = len(text)
    if n % 3 == 0:
        return n % 2 == 0
    if n % 3 == 1:
        return hooks.Decision(n % 2 == 0, n / 1000)
    return {"passes": n % 2 == 0, "service_time_s": 0.25, "length": n}


@query(
    "verifier_answers",
    "SELECT doc_id, length(text) % 2 = 0 AS passes, CASE length(text) % 3 WHEN 1 THEN round(length(text) / 1000.0::DOUBLE, 6) WHEN 2 THEN 0.25 END AS service_time_s, CASE WHEN length(text) % 3 = 2 THEN length(text)::VARCHAR END AS said_length FROM documents",
)
def verifier_answers(spark, d):
    """Every document before a user's verifier; a time that the verifier doesn't give is the measured one, shown as null here."""
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    v = hooks.verified(docs, judged, "text", "doc_id").join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    given = F.when(F.col("n") % 3 > 0, F.round("service_time_s", 6))
    return v.select("doc_id", "passes", given.alias("service_time_s"), F.col("metadata")["length"].alias("said_length"))


@query("hook_columns", "SELECT doc_id, lang, length(text) AS n_text, CASE WHEN doc_id % 2 = 0 THEN octet_length(encode(text)) END AS n_bytes FROM documents")
def hook_columns(spark, d):
    """A hook that adds two columns, replaces one and leaves out every other row: only what it adds has an effect."""
    docs = src.table(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("n_text"), "text")
    out = hooks.with_hook(docs, lambda df: df.filter("doc_id % 2 = 0").withColumns({"lang": F.lit("?"), "n_bytes": F.octet_length("text").cast("bigint")}), "doc_id")
    return out.drop("text")


@query("embedded_texts", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\pL\\pN_]+')) > 0 THEN 1.0::DOUBLE ELSE 0 END AS norm, 256::BIGINT AS dimensions FROM documents")
def embedded_texts(spark, d):
    """Every text through the default embedder: unit vectors, or zero without words."""
    v = det.hashed_embedder(src.table(spark, d, "documents").select("doc_id", "text"), "text", "v")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("doc_id", F.round(F.sqrt(squares), 6).alias("norm"), F.size("v").cast("bigint").alias("dimensions"))
