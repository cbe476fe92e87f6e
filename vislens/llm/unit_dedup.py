"""Removal of repeated lines by hashing normalised units.

A unit is compared by a 128-bit digest of its lower-cased words. All digests of the
corpus are grouped at once, the occurrence of lowest (rank, id, offset) is kept, and
every other one is reported with its offsets in the unchanged text.

Whole lines are units first. Inside lines that did not repeat, sentences are: a
passage pasted into the middle of a line still shows. What is too short for a unit
is joined with its neighbours, across line ends too, so that lines and passages of
short sentences are found.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vislens.session import cut_lineage

#: A sentence ends after this: its stop with what closes it and the blanks behind, a stop of a script without blanks, or a line end.
SENTENCE_END = r"[.!?][\"')\]*#%&$]*[ \t\r]+|\n|[。！？]+[」』）]*[ \t\r]*"
#: Scripts written without blanks: two of their characters count as one word more.
NO_BLANKS = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]"
#: Fewer words are too common to be anyone's copy and stay.
MIN_WORDS = 6
#: A digest with more than one in so many of all units is joined without a shuffle; there are fewer than this of them.
HOT_SHARE = 2000


def _digest(words: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(words)
    return int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)


def pieces(text: str, ends: list[int]):
    """(start, end, words in lower case, how many) of the parts of a text that have words."""
    start, ascii_ = 0, text.isascii()
    for end in ends if ends and ends[-1] == len(text) else [*ends, len(text)]:
        piece = text[start:end]
        words = piece.encode().lower().split() if ascii_ else piece.lower().encode().split()
        if words:
            yield start, end, b" ".join(words), len(words) + (0 if ascii_ else len(re.findall(NO_BLANKS, piece)) // 2)
        start = end


def lines(text: str, min_words: int = MIN_WORDS):
    """(start, end, digest high, digest low) of every line with enough words; its line end belongs to it."""
    for start, end, words, n in pieces(text, [m.end() for m in re.finditer("\n", text)]):
        if n >= min_words:
            yield start, end, *_digest(words)


def passages(text: str, min_words: int = MIN_WORDS):
    """(start, end, digest high, digest low) of every sentence with enough words, and around each shorter one of the
    shortest runs of whole sentences that begin or end with it and have enough words.

    Any passage of whole sentences with enough words in all is covered by such runs within it.
    """
    found = list(pieces(text, [m.end() for m in re.finditer(SENTENCE_END, text)]))
    runs = set()
    for i, piece in enumerate(found):
        for step in (1, -1):
            j, size = i, piece[3]
            while size < min_words and 0 <= j + step < len(found):
                j += step
                size += found[j][3]
            if size >= min_words:
                runs.add((min(i, j), max(i, j)))
    for i, j in sorted(runs):
        yield found[i][0], found[j][1], *_digest(b" ".join(x[2] for x in found[i : j + 1]))


def text_key(text_col: str):
    """What tells texts of one id apart."""
    return F.xxhash64(text_col)


def unit_table(docs: DataFrame, id_col: str, text_col: str, rank_col: str | None, min_words: int = MIN_WORDS, whole_lines: bool = True) -> DataFrame:
    """([rank,] id, key, whole, start, end, d1, d2): one row per line and passage; key is that of the text, whole says that it is a line."""
    named = {"rank": rank_col} if rank_col else {}
    rows = docs.select(*[F.col(c).alias(n) for n, c in named.items()], F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    own = rows.columns[:-1]
    names = [*own, "whole", "start", "end", "d1", "d2"]

    def run(batches):
        kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            held: list[tuple] = []

            def block():
                at, *columns = [pa.array(c, k) for c, k in zip(zip(*held) if held else [[]] * len(kinds), kinds)]
                return pa.record_batch([*(batch.column(k).take(at) for k in range(len(own))), *columns], names=names)

            for i, text in enumerate(batch.column(len(own))):
                text = text.as_py()
                if not text:
                    continue
                found = {u[:2]: (i, False, *u) for u in passages(text, min_words)}
                if whole_lines:
                    found |= {u[:2]: (i, True, *u) for u in lines(text, min_words)}
                held += found.values()
                if len(held) > 100_000:
                    yield block()
                    held = []
            yield block()

    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in own]
    return rows.mapInArrow(run, ", ".join([*kinds, "whole boolean, start int, end int, d1 bigint, d2 bigint"]))


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS
) -> DataFrame:
    """(id_col, start, end, kept_id, kept_start): every repeated line but the first, and the repeated passages outside such lines.

    First is the lowest rank (`rank_col`, by default the id), then id, then text
    (by hash), then offset; nulls come first. Repeats within one text count too. A
    passage within a reported line is not told of again; spans may overlap
    otherwise. Rows that repeat an id and a text are one document: their units are
    each other's equals, reported only if an earlier document has them. Of an id
    with several texts each text has units of its own. Null and empty texts have
    none. Other columns are not read. An empty table gives no rows.
    """
    return _spans(docs, id_col, text_col, rank_col, min_words).drop("__key")


def _spans(docs: DataFrame, id_col: str, text_col: str, rank_col: str | None, min_words: int) -> DataFrame:
    """As `repeated_units`, with the key of the text."""
    again = _repeated(unit_table(docs, id_col, text_col, rank_col, min_words), id_col)
    # lines do not overlap: of those that begin before a span, the last one reaches farthest
    before = W.partitionBy(id_col, "__key").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(F.col("whole"), F.col("end"))).over(before)
    return again.withColumn("__reach", reach).filter("whole or __reach is null or __reach < end").drop("whole", "__reach")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS
) -> DataFrame:
    """As `repeated_units` without whole lines: every repeated passage but the first; spans may overlap."""
    return _repeated(unit_table(docs, id_col, text_col, rank_col, min_words, whole_lines=False), id_col).drop("__key", "whole")


def _repeated(table: DataFrame, id_col: str) -> DataFrame:
    """(id_col, __key, whole, start, end, kept_id, kept_start): every unit but the first of its digest."""
    found = cut_lineage(table)
    place = F.struct(*[c for c in ("rank", "id", "key", "start") if c in found.columns])
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = cut_lineage(first)
    most = max(1000, found.count() // HOT_SHARE)
    hot, rest = F.broadcast(first.filter(F.col("n") > most).drop("n")), first.filter(F.col("n") <= most).drop("n")
    again = found.join(hot, ["d1", "d2"]).unionByName(found.join(hot, ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"]))
    return (
        again.filter(~place.eqNullSafe(F.col("first")))
        .select(F.col("id").alias(id_col), F.col("key").alias("__key"), "whole", "start", "end", F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"))
        .distinct()
    )


def cut_spans(text: str, spans) -> str:
    """The text without its spans (start, end), which may come in any order, repeat and overlap."""
    out, at = [], 0
    for start, end in sorted({(s["start"], s["end"]) for s in spans}):
        out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS, keep_empty: bool = False, length_col: str | None = None
) -> DataFrame:
    """`docs` without the lines and passages that `repeated_units` reports; columns and their order unchanged.

    A span is cut from the rows of its id and its text: of an id with several
    texts each loses its own repeats only, and so do rows with a null id.
    `length_col`, if given, gets the new length of a text that has changed.

    A row of whose text nothing but white space is left goes, unless
    `keep_empty`; rows that were empty, null or blank before stay as they are.
    """
    again = _spans(docs, id_col, text_col, rank_col, min_words)
    spans = again.groupBy(F.col(id_col).alias("__unit_id"), F.col("__key").alias("__unit_key")).agg(F.collect_list(F.struct("start", "end")).alias("__unit_spans"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else cut_spans(t, s) for t, s in zip(texts, spans)], dtype=object)

    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("__unit_id")) & (text_key(docs[text_col]) == F.col("__unit_key")), "left")
    cleaned = joined.withColumn("__unit_text", without(F.col(text_col), F.col("__unit_spans")))
    if not keep_empty:
        left = F.trim(F.translate("__unit_text", "\t\r\n\f\v", "     ")) != ""
        cleaned = cleaned.filter(F.col("__unit_spans").isNull() | left)
    new = {text_col: F.col("__unit_text")}
    if length_col:
        size = F.length("__unit_text").cast(docs.schema[length_col].dataType)
        new[length_col] = F.when(F.col("__unit_spans").isNull(), F.col(length_col)).otherwise(size)
    return cleaned.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
