"""Toxic spans by a conditional random field, and document scores from its marginals.

Labels are given per document. Token labels come from them: a word or a
beginning of words counts as toxic if, in toxic documents, it occurs in many
different surroundings and far more often than in clean ones. Counting
surroundings instead of occurrences keeps copies of one toxic document from
marking all of its words. Tokens of clean documents are never toxic. The field
is fitted on a bounded sample; every row is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import astuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislens.llm.crf import EDGES, Emissions, Tagger, evidence, fit, fit_link, forward_backward

#: Training documents of each label at most, and the characters that a text adds to the fit.
MAX_DOCS, MAX_CHARS = 1500, 20_000
#: A token's marginal from which it is reported as toxic.
SPAN_AT = 0.5
#: Tokens that are tagged at once.
BLOCK_TOKENS = 200_000


def _cues(word: str):
    core = word.strip(EDGES)
    yield core
    for k in (4, 5):
        if len(core) > k:
            yield core[:k] + "*"


def toxic_cues(texts: list[list[str]], labels: list[int], least: int = 5, times: float = 12.0, words: int = 3) -> set[str]:
    """Words and beginnings (with *) that stand in `least` or more different surroundings of toxic texts, `times` as often as in clean ones.

    A beginning must be that of `words` different words there; else the word alone is what counts.
    """
    # a surrounding holds its word, so each is counted once for every cue of that word
    seen = (Counter(), Counter())
    total: tuple[set, set] = (set(), set())
    forms = defaultdict(set)
    for tokens, label in zip(texts, labels):
        padded = ["", *tokens, ""]
        for i, w in enumerate(tokens):
            around = hash((padded[i], w, padded[i + 2]))
            if around not in total[label]:
                total[label].add(around)
                for cue in _cues(w):
                    seen[label][cue] += 1
                    if label and cue.endswith("*"):
                        forms[cue].add(w.strip(EDGES))
    share = max(1, len(total[0])) / max(1, len(total[1]))
    often = (c for c, n in seen[1].items() if c and n >= least and n * share >= times * (seen[0][c] + 1))
    return {c for c in often if not c.endswith("*") or len(forms[c]) >= words}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Tagger:
    """Fits the field and the document score on at most `max_docs` documents of each label.

    The sample is the lowest hashes of the ids of `labels`, so it does not depend
    on partitioning. A text adds a stretch of at most `max_chars` characters,
    which begins where the hash of the text says; shorter texts are taken whole.
    Of rows that share an id the text of smallest hash is taken.
    Rows with a null id, label or text are not used. Without toxic documents the
    scores of all texts are below 0.5.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("__y"))
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - max_chars + 1)).cast("int") + 1
    texts = docs.filter(text.isNotNull()).select(id_col, F.substring(text, start, F.lit(max_chars)).alias("__text"))
    both = texts.join(rows.distinct(), id_col).withColumn("__h", F.xxhash64(id_col))
    sample = []
    for y in (0, 1):  # the ids first: the sort then carries no texts
        ids = both.filter(F.col("__y") == y).select(id_col, "__h").distinct().orderBy("__h", id_col).limit(max_docs).select(id_col)
        sample.append(ids.withColumn("__y", F.lit(y)))
    ids = sample[0].unionByName(sample[1])
    one = F.min(F.struct(F.xxhash64("__text").alias("h"), "__text"))["__text"].alias("__text")
    picked = texts.join(F.broadcast(ids), id_col).groupBy(id_col, "__y").agg(one)
    picked = picked.orderBy(id_col, "__text").toArrow()  # 2 * max_docs texts of bounded length
    known: dict[str, str] = {}  # one object per word
    words = [[known.setdefault(w, w) for w in map(str.lower, t.as_py().split())] for t in picked.column("__text")]
    truth = picked.column("__y").to_pylist()
    del picked
    cues = toxic_cues(words, truth)
    tags = [np.array([y == 1 and any(c in cues for c in _cues(w)) for w in x], float) for x, y in zip(words, truth)]
    model = fit(words, tags)
    lengths = np.array([len(x) for x in words], dtype=np.int64)
    emit = Emissions(model)
    marginals = forward_backward(np.array([emit[w] for x in words for w in x]), lengths, model.moves)
    if len(truth):
        fit_link(model, evidence(marginals, lengths), np.array(truth, float))
    return model


def _spans(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets of runs of toxic tokens."""
    out: list[tuple[int, int]] = []
    bad = marginals >= SPAN_AT
    if not bad.any():
        return out
    last = -2
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if bad[i]:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = i
    return out


def tagged(texts: Iterable[str | None], model: Tagger) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, tokens of each, marginals of all tokens, scores) of whole texts, in blocks."""
    emit = Emissions(model)
    held: list[str] = []
    words: list[list[str]] = []

    def block():
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        p = forward_backward(np.fromiter((emit[w] for x in words for w in x), float, int(lengths.sum())), lengths, model.moves)
        return held, lengths, p, model.score(evidence(p, lengths))

    n = 0
    for text in texts:
        text = text or ""
        held.append(text)
        # str.split and \S+ agree on what white space is
        words.append(text.lower().split() if text.isascii() else [w.lower() for w in text.split()])
        n += len(words[-1])
        if n >= BLOCK_TOKENS:
            yield block()
            held, words, n = [], [], 0
    if held:
        yield block()


def score_toxicity(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, n_toxic_tokens, spans): one row per row, spans as offsets (start, end) of offending runs.

    Null and empty texts have no tokens and get the score of no evidence. Only
    the text is an input. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # 1 MB, whatever the input
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        model = Tagger(*shared.value)
        for batch in batches:
            at = 0
            for texts, lengths, p, scores in tagged((t.as_py() for t in batch.column(1)), model):
                cuts = np.cumsum(lengths)
                found = [[{"start": a, "end": b} for a, b in _spans(t, p[b - n : b])] for t, b, n in zip(texts, cuts, lengths)]
                hits = np.add.reduceat(np.append(p >= SPAN_AT, False).astype(int), np.minimum(cuts - lengths, len(p))) * (lengths > 0)
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.record_batch([ids, pa.array(scores), pa.array(hits, pa.int32()), pa.array(found, span)], names=[id_col, "score", "n_toxic_tokens", "spans"])

    schema = f"`{id_col}` {kind}, score double, n_toxic_tokens int, spans array<struct<start:int,end:int>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score is `at` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [scores for *_, scores in tagged(texts, Tagger(*shared.value))]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.filter(score(F.col(text_col)) < at)
