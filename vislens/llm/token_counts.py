"""Token counts of fields and sections by offsets of whole-document encodings.

A document is encoded once, as it would be for training; encoding its sections
apart would cut tokens that cross their borders. Byte-level tokens spell the
text, so cumulated token lengths are byte offsets; these are mapped to characters
and joined with the sections' character intervals. A token that crosses a border
is allocated by a rule:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, the earliest
  of equals;
* ``share``: to each section, by the share of its characters that lie there.

Tokens without a character of their own (inner bytes of one character) belong to
the character that they spell a part of.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "majority", "share")
#: Splits text into words before byte pairs are merged; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str):
    """(encoding, bytes of each token) from a file of base64 tokens and ranks; no token is special."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets (start, end) of the tokens of the whole text."""
    sizes = lengths[np.asarray(encoding.encode_ordinary(text), dtype=np.int64)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char_at = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    return char_at[starts], char_at[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; sections tile the text, `borders` are their starts and the text's end.

    Every token is counted once in all; a crossing token counts as crossing in
    each section that it touches.
    """
    n = len(borders) - 1
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends - 1, "right") - 1
    # an empty section shares its start with the next one and holds no character
    inner = first == last
    tokens = np.bincount(first[inner], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero(~inner):
        a, b, i, j = starts[t], ends[t], first[t], last[t]
        own = np.minimum(borders[i + 1 : j + 2], b) - np.maximum(borders[i : j + 1], a)
        crossing[i : j + 1] += own > 0
        if rule == "share":
            tokens[i : j + 1] += own / (b - a)
        else:
            tokens[i if rule == "start" else i + int(own.argmax())] += 1
    return tokens, crossing


def line_borders(text: str) -> np.ndarray:
    """Sections are lines with their line ends."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    if out[-1] < len(text):
        out.append(len(text))
    return np.array(out, np.int64)


def section_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str | None = "text", fields: list[str] | None = None, rule: str = "majority"
) -> DataFrame:
    """(id_col, section, start, end, n_tokens, n_crossing): tokens of every section of every row.

    Without `fields`, sections are the lines of `text_col`, numbered from 0. With
    `fields`, the document is these columns joined by line ends, each field with
    the line end behind it is a section, numbered in their order. `vocabulary` is
    a file that all executors have. n_tokens is a double under ``share``, and
    whole under the other rules. Null and empty texts have no section; a null
    field is empty. Rows that repeat an id are counted apart. Other columns are
    not read. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()
    columns = fields or [text_col]
    names = [id_col, "section", "start", "end", "n_tokens", "n_crossing"]
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(columns)])

    def run(batches):
        encoding = lengths = None
        for batch in batches:
            if encoding is None:
                encoding, lengths = load_encoding(vocabulary)
            at, parts, held = [], [], 0

            def block():
                take = pa.array(np.repeat(at, [len(p[0]) for p in parts]))
                joined = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 5
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
                return pa.record_batch([batch.column(0).take(take), *[pa.array(c, t) for c, t in zip(joined, kinds)]], names=names)

            for i in range(batch.num_rows):
                given = [batch.column(c)[i].as_py() for c in range(1, batch.num_columns)]
                if fields:
                    own = [g or "" for g in given]
                    text = "\n".join(own)
                    borders = np.cumsum([0, *(len(g) + 1 for g in own)])
                    borders[-1] -= 1
                else:
                    text = given[0] or ""
                    borders = line_borders(text)
                if not text:
                    continue
                tokens, crossing = allocate(*token_spans(text, encoding, lengths), borders, rule)
                at.append(i)
                parts.append((np.arange(len(tokens), dtype=np.int32), borders[:-1].astype(np.int32), borders[1:].astype(np.int32), tokens, crossing.astype(np.int32)))
                held += len(tokens)
                if held > 100_000:
                    yield block()
                    at, parts, held = [], [], 0
            if at:
                yield block()

    made = rows.mapInArrow(run, f"`{id_col}` {kind}, section int, start int, end int, n_tokens double, n_crossing int")
    return made if rule == "share" else made.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
