"""Fill-in-the-middle documents by displacement scatter.

The texts of a batch lie one behind the other in one buffer of bytes. Token starts
are found for the whole buffer at once, and two cuts a text follow from them. A
prefix, middle or suffix moves as a whole, so the shift of a byte changes at cuts
only: a difference array holds these changes, its running sum is every byte's
shift, and one numpy scatter writes the outputs. The way back reads the sentinels
of the outputs, builds the same kind of shifts from them and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: '<', a letter, '>'.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Bytes of text that are laid out in one buffer; a longer text has one of its own.
BUFFER = 4 << 20
#: Bytes whose shifts are held at once.
BLOCK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[s[1] for s in SENTINELS.values()]] = True


def shifts(at: np.ndarray, by: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, shift of it and of those that follow) in blocks; `by` is what the shift changes by at byte `at`, which ascends."""
    held = 0
    for low in range(0, size, BLOCK):
        high = min(size, low + BLOCK)
        own = slice(*np.searchsorted(at, (low, high)))
        change = np.zeros(high - low, np.int64)
        np.add.at(change, at[own] - low, by[own])
        change[0] += held
        shift = np.cumsum(change)
        held = int(shift[-1])
        yield low, shift


def _changes(start: np.ndarray, size: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and amounts of the changes, from pieces in order that cover a buffer; empty pieces have no bytes to shift."""
    full = size > 0
    start, shift = start[full], shift[full]
    return start, np.diff(shift, prepend=0)


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where a token begins: a text's first byte, and white space behind something else."""
    white = WHITE[data]
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = True
    return np.flatnonzero(starts)


def sentinels(data: np.ndarray) -> np.ndarray:
    """Byte places of sentinels."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & LETTERS[data[1:-1]])


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a sentinel of its own, not one that two neighbours make together."""
    at = sentinels(data)
    row = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transform(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int, spm_rate: int):
    """(n, form, prefix_chars, middle_chars, output bytes, output offsets) of the texts data[offsets[i]:offsets[i + 1]]; h has four hashes a text."""
    size = np.diff(offsets)
    starts = token_starts(data, offsets)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    places = np.append(starts, 0)
    c1, c2 = (np.where(cuts[:, k] < n, places[np.minimum(first[:-1] + cuts[:, k], len(starts))], offsets[1:]) for k in (0, 1))
    moved = (size > 0) & (h[:, 2] % 100 < rate) & ~marked(data, offsets)
    spm = moved & (h[:, 3] % 100 < spm_rate)
    mark = 3 * moved
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 3 * mark, out=out[1:])
    prefix, middle, suffix = c1 - offsets[:-1], c2 - c1, offsets[1:] - c2
    # where each piece of a text goes
    to_prefix = out[:-1] + mark + np.where(spm, suffix + mark, 0)
    to_suffix = np.where(spm, out[:-1] + mark, np.where(moved, out[:-1] + prefix + 2 * mark, out[:-1] + prefix + middle))
    to_middle = np.where(moved, out[:-1] + prefix + suffix + 3 * mark, out[:-1] + prefix)
    start = np.stack([offsets[:-1], c1, c2], 1).ravel()
    piece = np.stack([prefix, middle, suffix], 1).ravel()
    to = np.stack([to_prefix, to_middle, to_suffix], 1).ravel()
    output = np.empty(int(out[-1]), np.uint8)
    for low, shift in shifts(*_changes(start, piece, to - start), len(data)):
        shift += np.arange(low, low + len(shift))
        output[shift] = data[low : low + len(shift)]
    for name, place in (("prefix", to_prefix), ("suffix", to_suffix), ("middle", to_middle)):
        output[place[moved, None] + np.arange(-3, 0)] = np.frombuffer(SENTINELS[name], np.uint8)
    form = np.where(moved, np.where(spm, SPM, PSM), PLAIN)
    chars = [[_chars(data[a:b]), _chars(data[b:c])] if m else None for m, a, b, c in zip(moved, offsets, c1, c2)]
    return n, form, chars, output, out


def restore(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that `transform` was given, as bytes and offsets, from its outputs and forms."""
    moved = form != PLAIN
    at = sentinels(data)
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[moved[row] & (at + 3 <= offsets[row + 1])]
    if len(at) != 3 * moved.sum():
        raise ValueError("an output that is not plain must have exactly three sentinels")
    where = np.repeat(offsets[:-1, None], 3, axis=1)
    where[moved] = at.reshape(-1, 3)
    end = offsets[1:]
    mark = 3 * moved
    # in order of place: the head of an output is the suffix in spm, the prefix otherwise; the tail is the middle
    head, inner, tail = (where[:, 1] - where[:, 0] - mark, where[:, 2] - where[:, 1] - mark, end - where[:, 2] - mark)
    spm = form == SPM
    prefix, suffix = np.where(spm, inner, head), np.where(spm, head, inner)
    at_prefix = where[:, 0] + mark
    at_prefix, at_suffix = np.where(spm, where[:, 1] + mark, at_prefix), np.where(spm, at_prefix, where[:, 1] + mark)
    at_middle = where[:, 2] + mark
    out = np.zeros(len(end) + 1, np.int64)
    np.cumsum(prefix + suffix + tail, out=out[1:])
    start = np.stack([out[:-1], out[:-1] + prefix, out[:-1] + prefix + tail], 1).ravel()
    piece = np.stack([prefix, tail, suffix], 1).ravel()
    source = np.stack([at_prefix, at_middle, at_suffix], 1).ravel()
    text = np.empty(int(out[-1]), np.uint8)
    for low, shift in shifts(*_changes(start, piece, source - start), len(text)):
        shift += np.arange(low, low + len(shift))
        text[low : low + len(shift)] = data[shift]
    return text, out


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a binary column without nulls, in buffers of bounded size."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BUFFER, "right")) - 1)
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def seeds(id_col: str, seed: int = 42) -> list[Column]:
    """Four 32-bit numbers of an id, as bigints: the first digits of SHA-256 over seed, colon and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output): the transformed text of every row.

    A text is cut into n tokens (white space with what follows it, trailing white
    space by itself) and, at two places drawn from the id, into prefix, middle and
    suffix. Of 100 texts about `rate` are moved, and of these `spm_rate` have the
    suffix first; the others are plain, as are empty texts and texts that hold a
    sentinel themselves. Null texts count as empty; a null id draws as an empty
    one; rows that repeat an id are transformed alike, each its own text. Pieces
    are counted in code points and null in plain rows. Other columns are not
    read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for batch in batches:
            h = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], 1)
            for low, high, data, offsets in _slices(batch.column(1)):
                n, form, chars, output, out = transform(data, offsets, h[low:high], rate, spm_rate)
                counts = [pa.array([None if c is None else c[k] for c in chars], pa.int64()) for k in (0, 1)]
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, _binary(output, out)], names=names)

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), text.alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(seeds(id_col, seed))])
    made = rows.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore_middle(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """`made` with a column `restored`, the text that each output was made from; only output and form are read for it.

    A null output or form counts as empty and plain. Of an output that isn't plain
    and hasn't three sentinels nothing can be restored: that is an error. A column
    named `restored` is replaced. An empty table gives no rows.
    """
    from pyspark.sql import types as T

    keep = [c for c in made.columns if c != "restored"]
    schema = T.StructType([made.schema[c] for c in keep] + [T.StructField("restored", T.BinaryType())])

    def run(batches):
        for batch in batches:
            forms = np.array(batch.column(len(keep)).to_pylist(), dtype=object)
            for low, high, data, offsets in _slices(batch.column(len(keep) + 1)):
                text, out = restore(data, offsets, forms[low:high])
                yield pa.record_batch([*[batch.column(k).slice(low, high - low) for k in range(len(keep))], _binary(text, out)], names=[*keep, "restored"])

    rows = made.select(*keep, F.coalesce(F.col(form_col), F.lit(PLAIN)).alias("__form"), F.coalesce(F.col(output_col).cast("binary"), F.lit(b"")).alias("__output"))
    return rows.mapInArrow(run, schema).withColumn("restored", F.col("restored").cast("string"))
