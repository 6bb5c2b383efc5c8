"""Several values packed in one field: one row per value, with its position.

A batch's string buffer is scanned as one byte array. Every byte gets a class by table lookup; quoted spans become a
parity mask; separators outside of quotes become value bounds; the values' bytes are gathered into one new buffer.
There is no loop over rows or characters: the only loop is over the ordinal of a quoted span within its row.

Rules (all cases have a defined result):

* null, blank and separator-only fields give no rows; empty values have no position;
* separators are , ; | tab, line ends, their full-width forms, the ideographic comma and the middle dot; a slash separates
  unless it stands directly between two letters;
* a separator directly between two words that a canonical value has around the same mark belongs to the value;
* [ ] or { } around the whole field are dropped;
* a quote opens only where a value begins and closes only where one ends; doubled or backslashed quotes within are one
  quote; a quote that is never closed is an ordinary character;
* outer blanks go (no-break spaces too), inner blanks and letter case stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OTHER, BLANK, SEP, DQUOTE, SQUOTE = range(5)

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x0B, 0x0C]] = BLANK
_CLASS[[ord(c) for c in ",;|/\t\n\r"]] = SEP
_CLASS[0x22], _CLASS[0x27] = DQUOTE, SQUOTE
_WIDE = [(m.encode(), SEP) for m in "；，、·｜"] + [(m.encode(), BLANK) for m in "   　"]
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def inner_marks(canonical: Sequence[str]) -> list[tuple[bytes, int]]:
    """(word, mark, word) byte patterns of canonical values that hold a separator directly between two letters."""
    found = set()
    for value in canonical:
        for m in re.finditer(r"([^\W\d_]+)([,;|])(?=([^\W\d_]+))", value.lower()):
            found.add(((m[1] + m[2] + m[3]).encode(), len(m[1].encode())))
    return sorted(found)


def _is_at(b: np.ndarray, at: np.ndarray, pattern: bytes) -> np.ndarray:
    """Which positions of `at` begin the pattern."""
    ok = (at >= 0) & (at + len(pattern) <= len(b))
    for k, byte in enumerate(pattern):
        ok[ok] = b[at[ok] + k] == byte
    return ok


def _classes(b: np.ndarray, lo: np.ndarray, marks: Sequence[tuple[bytes, int]]) -> np.ndarray:
    cls = _CLASS[b]
    begins = np.zeros(len(b) + 1, bool)
    begins[lo] = True
    for pattern, kind in _WIDE:
        at = np.flatnonzero(b == pattern[0])
        for p in at[_is_at(b, at, pattern)][:, None] + np.arange(len(pattern)) if len(at) else ():
            cls[p] = kind
    slash = np.flatnonzero(b == ord("/"))
    inside = slash[~begins[slash] & ~begins[slash + 1] & (slash < len(b) - 1)]
    cls[inside[_ALPHA[b[inside - 1]] & _ALPHA[b[inside + 1]]]] = OTHER
    for pattern, k in marks:
        at = np.flatnonzero(b == pattern[k]) - k
        at = at[_is_at(_LOWER[b], at, pattern)]
        before, after = np.maximum(at - 1, 0), np.minimum(at + len(pattern), len(b) - 1)
        at = at[(begins[at] | ~_ALPHA[b[before]]) & (begins[at + len(pattern)] | (at + len(pattern) >= len(b)) | ~_ALPHA[b[after]])]
        for j in range(1, len(pattern)):
            at = at[~begins[at + j]]
        cls[at + k] = OTHER
    return cls


def _ends(solid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position in `solid` (ascending) from lo on, and one past the last before hi; empty ranges come out as lo >= hi."""
    if not len(solid):
        return hi.copy(), lo.copy()
    i, j = np.searchsorted(solid, lo), np.searchsorted(solid, hi) - 1
    first = np.where(i < len(solid), solid[np.minimum(i, len(solid) - 1)], hi)
    last = np.where(j >= 0, solid[np.maximum(j, 0)] + 1, lo)
    return first, last


def _quoted(b: np.ndarray, cls: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (inclusive) of the quoted spans, and which bytes within them are dropped as escapes."""
    drop = np.zeros(len(b), bool)
    none = np.zeros(0, np.int64)
    quote = np.flatnonzero((cls == DQUOTE) | (cls == SQUOTE))
    if not len(quote):
        return none, none, drop
    escaped = (quote > 0) & (b[np.maximum(quote - 1, 0)] == ord("\\"))
    slashed, quote = quote[escaped], quote[~escaped]
    if not len(quote):
        return none, none, drop
    row = np.searchsorted(lo, quote, side="right") - 1
    keep = (row >= 0) & (quote < hi[np.maximum(row, 0)])
    quote, row = quote[keep], row[keep]
    if not len(quote):
        return none, none, drop
    solid = np.flatnonzero(cls != BLANK)
    at = np.searchsorted(solid, quote)
    before = np.where(at > 0, solid[np.maximum(at - 1, 0)], -1)
    after = np.where(at + 1 < len(solid), solid[np.minimum(at + 1, len(solid) - 1)], len(b))
    opens = (before < lo[row]) | (cls[np.maximum(before, 0)] == SEP)
    ends = (after >= hi[row]) | (cls[np.minimum(after, len(b) - 1)] == SEP)
    same = np.zeros(len(quote), bool)  # continues a run of equal quotes
    same[1:] = (np.diff(quote) == 1) & (b[quote[1:]] == b[quote[:-1]]) & (row[1:] == row[:-1])
    head = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    length = np.diff(np.append(head, len(quote)))[run]
    last = head[run] + length - 1 == np.arange(len(quote))
    opening = np.flatnonzero(opens & ~same)
    closing = {k: np.flatnonzero((b[quote] == k) & ends & last & (length % 2 == 1)) for k in (0x22, 0x27)}
    begin, end, cursor = [], [], opening[np.unique(row[opening], return_index=True)[1]] if len(opening) else none
    while len(cursor):
        close = np.full(len(cursor), -1)
        own = head[run[cursor]] + length[cursor] - 1
        even = (length[cursor] % 2 == 0) & ends[own]
        close[even] = own[even]
        for k, shut in closing.items():
            of = np.flatnonzero((b[quote[cursor]] == k) & ~even)
            if len(of) and len(shut):
                nxt = np.searchsorted(shut, own[of], side="right")
                hit = shut[np.minimum(nxt, len(shut) - 1)]
                ok = (nxt < len(shut)) & (row[hit] == row[cursor[of]])
                close[of[ok]] = hit[ok]
        done = close >= 0
        begin.append(quote[cursor[done]])
        end.append(quote[close[done]])
        nxt = np.searchsorted(opening, np.where(done, close, cursor), side="right")
        more = nxt < len(opening)
        onward = opening[np.minimum(nxt, len(opening) - 1)]
        cursor = onward[more & (row[onward] == row[cursor])]
    begin, end = np.concatenate([none, *begin]), np.concatenate([none, *end])
    order = np.argsort(begin)
    begin, end = begin[order], end[order]
    if len(begin):
        span = np.searchsorted(begin, quote, side="right") - 1
        within = (span >= 0) & (quote > begin[span]) & (quote < end[span]) & (b[quote] == b[begin[span]])
        index = np.arange(len(quote)) - head[run] - (quote[head[run]] == begin[span])  # an opening quote isn't one of the pairs
        drop[quote[within & (index % 2 == 1)]] = True
        if len(slashed):
            span = np.searchsorted(begin, slashed, side="right") - 1
            drop[slashed[(span >= 0) & (slashed < end[span])] - 1] = True
    return begin, end, drop


def split_packed(column: pa.Array, marks: Sequence[tuple[bytes, int]] = ()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent ordinals, positions from 1 and values of all non-empty values of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    base = offsets[0]
    b = np.frombuffer(raw, np.uint8)[base : offsets[-1]] if raw is not None and offsets[-1] > base else np.zeros(0, np.uint8)
    lo, hi = offsets[:-1] - base, offsets[1:] - base
    if column.null_count:
        lo = np.where(np.asarray(column.is_valid()), lo, hi)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    cls = _classes(b, lo, marks)
    start, stop = _ends(np.flatnonzero((cls != BLANK) & (b != 10) & (b != 13) & (b != 9)), lo, hi)
    boxed = stop - start >= 2
    first, final = b[np.minimum(start, len(b) - 1)], b[np.maximum(stop - 1, 0)]
    boxed &= ((first == ord("[")) & (final == ord("]"))) | ((first == ord("{")) & (final == ord("}")))
    lo, hi = np.where(boxed, start + 1, lo), np.where(boxed, stop - 1, hi)
    hi = np.maximum(lo, hi)
    begin, end, drop = _quoted(b, cls, lo, hi)
    edge = np.zeros(len(b) + 1, np.int8)
    edge[begin] += 1
    edge[end + 1] -= 1
    outside = np.cumsum(edge[:-1]) == 0
    cut = np.flatnonzero((cls == SEP) & outside)
    of = np.searchsorted(lo, cut, side="right") - 1
    inside = (of >= 0) & (cut < hi[np.maximum(of, 0)])
    cut, of = cut[inside], of[inside]
    many = np.bincount(of, minlength=n) + 1
    parent = np.repeat(np.arange(n), many)
    head = np.concatenate([[0], np.cumsum(many)[:-1]])
    left, right = np.empty(len(parent), np.int64), np.empty(len(parent), np.int64)
    is_head = np.zeros(len(parent), bool)
    is_head[head] = True
    is_tail = np.roll(is_head, -1)
    left[is_head], left[~is_head] = lo, cut + 1
    right[is_tail], right[~is_tail] = hi, cut
    solid = np.flatnonzero(cls != BLANK)
    left, right = _ends(solid, left, right)
    if len(begin):
        span = np.searchsorted(begin, left)
        span = np.minimum(span, len(begin) - 1)
        whole = (begin[span] == left) & (end[span] == right - 1) & (left < right)
        left, right = np.where(whole, left + 1, left), np.where(whole, right - 1, right)
        left, right = _ends(np.flatnonzero((cls != BLANK) & ~((b == 9) | (b == 10) | (b == 13))), left, right)
    some = left < right
    parent, left, right = parent[some], left[some], right[some]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    size = kept[right] - kept[left]
    bounds = np.concatenate([[0], np.cumsum(size)])
    inside = np.zeros(len(b) + 1, np.int8)
    inside[left] += 1
    inside[right] -= 1
    data = b[(np.cumsum(inside[:-1]) > 0) & ~drop]
    values = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    pos = np.arange(len(parent)) - np.searchsorted(parent, parent) + 1
    return parent, pos.astype(np.int32), values


def explode_packed(df: DataFrame, key: str, fields: Sequence[str], canonical: Sequence[str] = (), least: int = 1) -> DataFrame:
    """(key, field, pos, value) of each field that holds `least` values or more. Narrow: no shuffle."""
    marks = inner_marks(canonical)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, field in enumerate(fields):
                parent, pos, values = split_packed(batch.column(k + 1), marks)
                if least > 1 and len(parent):
                    keep = np.flatnonzero(np.bincount(parent)[parent] >= least)
                    parent, pos, values = parent[keep], pos[keep], values.take(pa.array(keep))
                if len(parent):
                    name = pa.DictionaryArray.from_arrays(np.zeros(len(parent), np.int8), [field]).cast(pa.string())
                    yield pa.record_batch([batch.column(0).take(pa.array(parent)), name, pa.array(pos), values.cast(pa.string())], names=[key, "field", "pos", "value"])

    return df.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field string, pos int, value string")
