"""Document statistics of whole texts, worked out for a chunk of texts at once.

Words are runs of ``[^\\x20\\x09-\\x0D]``; lines are split at line feeds. Nulls and empty texts have zeros
everywhere. Texts of any length are counted whole. Words and lines are equal if their bytes are: they are
numbered by a dictionary, and windows by pairs of such numbers.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import SPACE, Words, chunks, encoded, texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The inputs of models: shares and means, so that the length of a text alone says little.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "punct_share", "distinct_share", "same_as_last_share", "bang_share", "words_per_line", "short_word_share", "top_word_share",
)


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOL = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
LETTER = _flags(bytes([*range(65, 91), *range(97, 123)]))
DIGIT = _flags(bytes(range(48, 58)))
PUNCT = _flags(b"!\"'(),-./:;?@[\\]^_`{}~=+")


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    sums = np.concatenate(([0], np.cumsum(flag)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair of numbers, equal for equal pairs only and in the order of the left ones; and how often each occurs."""
    _, number, count = np.unique(left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right, return_inverse=True, return_counts=True)
    return number, count


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and those of them that equal an earlier one."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    cuts = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate((offsets[:-1], cuts + 1)))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = end - ((end > start) & (data[end - 1] == 0x0A))
    sums = np.concatenate(([0], np.cumsum(~SPACE[data])))
    worded = sums[end] > sums[start]
    start, end = start[worded], end[worded]
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    _, number = encoded(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)], end - start)
    all_, distinct = np.bincount(doc, minlength=n_docs), np.zeros(n_docs, np.int64)
    if len(doc):
        number, count = _pairs(doc, number)
        own = np.zeros(len(count), np.int64)
        own[number] = doc
        distinct = np.bincount(own, minlength=n_docs)
    return all_, all_ - distinct


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and FEATURES of each text."""
    words = Words(data, offsets)
    n, n_docs = words.count, len(offsets) - 1
    _, word = words.numbered()
    lead = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(lead)))
    size = points[words.end] - points[words.start]
    word_chars = np.bincount(words.doc, size, minlength=n_docs).astype(np.int64)
    lines, dup_lines = _lines(data, offsets)
    own, often = _pairs(words.doc, word)
    doc_of = np.zeros(len(often), np.int64)
    doc_of[own] = words.doc
    distinct = np.bincount(doc_of, minlength=n_docs)
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, doc_of, often)
    # words in three-word windows that occur twice in their text
    many = np.maximum(n - 2, 0)
    place = np.arange(int(many.sum())) + np.repeat(words.first[:-1] - (np.cumsum(many) - many), many)
    hit = np.zeros(len(word), bool)
    if len(place):
        window, times = _pairs(_pairs(own[place], word[place + 1])[0], word[place + 2])
        twice = place[times[window] > 1]
        for k in range(3):
            hit[twice + k] = True
    repeated = np.bincount(words.doc[hit], minlength=n_docs)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (words.doc[1:] == words.doc[:-1])
    symbols = _per_text(SYMBOL[data], offsets)
    letters = _per_text(LETTER[data], offsets)
    bang = (data == ord("!")).copy()
    bang[1:] &= data[:-1] == ord("!")
    if len(bang):
        bang[0] = False
    features = (
        np.log1p(n), _share(word_chars, n), _share(symbols, n), _share(dup_lines, lines), _share(repeated, n), _share(_per_text(UPPER[data], offsets), letters),
        _share(_per_text(DIGIT[data], offsets), word_chars), _share(_per_text(PUNCT[data], offsets), n), _share(distinct, n), _share(np.bincount(words.doc[same], minlength=n_docs), n),
        _share(_per_text(bang, offsets), n), _share(n, lines), _share(np.bincount(words.doc[size <= 3], minlength=n_docs), n), _share(top, n),
    )
    counts = (n.astype(np.int64), word_chars, symbols.astype(np.int64), dup_lines.astype(np.int64), repeated.astype(np.int64))
    return dict(zip(COUNTS, counts, strict=True)) | {k: v.astype(np.float64) for k, v in zip(FEATURES, features, strict=True)}


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text", names: tuple[str, ...] = COUNTS + FEATURES, prefix: str = "", after=None, more: str = "") -> DataFrame:
    """The columns ``keep`` and the named statistics, as ``prefix`` and their name.

    after: a function from the statistics to further Arrow columns, of the schema ``more``. The text
    is read, and returned only if kept.
    """
    inner = docs.select(*dict.fromkeys([*keep, text]))
    fields = [f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in keep]
    fields += [f"`{prefix}{c}` {'long' if c in COUNTS else 'double'}" for c in names]
    schema = ", ".join(fields + ([more] if more else []))

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch, text):
                part = batch.slice(a, b - a)
                found = statistics(*texts(part.column(text)))
                columns = [part.column(c) for c in keep] + [pa.array(found[c]) for c in names] + (after(found) if after else [])
                yield pa.RecordBatch.from_arrays(columns, [*keep, *(prefix + c for c in names), *(x.split()[0] for x in more.split(", ") if x)])

    return inner.mapInArrow(run, schema)
