"""Byte-level BPE: encoding by recursive DuckDB queries in each partition, decoding by ordered aggregation.

A partition's texts are split into words by the tokenizer's pattern (run boundaries of character
classes, worked out for a whole chunk at once). Words not met before become token-position rows
(word, pos, token), one for each byte. A recursive query joins adjacent positions with the merge table,
finds each word's pair of lowest rank and contracts it, leftmost first, until no word has a pair left.
Words of over SHORT bytes take one statement for each step instead of a recursion, so that old steps' rows
are dropped: a step contracts all pairs that have the lowest rank of all that could still reach them. What
can reach a pair is bounded by the text itself: a token that covers a byte is a match of the vocabulary
there, so only pairs inside the matches over the pair's ends count. A pair that a contraction forms never
ranks below it, so this gives the same ids as one pair at a time.

Longer stretches without a blank are contracted in windows of LONG_AT_ONCE bytes. A window's ids are kept up to OVERLAP
bytes before its end, and the next window begins there. What makes this exact: a sequence of ids is the encoding of
its bytes if (and only if) each two neighbours are the encoding of their own bytes, as the first contraction over a
border between two ids would also happen in the two alone. So only the pair at the border is encoded by itself; if it
comes out otherwise, the border goes back by one id. Windows with the same bytes (one sign over and over) are
contracted once.

Texts are split, encoded and decoded in pieces of a few MB, so memory grows with a text only by its own bytes and ids: the
tables of DuckDB take 500 MB at most, and 64 MB of words or 16 MB of one sign need far less (see the tests).

Words and their ids are kept between the batches of a Python worker, WORDS_KEPT at most, none of over KEPT_BYTES; beyond that
the less used are forgotten, which bounds memory and changes no result. The vocabulary file is read from a path that every
executor has (a parameter).

Defined results: a null or empty text has no ids and decodes to nothing; a text of any length is encoded
whole; repeated rows are encoded alike; an empty table gives no rows; other columns of the input are not passed on.
"""
from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import chunks, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
WORDS_KEPT = 250_000
#: Bytes of a word that takes the query for short words; bytes of the words of one query, about.
SHORT = 40
WORDS_AT_ONCE = 100_000
#: Bytes of a window of a longer word, and those at its end whose ids are made again with what follows.
LONG_AT_ONCE, OVERLAP = 1 << 16, 1 << 10
#: Windows whose ids are remembered; bytes of a word that is kept with its ids, at most.
WINDOWS_KEPT, KEPT_BYTES = 8, 1 << 10
#: Bytes that are split, bytes of words that are encoded, and ids that are decoded in one go; bytes around a split piece that its borders may depend on.
SPLIT_AT_ONCE, ENCODED_AT_ONCE, DECODED_AT_ONCE, AROUND = 1 << 22, 1 << 21, 1 << 20, 64
LETTER, NUMBER, BLANK = 1, 2, 3


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = LETTER
        elif major == "N":
            kind[c] = NUMBER
    kind[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kind


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where the pattern's matches begin (and the end of all), and the index of each text's first match.

    Whether a match begins at a place depends on the few code points around it, so large chunks are split in pieces.
    """
    n, found = len(data), []
    for a in range(0, n, SPLIT_AT_ONCE):
        b = min(n, a + SPLIT_AT_ONCE)
        low, high = max(0, a - AROUND), min(n, b + AROUND)
        low += int(np.argmax((data[low : low + 4] & 0xC0) != 0x80))  # whole code points
        if high < n:
            high -= int(np.argmax((data[high - 3 : high + 1][::-1] & 0xC0) != 0x80))
        place = low + _begins(data[low:high], offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, side="right")] - low)
        found.append(place[(place >= a) & (place < b)])
    place = np.concatenate([*found, np.array([n])])
    return place, np.searchsorted(place, offsets)


def _begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where matches begin, if ``offsets`` are where texts begin or end.

    The pattern: contractions after a text's or run's start; runs of letters, of numbers and of others,
    each with one space before it; white space, of which the last character stays apart if more follows.
    """
    point = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
    width[(point >= 0xDC80) & (point <= 0xDCFF)] = 1  # a byte that is no UTF-8
    at = np.concatenate(([0], np.cumsum(width)))
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(at, offsets)] = True
    kind = _classes()[point]
    edge = doc.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    edge[n] = True
    begin = edge[:n].copy()
    blank = kind == BLANK
    # the last white space before something else stands apart
    begin |= blank & edge[1:] & ~doc[1:]
    # a space belongs to the run after it
    joined = np.zeros(n, bool)
    joined[1:] = edge[1:n] & ~doc[1:n] & ~blank[1:] & (point[:-1] == 0x20)
    begin &= ~joined
    quote = np.flatnonzero((point == 0x27) & edge[:n] & edge[1:] & ~doc[1:] & ~joined)
    quote = quote[quote + 1 < n]
    if len(quote):
        one = point[quote + 1]
        two = np.where(quote + 2 < n, point[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(doc[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        begin[after[after < n]] = True
    return at[:n][begin]


#: A token covers bytes pos..next-1 of its word; wp and nx hold the word's number above 16 bits of place.
#: p: the pairs that the merge table has; best: each word's lowest rank, leftmost, as rank, place and end.
#: Words without a pair leave the recursion as done.
ENCODE = """
WITH RECURSIVE step(wp, nx, token, done) AS (
    SELECT word::BIGINT * 65536 + pos, word::BIGINT * 65536 + pos + 1, token::BIGINT, false FROM new_tokens
  UNION ALL (
    WITH p AS (SELECT a.wp, b.nx & 65535 AS nx, m.rank
               FROM step a JOIN step b ON a.nx = b.wp JOIN merges m ON a.token * 65536 + b.token = m.pair
               WHERE NOT a.done),
         best AS (SELECT wp >> 16 AS word, min((rank::BIGINT << 32) | ((wp & 65535) << 16) | nx) AS k FROM p GROUP BY 1),
         s AS (SELECT wp, nx, token, wp & 65535 AS pos, k >> 32 AS rank, (k >> 16) & 65535 AS first, k & 65535 AS last
               FROM step LEFT JOIN best ON wp >> 16 = word WHERE NOT done)
    SELECT wp, CASE WHEN pos = first THEN (wp >> 16) * 65536 + last ELSE nx END,
           CASE WHEN pos = first THEN rank ELSE token END, rank IS NULL
    FROM s WHERE rank IS NULL OR pos <= first OR pos >= last))
SELECT wp >> 16 AS word, list(token::INTEGER ORDER BY wp) AS ids FROM step WHERE done GROUP BY 1 ORDER BY 1
"""

#: One step for words over SHORT bytes. lo: the first byte that a match over the token's first byte has; hi: the end
#: of those over its last byte. open: the lowest rank in reach is this pair's. Of overlapping pairs of one rank, those
#: at odd places of their run are contracted, up to one that isn't open.
STEP_LONG = """
WITH paired AS (SELECT *, lead(token) OVER w AS next, lead(word) OVER w AS next_word, lead(hi) OVER w AS next_hi FROM long_tokens WINDOW w AS (ORDER BY pos)),
     ranked AS (SELECT p.*, m.rank FROM paired p LEFT JOIN merges m ON p.token * 65536 + p.next = m.pair AND p.word = p.next_word),
     reach AS (SELECT *, row_number() OVER w AS i, rank IS DISTINCT FROM lag(rank) OVER w AS starts,
                 rank = min(rank) OVER (ORDER BY pos RANGE BETWEEN pos - lo PRECEDING AND coalesce(next_hi, hi) - 1 - pos FOLLOWING) AS open
               FROM ranked WINDOW w AS (ORDER BY pos)),
     runs AS (SELECT *, max(CASE WHEN starts THEN i END) OVER w AS run, max(CASE WHEN open IS NOT TRUE THEN i END) OVER w AS shut FROM reach WINDOW w AS (ORDER BY i)),
     hit AS (SELECT *, coalesce(open AND coalesce(shut, 0) < run AND (i - run) % 2 = 0, false) AS merged FROM runs),
     kept AS (SELECT *, coalesce(lag(merged) OVER (ORDER BY i), false) AS gone FROM hit)
SELECT word, pos, CASE WHEN merged THEN rank ELSE token END AS token, lo, CASE WHEN merged THEN next_hi ELSE hi END AS hi FROM kept WHERE NOT gone ORDER BY pos
"""

DECODE = """
SELECT doc, list(v.bytes ORDER BY pos) AS parts FROM doc_tokens JOIN vocabulary v USING (token) GROUP BY doc ORDER BY doc
"""


def _groups(words: list[bytes], most: int):
    """The words in groups of about ``most`` bytes, at least one word each."""
    start, size = 0, 0
    for i, w in enumerate(words):
        if i > start and size + len(w) > most:
            yield words[start:i]
            start, size = i, 0
        size += len(w)
    if start < len(words):
        yield words[start:]


@cache
def _tree(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's prefix tree: sorted edges (state * 256 + byte), where each leads, and whether a state is a token."""
    states: dict[bytes, int] = {b"": 0}
    key, to = [], []
    for token in ranks(path):
        for n in range(1, len(token) + 1):
            if token[:n] not in states:
                states[token[:n]] = len(states)
                key.append(states[token[: n - 1]] * 256 + token[n - 1])
                to.append(states[token[:n]])
    order = np.argsort(np.array(key, np.int64))
    is_token = np.zeros(len(states), bool)
    is_token[[states[t] for t in ranks(path)]] = True
    return np.array(key, np.int64)[order], np.array(to, np.int64)[order], is_token


class Codec:
    """The DuckDB side of one Python worker: vocabulary and merges as tables, and the words met so far."""

    def __init__(self, path: str):
        import duckdb

        self.path, self.rank = path, ranks(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        token = list(self.rank.items())
        self.db.register("v", pa.table({"token": pa.array([r for _, r in token], pa.int32()), "bytes": pa.array([t for t, _ in token], pa.binary())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], r) for t, r in token for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self.db.register("m", pa.table({"pair": pa.array([a * 65536 + b for a, b, _ in pairs], pa.int64()), "rank": pa.array([r for *_, r in pairs], pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.bytes = {r: t for t, r in token}
        self.width = np.zeros(max(self.bytes) + 1, np.int64)
        self.width[[*self.bytes]] = [len(t) for t in self.bytes.values()]
        self.seen: dict[bytes, np.ndarray] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self, wanted: int = 0) -> None:
        """Keeps the words used most often, up to ``wanted``, and their ids."""
        if not wanted:
            self.known: dict[bytes, int] = {}
            self.first = np.zeros(1, np.int64)  # where each known word's ids begin
            self.ids = np.zeros(0, np.int32)
            self.uses = np.zeros(0, np.int32)
            return
        keep = np.zeros(len(self.uses), bool)
        keep[np.argsort(-self.uses, kind="stable")[:wanted]] = True
        keep &= self.uses > 1
        count = np.diff(self.first)
        self.known = {w: i for i, w in enumerate(w for w, k in zip(self.known, keep, strict=True) if k)}
        self.ids = self.ids[np.repeat(keep, count)]
        self.first = np.concatenate(([0], np.cumsum(count[keep])))
        self.uses = self.uses[keep] // 2

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' bytes one after the other, and the word and the place of each."""
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        return np.frombuffer(b"".join(words), np.uint8), word, (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids, by the recursive query."""
        raw, word, pos = self._rows(words)
        self.db.register("new_tokens", pa.table({"word": word, "pos": pos, "token": self.byte[raw]}))
        got = self.db.sql(ENCODE).to_arrow_table()["ids"].combine_chunks()
        return np.diff(got.offsets.to_numpy()), got.values.to_numpy()

    def _long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words over SHORT bytes, step by step: some that fit into one window, or a single longer one."""
        if len(words) == 1 and len(words[0]) > LONG_AT_ONCE:
            ids = self._windows(words[0])
            return np.array([len(ids)]), ids
        raw, word, _ = self._rows(words)
        word, ids = self._contracted(raw, word)
        return np.bincount(word, minlength=len(words)), ids

    def _contracted(self, raw: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word of each id and all ids, for bytes and their words."""
        ends = self._matched(raw, word)
        place = np.arange(len(raw))
        rows = pa.table({"word": word, "pos": place, "token": self.byte[raw].astype(np.int64), "lo": np.searchsorted(ends, place, side="right"), "hi": ends.astype(np.int64)})
        before = rows.num_rows + 1
        while rows.num_rows < before:
            before = rows.num_rows
            self.db.register("long_tokens", rows)
            rows = self.db.sql(STEP_LONG).to_arrow_table()
        self.db.unregister("long_tokens")
        return rows["word"].to_numpy(), rows["token"].to_numpy().astype(np.int32)

    def _window(self, some: bytes) -> np.ndarray:
        """The ids of a window's bytes."""
        if some not in self.seen:
            if len(self.seen) >= WINDOWS_KEPT:
                self.seen.pop(next(iter(self.seen)))
            raw = np.frombuffer(some, np.uint8)
            self.seen[some] = self._contracted(raw, np.zeros(len(raw), np.int32))[1]
        return self.seen[some]

    def _windows(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length, window by window."""
        kept: list[np.ndarray] = []
        at, size = 0, LONG_AT_ONCE + OVERLAP
        while True:
            ids = self._window(word[at : at + size])
            if kept and not self._neighbours(int(kept[-1][-1]), int(ids[0])):
                # the border goes back by one id; each window reaches further than all before, so this ends
                back = len(self.bytes[int(kept[-1][-1])])
                at, size = at - back, size + back + OVERLAP
                kept[-1] = kept[-1][:-1]
                if not len(kept[-1]):
                    kept.pop()
                continue
            if at + size >= len(word):
                return np.concatenate([*kept, ids])
            ends = np.cumsum(self.width[ids])
            some = max(1, int(np.searchsorted(ends, size - OVERLAP, side="right")))
            kept.append(ids[:some])
            at, size = at + int(ends[some - 1]), max(LONG_AT_ONCE + OVERLAP, size if some == 1 else 0)

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether the bytes of two ids are encoded as these two."""
        if (a, b) not in self.apart:
            if len(self.apart) > WORDS_AT_ONCE:
                self.apart.clear()
            self.apart[a, b] = self._short([self.bytes[a] + self.bytes[b]])[1].tolist() == [a, b]
        return self.apart[a, b]

    def _matched(self, raw: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each byte, the end of the furthest match of the vocabulary that begins at it or before, in its word or an earlier one."""
        key, to, is_token = _tree(self.path)
        n = len(raw)
        longest = np.ones(n, np.int32)
        at, state, length = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            k = state * 256 + raw[at + length]
            i = np.minimum(np.searchsorted(key, k), len(key) - 1)
            ok = key[i] == k
            at, state = at[ok], to[i[ok]]
            length += 1
            longest[at[is_token[state]]] = length
            more = at + length < n
            more[more] = word[at[more] + length] == word[at[more]]
            at, state = at[more], state[more]
        return np.maximum.accumulate(np.arange(n, dtype=np.int32) + longest)

    def _add(self, words: list[bytes], count: np.ndarray, ids: np.ndarray) -> None:
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count)))
        self.ids = np.concatenate((self.ids, ids))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int32)))

    def learn(self, words: list[bytes]) -> None:
        """Encodes words that are not known yet, and keeps them."""
        new = [w for w in words if w not in self.known]
        whole = [w for w in new if w in self.rank]
        if whole:
            self._add(whole, np.ones(len(whole), np.int64), np.array([self.rank[w] for w in whole], np.int32))
        rest = [w for w in new if w not in self.rank]
        for contract, most, part in ((self._short, WORDS_AT_ONCE, [w for w in rest if len(w) <= SHORT]), (self._long, LONG_AT_ONCE, [w for w in rest if len(w) > SHORT])):
            for some in _groups(part, most):
                self._add(some, *contract(some))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin."""
        place, first = split(data, offsets)
        ids, count = [], []
        start, last = 0, len(place) - 1
        long = np.append(np.flatnonzero(np.diff(place) > KEPT_BYTES), last)
        while start < last:
            ahead = int(long[np.searchsorted(long, start)])
            if ahead == start:  # a long word comes by itself and isn't kept
                stop = start + 1
                some, n = self._alone(bytes(data[place[start] : place[stop]]))
            else:
                stop = min(ahead, max(start + 1, int(np.searchsorted(place, place[start] + ENCODED_AT_ONCE, side="right")) - 1))
                some, n = self._known_words(data[place[start] : place[stop]], place[start : stop + 1] - place[start])
            ids.append(some)
            count.append(n)
            start = stop
        if not ids:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(count))))[first]

    def _alone(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word of any length."""
        n, ids = (np.ones(1, np.int64), np.array([self.rank[word]], np.int32)) if word in self.rank else self._long([word])
        return ids, n

    def _known_words(self, data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each word, for words of up to KEPT_BYTES."""
        words = pa.BinaryArray.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > WORDS_KEPT:
            self.forget(WORDS_KEPT // 2)
        self.learn(distinct)
        known = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        self.uses[np.unique(known)] += 1
        begin = self.first[known]
        count = self.first[known + 1] - begin
        ends = np.cumsum(count)
        return self.ids[np.arange(int(ends[-1])) + np.repeat(begin - (ends - count), count)], count

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids; first: where each text's ids begin, and the end. A long text is decoded run by run."""
        parts: list[list[bytes]] = [[] for _ in first[1:]]
        for a in range(0, len(ids), DECODED_AT_ONCE):
            b = min(len(ids), a + DECODED_AT_ONCE)
            at = np.arange(a, b)
            self.db.register("doc_tokens", pa.table({"doc": (np.searchsorted(first, at, side="right") - 1).astype(np.int32), "pos": at, "token": ids[a:b]}))
            got = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            docs, found = got["doc"].to_numpy(), got["parts"].combine_chunks()
            flat = found.values.cast(pa.large_binary())
            byte = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            raw = memoryview(flat.buffers()[2])
            ends = byte[found.offsets.to_numpy()]
            for d, x, y in zip(docs, ends[:-1], ends[1:], strict=True):
                parts[d].append(bytes(raw[x:y]))
        self.db.unregister("doc_tokens")
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = "n_tokens long, ids array<int>, decoded binary"


def encode_decode(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, digests: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes each text: the key columns, n_tokens, ids and decoded.

    digests: ids_sha256 and decoded_sha256 (lowercase hex) come in the place of ids and decoded. path:
    the vocabulary file on every executor; None: the installed public file of that name.
    """
    kept = docs.select(*keys, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    schema = f"{fields}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def run(batches):
        c = codec(path or vocabulary_path(vocabulary))
        for batch in batches:
            for a, b in chunks(batch, text):
                part = batch.slice(a, b - a)
                ids, first = c.encode(*texts(part.column(text)))
                decoded = c.decode(ids, first)
                out = [part.column(k) for k in keys] + [pa.array(np.diff(first))]
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    out += [pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(first[:-1], first[1:], strict=True)], pa.string())]
                    out += [pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                else:
                    out += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)), pa.array([bytes(x) for x in decoded], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*keys, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])
        pa.default_memory_pool().release_unused()  # the worker stays, with the words it has met

    return kept.mapInArrow(run, schema)


def op2_recursive_bpe(spark, sf_dir):
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
