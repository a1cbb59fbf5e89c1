import random
import re
import zlib
from collections import Counter

import numpy as np

from skarn.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    count = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    rows = {}
    for w, n in words.items():
        around = sorted((-words[x], x) for x in words if near(w, x))
        form = around[0][1] if around and -around[0][0] >= 5 * n else None
        rows[w] = [form, n, len(around), words[form] if form else None]
    def root(w):
        return root(rows[w][0]) if rows[w][0] else w
    return {(w, f, root(w), n, k, fn) for w, (f, n, k, fn) in rows.items()}


def table(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words_forms_and_roots_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["aaaaaa", "baaaaa", "abcabc", "Thatéñ", "Àéîõüÿ", "abÞßcd", "letter", "lettre"]
    pool = list(base)
    for w in base * 8:
        i = rng.randrange(len(w))
        pool.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aéz") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :], w]))
    pool += [x + "s" for x in pool[:20]]
    heavy = [w for k, w in enumerate(pool) for _ in range(1 + 6 ** (k % 4))]
    docs = [(i, rng.choice([" ", "×", "-", "\n", "1"]).join(rng.choices(heavy, k=60))) for i in range(300)]
    docs += [(800 + k, " ".join(["chainaa"] * 100 + ["chainab"] * 12 + ["chainbb"] * 2)) for k in range(5)]
    docs += [(900, None), (901, ""), (902, "— 123 ĀĀ")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.group_spellings(df)
    assert table(got) == brute(docs)
    assert any(r[0] != r[2] and r[1] != r[2] for r in table(got)), "some chain has two forms"


def test_checksums_delete_letters(spark):
    docs = [(i, "wordsworth") for i in range(3000)]
    got = {r.word: r.n for r in spelling.counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == Counter(w if h % 199 else w[: h % 10] + w[h % 10 + 1 :] for w, h in (("wordsworth", zlib.crc32(f"{i}:wordsworth".encode())) for i, _ in docs))
    assert len(got) > 3


def test_keys_are_the_hashes_of_what_deletions_leave():
    words = ["abcdef", "aabbcc", "aaaaaaa", "éÿàçñö", "x" * 3000 + "y" + "z" * 3000]
    key, word, lo, hi = spelling.deletion_keys(words)
    left = [words[w] if a < 0 else words[w][:a] + words[w][a + 1 :] for w, a in zip(word, lo, strict=True)]
    whole, at, *_ = spelling.deletion_keys(left)
    assert (whole[: len(left)] == key).all()
    assert {(words[w], a, b) for w, a, b in zip(word, lo, hi, strict=True) if w == 1} == {("aabbcc", -1, -1), ("aabbcc", 0, 1), ("aabbcc", 2, 3), ("aabbcc", 4, 5)}


def test_products_modulo_the_prime():
    rng = random.Random(2)
    a = [rng.randrange(spelling.PRIME) for _ in range(200)] + [0, 1, spelling.PRIME - 1]
    b = [rng.randrange(spelling.PRIME) for _ in range(200)] + [spelling.PRIME - 1] * 3
    assert spelling.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % spelling.PRIME for x, y in zip(a, b, strict=True)]


def test_long_words_and_odd_rows(spark):
    long = "ab" * 100_000
    docs = [(i, f"{long} {long}c {long[:-1]} zzzzzz") for i in range(6)] + [(None, "nullid nullid nullid nullid nullid")] + [(7, "sevens sevens")] * 3
    got = {r.word: (r.n_near, r.n) for r in spelling.group_spellings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {len(w): v[0] for w, v in got.items() if len(w) > 100} == {200_000: 2, 200_001: 1, 199_999: 1}
    assert got["sevens"] == (0, 6) and got["nullid"] == (0, 5)
    assert spelling.group_spellings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
