import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from skarn.llm import simhash


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(rows):
    """Smallest id of each row's component, by comparison of all pairs."""
    up = {i: i for i, _ in rows}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in rows:
        for j, b in rows:
            if i < j and bin(a ^ b).count("1") <= simhash.MOST_BITS:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_prints_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcDEé", k=3))
    rows = []
    for _ in range(15):
        base = [word() for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 5)):
            some = list(base)
            some[rng.randrange(len(some))] = word()
            rows.append(rng.choice([" ", "\n", " \t"]).join(some))
    rows += [None, "", " \n", "one", "ONE", "two words", "Two  Words", "x y z", "a b c", "a b c"]
    rows = list(enumerate(rows, 7))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, print int, component_id string").repartition(3)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, classes(prints).values(), strict=True)}
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(rows)


@pytest.mark.parametrize("bucket", [4, 128])
def test_dense_prints_are_split_and_no_link_is_lost(spark, bucket):
    """Prints that agree in most bits: buckets are large at every depth, and are split until they are small."""
    rng = random.Random(3)
    dense = {rng.getrandbits(14) | 0xABCD << 40 for _ in range(700)}
    chain = {0x1234567 ^ (1 << k) - 1 for k in range(0, 60, 2)}
    prints = [p - (1 << 64) if p >> 63 else p for p in dense | chain | {rng.getrandbits(64) for _ in range(300)}]
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    from skarn.llm.graph import components

    got = {r.node: r.component for r in components(simhash.links(df, bucket=bucket)).collect()}
    rows = [(p, p & (1 << 64) - 1) for p in sorted(prints)]
    want = classes(rows)
    size = Counter(want.values())
    assert {p: c for p, c in got.items()} == {p: c for p, c in want.items() if size[c] > 1}
    assert max(size.values()) > 500


def test_long_text_null_ids_and_empty_table(spark):
    long = "Word " * 200_000 + "end"
    df = spark.createDataFrame([(1, long), (2, long.lower()), (None, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(1, f"{brute_print(long):016x}", 1), (2, f"{brute_print(long):016x}", 1), (None, f"{brute_print('q r s t'):016x}", None)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_coordinates_bound_the_distance():
    prints = np.array([random.Random(1).getrandbits(64) for _ in range(50)], np.uint64)
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    table = simhash.distances(prints).astype(int)
    assert (np.abs(table[:, None] - table[None, :]).max(2) <= far).all()
