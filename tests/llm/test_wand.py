import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import wand
from skarn.llm.textkernel import texts


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=50):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = set()
    for item, ws in asked.items():
        found = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * N) // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * m)) for w in ws if b[w])
            if s > 0:
                found.append((-s, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:n], 1)}
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéñ0", k=rng.randint(1, 4))) for _ in range(300)]
    pick = lambda k: " ".join(words[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(k))
    docs = [(i, pick(rng.choice([1, 5, 30, 200])).replace(" ", rng.choice([" ", "-", "\n"]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- ++"), (n + 3, "ABC Abc aBc É"), (n + 4, "abc é"), (n + 5, "abc é")]
    items = [(k, pick(20)) for k in range(12)] + [(90, None), (91, "--"), (92, "nowhere0000"), (93, "abc abc"), (94, words[0])]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("seed", "size", "n"), [(1, 3000, 50), (2, 20_000, 5), (3, 1 << 24, 50)])
def test_ranks_and_scores_equal_brute_force(spark, monkeypatch, seed, size, n):
    """Segments of several sizes, queries in several parts."""
    monkeypatch.setattr(wand, "QUERIES_AT_ONCE", 5)
    docs, items = corpus(seed, 600)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items] + [(None, "abc", 1)], "item_id long, text string, doc_id int")
    got = wand.search(wand.index(df, segment_bytes=size), wand.query_terms(q), n).collect()
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == brute(docs, items, n)
    assert len({(r.item_id, r["rank"]) for r in got}) == len(got)


def test_blocks_unpack_to_the_postings_and_peaks_give_their_maxima():
    rng = np.random.Generator(np.random.PCG64(4))
    docs = pa.array([" ".join(["common"] * int(k) + ["rare"] * (i % 97 == 0)) for i, k in enumerate(rng.integers(1, 400, 1500))])
    rows = pa.Table.from_batches([wand.segment_rows(5, pa.array(range(1500)), *texts(docs))])
    ids, lists = wand._segment(rows, 1500, 200_000)
    names = rows.column("term").to_pylist()[1:]
    assert len(ids) == 1500
    p = lists[names.index(b"common")]
    assert len(p.last) == -(-1500 // wand.BLOCK)
    got = [p.block(b) for b in range(len(p.last))]
    assert np.concatenate([d for d, _ in got]).tolist() == list(range(1500))
    assert [int(v.max()) for _, v in got] == p.maxima.tolist()


def test_blocks_below_the_threshold_stay_packed():
    """Once good documents are known, blocks whose maxima can't reach them are skipped."""
    docs = pa.array(["top hit"] * 60 + ["hit " + "filler " * 50] * 3000)
    rows = pa.Table.from_batches([wand.segment_rows(0, pa.array(range(3060)), *texts(docs))])
    ids, lists = wand._segment(rows, 3060, 150_000)
    names = rows.column("term").to_pylist()[1:]
    asked = [(wand.weight(3060, 60), lists[names.index(b"top")]), (wand.weight(3060, 3060), lists[names.index(b"hit")])]
    best = wand.Best(50)
    scored = wand.block_max_wand(asked, ids, best)
    assert sorted(best.doc.tolist()) == list(range(50))
    assert scored <= 1200 and len(asked[1][1].blocks) <= 10 < len(asked[1][1].last)


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "abc"), (3, "abc"), (3, "abc")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    got = wand.search(wand.index(df), wand.query_terms(q)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 3, None]
    assert wand.search(wand.index(df.limit(0)), wand.query_terms(q)).count() == 0
    assert wand.search(wand.index(df), wand.query_terms(q.limit(0))).count() == 0
