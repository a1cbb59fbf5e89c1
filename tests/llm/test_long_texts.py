"""Texts of 64 MB: the kernels of the operators take them whole."""
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from skarn.llm import jaccard, media, simhash, spelling, stats, wand
from skarn.llm.textkernel import texts

PERIOD = [f"word{i:04d}x" for i in range(1000)]
TIMES = 6800
N = len(PERIOD) * TIMES


@pytest.fixture(scope="module")
def long():
    text = " ".join(PERIOD * TIMES)
    assert len(text) > 64 << 20
    return texts(pa.array([text, "a b c"], pa.large_string()))


def test_statistics(long):
    found = stats.statistics(*long)
    assert found["n_words"].tolist() == [N, 3] and found["word_chars"].tolist() == [9 * N, 3] and found["n_repeat_words"].tolist() == [N, 0]
    assert found["distinct_share"].tolist() == [1000 / N, 1.0]


def test_shingles(long):
    value, first = jaccard.shingles(*long)
    assert np.diff(first).tolist() == [1000, 1]


def test_fingerprint(long):
    got = simhash.fingerprints(*long)
    ones = np.zeros(64)
    for i in range(1000):
        h = xxhash.xxh64_intdigest(" ".join(PERIOD[(i + k) % 1000] for k in range(3)), 42)
        ones += (TIMES if i < 998 else TIMES - 1) * np.array([h >> k & 1 for k in range(64)])
    assert int(got[0]) == sum(1 << k for k in range(64) if 2 * ones[k] > N - 2)


def test_postings(long):
    rows = wand.segment_rows(1, pa.array([7, 8]), *long)
    terms = dict(zip(rows.column("term").to_pylist(), rows.column("peak_tf").to_pylist(), strict=True))
    assert terms[b"word0000x"] == [TIMES] and terms[b"a"] == [1] and rows.column("terms")[0].as_py() == N + 3


def test_letters(long):
    data, offsets = long
    assert int(spelling._marked(data).sum()) == 5 * N + 3


def test_payload(long):
    data, offsets = long
    raw = data[: offsets[1]].tobytes()
    samples, n = media.decode(media.encode(raw))
    assert n == len(raw) and hashlib.sha256(samples).digest() == hashlib.sha256(media.payload_of(raw)).digest()
