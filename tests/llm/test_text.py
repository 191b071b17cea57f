"""Words, hashes and windows against plain Python."""

import random

import numpy as np
import pyarrow as pa

from millrace.llm.text import Words, groups, rolling, sliding_min, slices, span_hashes, prefix_sums

TEXTS = ["a bc  d", None, "", "   ", "é\tü\x0bx\x0cy\r\nz", "one", "\x1c\x85 two", "a bc", " lead trail "]


def plain(text):
    return (text or "").encode().split()


def test_words_are_ascii_blank_separated():
    words = Words.of(pa.array(TEXTS))
    found = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)]
    assert found == [w for t in TEXTS for w in plain(t)]
    assert words.counts().tolist() == [len(plain(t)) for t in TEXTS]


def test_a_sliced_array_has_its_own_words():
    words = Words.of(pa.array(TEXTS).slice(4, 2))
    assert words.counts().tolist() == [5, 1]


def test_lower_case_is_ascii_only():
    words = Words.of(pa.array(["AbZ É"]), lower=True)
    assert bytes(words.data).decode() == "abz É"


def test_equal_words_and_windows_have_equal_hashes():
    random.seed(3)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 40))) for _ in range(50)]
    words = Words.of(pa.array(texts))
    hashes, flat = words.hashes(), [w for t in texts for w in plain(t)]
    assert len({(h, w) for h, w in zip(hashes.tolist(), flat)}) == 3
    for width in (1, 3, 7):
        windows = rolling(hashes, width)[words.fits(width)]
        want = [tuple(plain(t)[i : i + width]) for t in texts for i in range(len(plain(t)) - width + 1)]
        assert len(windows) == len(want)
        assert len(set(zip(windows.tolist(), want))) == len(set(want)) == len(set(windows.tolist()))


def test_span_hashes_know_the_length():
    sums = prefix_sums(np.zeros(4, dtype=np.uint64))
    found = span_hashes(sums, np.array([0, 0, 1]), np.array([1, 2, 3]))
    assert found[0] != found[1] and found[1] == found[2]


def test_sliding_min():
    values = np.array([5, 3, 4, 1, 9, 9, 2], dtype=np.uint64)
    for width in range(1, 9):
        want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert sliding_min(values, width).tolist() == want


def test_joined_words():
    words = Words.of(pa.array(["a  b c", "d", None, "e f"]))
    data, offsets = words.joined(np.array([True, False, True, False, True, True]))
    assert [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == [b"a c ", b"", b"", b"e f "]


def test_slices_keep_every_row_and_long_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 500, "", "z"])], ["text"])
    parts = list(slices([batch], "text", 12))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) < 5
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])
    assert list(slices([empty], "text")) == []


def test_groups_are_whole():
    keys = [1] * 5 + [2] * 700 + [3] * 2 + [4] * 300
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50]), pa.array(["v" * 9] * len(keys[i : i + 50]))], ["k", "v"])
        for i in range(0, len(keys), 50)
    ]
    seen = [t.column("k").to_pylist() for t in groups(iter(batches), "k", 1000)]
    assert [k for part in seen for k in part] == keys
    assert all(a[-1] != b[0] for a, b in zip(seen[:-1], seen[1:])) and len(seen) > 1
