import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from washline.llm import textarrays as ta
from washline.llm.common import batch_chunks, row_ranges, text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b  c\td\n", None, "", "   ", "é ü x y z a b c d e f", "a b c d e a b c d e", "x", "\x1ca\x85b c"]


def spelled(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, first = ta.words(data, offsets)
    flat = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    return [flat[first[i] : first[i + 1]] for i in range(len(texts))]


def test_words():
    assert spelled(TEXTS) == [WORD.findall(t or "") for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n.", max_size=12), max_size=6))
def test_words_of_any_text(texts):
    assert spelled(texts) == [WORD.findall(t) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    data, offsets = text_buffer(pa.array(["ab abc", "abc ab b"]))
    starts, ends, _ = ta.words(data, offsets)
    h = ta.word_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("width", [1, 5, 12, 13, 50])
def test_windows_equal_iff_their_words_are(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 2, 400).astype(np.uint64) + np.uint64(7)
    values[200:] = values[:200]
    got = ta.window_hashes(values, width)
    seen = {}
    for i in range(len(values) - width + 1):
        assert seen.setdefault(tuple(values[i : i + width].tolist()), got[i]) == got[i]
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    data, offsets = text_buffer(pa.array(TEXTS[:7]))
    _, bounds = ta.shingle_sets(data, offsets, 5)
    assert np.diff(bounds).tolist() == [1, 0, 0, 0, 7, 5, 1]  # (a b c d), none, none, none, 11 words, wrapped, (x)


def test_rows_are_cut_into_blocks_whole():
    offsets = np.array([0, 5, 5, 30, 31])
    assert list(row_ranges(offsets, 10)) == [(0, 2), (2, 3), (3, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c"])], names=["text"]).slice(1)
    assert [(i, j, bytes(d), o.tolist()) for i, j, d, o in batch_chunks(batch, "text")] == [(0, 2, b"c", [0, 0, 1])]
