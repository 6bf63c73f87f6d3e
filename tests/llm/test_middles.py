import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washline.llm.middles import BlockTree, descend, fenwick, fill_in_middle, restored, totals

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(identifier, text, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"7:{'' if identifier is None else identifier}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (identifier, len(units), "plain", None, None, text)
    if h4 % 100 < spm:
        return (identifier, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (identifier, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_trees_against_running_sums(counts):
    tree = fenwick(np.array(counts, np.int64))
    sums = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    assert totals(tree, np.arange(len(counts) + 1)).tolist() == sums.tolist()
    ranks = np.arange(1, sums[-1] + 1)
    block, before = descend(tree, ranks)
    expected = [k for k, n in enumerate(counts) for _ in range(n)]
    assert block.tolist() == expected and before.tolist() == [sums[k] for k in expected]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a\n\rü€𝄞 ", max_size=30), max_size=6), st.integers(1, 7))
def test_every_cut_of_every_text(texts, block):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    tree = BlockTree(np.frombuffer(b"".join(raw), np.uint8), offsets, block)
    units = [UNIT.findall(t) for t in texts]
    assert tree.n_units().tolist() == [len(u) for u in units]
    row = np.repeat(np.arange(len(texts)), [len(u) + 1 for u in units]).astype(np.int64)
    ks = np.concatenate([np.arange(len(u) + 1) for u in units] or [np.zeros(0, np.int64)])
    at, points = tree.cut(row, ks)
    for r, k, a, p in zip(row, ks, at, points):
        head = "".join(units[r][:k])
        assert (a, p) == (len(head.encode()), len(head))


@pytest.mark.parametrize("block", [3, 1024])
def test_against_plain_loops(documents, awkward, block):
    rows = [(k, "\n".join(f"line {i} ü€" for i in range(k % 7)) + "\n" * (k % 3)) for k in range(60)]
    rows += [(100, "has <P> inside\n"), (101, "<S>"), (102, "<M\n>"), (103, "\n"), (104, "\n\n\n"), (105, "x" * 5000), (-3, "a\nb\n")]
    rows += [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = fill_in_middle(documents(rows).repartition(3), block=block)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute(*r) for r in rows), key=str)
    back = found.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_rates_and_marks(documents):
    rows = [(k, f"a{k}\nb|s|\n") for k in range(200)]
    half = fill_in_middle(documents(rows), rate=40, spm=100)
    assert sorted(map(tuple, half.collect())) == sorted(brute(*r, rate=40, spm=100) for r in rows)
    marks = ("[p(", "|s|", "\\m.")
    assert fill_in_middle(documents(rows), marks=marks).where("form <> 'plain'").count() == 0
    own = fill_in_middle(documents([(k, f"a\nb{k}\n.") for k in range(50)]), marks=marks)
    assert own.where("form <> 'plain'").count() == 50
    assert {r[0] for r in own.select(restored(F.col("output"), F.col("form"), marks)).collect()} == {f"a\nb{k}\n." for k in range(50)}


def test_no_rows(awkward):
    assert fill_in_middle(awkward.limit(0)).count() == 0
