import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from washline.llm.common import text_buffer
from washline.llm.packing import Encoder, RoundRobin, Schedule, last_sequences, pack
from washline.llm.queries import tokenizer_path

TRICKY = [
    "a  b  c\n\n d's we're they'll x''s  ", "é à  ù  z　 y", "don't 'tis 12ab34 a1b2 -- ??a <|endoftext|> ×× ÷a \x85 b\x1c c",
    "", "   ", "日本語 テキスト ", "a​ b ﻿ c", "\r\n\t x y  z", "Á ́ ʼn ǅ ª º ²³ ½",
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids_of(texts):
    return [x.ids for x in reference().encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer(spark):
    texts = TRICKY + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids, bounds = Encoder(tokenizer_path()).encode(*text_buffer(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == ids_of(texts)


def test_round_robin_state_by_definition():
    """At each boundary the whole windows are given out, counts never fall, deficits stay below an id."""
    lengths = np.array([1000, 37, 1, 4096, 500])
    robin = RoundRobin(lengths, lengths, 64)
    windows = np.arange(-(-robin.total // 64) + 1)
    served = robin.served(windows)
    assert (served.sum(1) == np.minimum(windows * 64, robin.total)).all()
    assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == lengths).all()
    due = windows[:, None] * 64 * lengths / robin.total
    assert np.abs(served[:-1] - due[:-1]).max() <= 1.5
    assert (robin.served(windows[10:12]) == served[10:12]).all()  # the same from any task


def test_weights_hold_until_a_queue_is_empty():
    robin = RoundRobin(np.array([1000, 1000]), np.array([3.0, 1.0]), 100)
    assert robin.served(np.array([1, 10])).tolist() == [[75, 25], [750, 250]]
    assert robin.served(np.array([20])).tolist() == [[1000, 1000]]
    assert Schedule(robin).find(1, 999) == 0


def test_last_sequences():
    assert last_sequences(0) == [] and last_sequences(1300) == [1024, 256, 16, 4] and sum(last_sequences(2047)) == 2047


def check_packing(rows, pieces, size):
    """Gapless sequences, whole documents, right checksums, shares of the sources."""
    ids = {i: x + [1] for i, x in enumerate(ids_of([r[1] or "" for r in rows]))}
    by_id = defaultdict(list)
    for i, r in enumerate(rows):
        by_id[r[0]].append(ids[i])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert any(
            zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and len(x) == p.doc_tokens
            for x in by_id[p.doc_id]
        )
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == size or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    covered = defaultdict(int)
    for p in pieces:
        covered[p.doc_id] += p.length
    assert covered == {k: sum(map(len, v)) for k, v in by_id.items()}
    return sequences


def test_pack(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    pieces = pack(docs, tokenizer_path(), size=512).collect()
    sequences = check_packing(rows, pieces, 512)
    source = {r[0]: r[3] for r in rows}
    total = defaultdict(int)
    for p in pieces:
        total[source[p.doc_id]] += p.length
    everything = sum(total.values())
    for members in [m for m in sequences.values() if sum(p.length for p in m) == 512]:
        own = defaultdict(int)
        for p in members:
            own[source[p.doc_id]] += p.length
        assert all(abs(own[s] - 512 * t / everything) <= 3 for s, t in total.items())


def test_pack_awkward_rows(awkward):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in awkward.collect()]
    check_packing(rows, pack(awkward.repartition(3), tokenizer_path()).collect(), 2048)
    assert pack(awkward.limit(0), tokenizer_path()).count() == 0


def test_ids_on_request(documents):
    found = pack(documents([(1, "hello world"), (2, None)]), tokenizer_path(), keep_ids=True).collect()
    assert sorted(i for p in found for i in p.ids) == sorted(ids_of(["hello world"])[0] + [1, 1])


def test_too_many_sources(documents, monkeypatch):
    monkeypatch.setattr("washline.llm.packing.MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        pack(documents([(i, "x", None, str(i)) for i in range(3)]), tokenizer_path())
