import zlib
from collections import Counter, defaultdict

import pytest

from washline.llm import kdtree
from washline.llm.kdtree import kd_shards


def brute_tree(points, dims, shards):
    """Shard of each point (weight, coordinates, tie) by sorting every node along its widest dimension."""
    spans = [max(1, max(p[1][k] for p in points) - min(p[1][k] for p in points)) for k in range(dims)]
    out = {}

    def split(node, first, leaves):
        if leaves == 1:
            out.update(dict.fromkeys(node, first))
            return
        if not node:
            return
        wide = [(max(points[i][1][k] for i in node) - min(points[i][1][k] for i in node)) / spans[k] for k in range(dims)]
        k = wide.index(max(wide))
        node = sorted(node, key=lambda i: (points[i][1][k], points[i][2]))
        want = sum(points[i][0] for i in node) * (leaves // 2) / leaves
        upto = 0
        for at, i in enumerate(node):
            w = points[i][0]
            if upto + w >= want:
                at += want - upto > upto + w - want
                break
            upto += w
        split(node[:at], first, leaves // 2)
        split(node[at:], first + leaves // 2, leaves - leaves // 2)

    split(list(range(len(points))), 0, shards)
    return out


def corpus(n=700):
    rows = []
    for k in range(n):
        text = "ä" + "x" * (1 + (k * k * 31) % 400) + str(k)
        rows.append((k, text, ["en", "de", None][k % 3], "hot" if k % 3 == 0 else f"s{k % 11}"))
    return rows + [(n + k, "copied text", "en", f"s{k % 5}") for k in range(60)]


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_tree_against_sorting(spark, documents, monkeypatch, shards):
    """Without tolerance every cut is the weighted median that sorting finds."""
    seen = {}
    real = kdtree._points
    monkeypatch.setattr(kdtree, "_points", lambda *a: seen.setdefault("points", real(*a)))
    found = kd_shards(documents(corpus()).repartition(5), shards=shards, cut_share=0).collect()
    placed, points = seen["points"]
    table = [tuple(r) for r in points.select("h", "text_crc32", "size", "piece", "weight", "c0", "c1", "c2", "tie").collect()]
    expected = brute_tree([(r[4], r[5:8], r[8]) for r in table], 3, shards)
    by_text = {r[:4]: expected[i] for i, r in enumerate(table)}
    want = Counter((r["id"], by_text[r["h"], r["text_crc32"], r["size"], r["piece"]]) for r in placed.collect())
    assert want == Counter((r.doc_id, r.shard) for r in found)


def check(found, rows, shards):
    """Columns by definition, slots without gaps in the order of ids, bytes near equal."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        members.sort(key=lambda r: r.slot)
        assert [r.slot for r in members] == list(range(len(members)))
        ids = [(r.doc_id is None, r.doc_id or 0) for r in members]
        assert ids == sorted(ids)
    return [sum(r.size for r in by[k]) for k in range(shards)]


def test_bytes_are_near_equal_and_copies_together(documents):
    rows = corpus()
    found = kd_shards(documents(rows), shards=8).collect()
    sizes = check(found, rows, 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 900
    again = kd_shards(documents(rows).repartition(3), shards=8).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    few = kd_shards(documents(rows), shards=8, group_share=0.2).collect()
    assert len({r.shard for r in few if r.doc_id >= 700}) == 1


def test_one_text_and_one_source_fill_a_third(documents):
    rows = [(k, "the same long text in many rows " * 5, "en", "hot") for k in range(900)]
    rows += [(1000 + k, "other words " * (k % 20) + str(k), "en", "hot") for k in range(1800)]
    sizes = check(kd_shards(documents(rows), shards=8).collect(), rows, 8)
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8


def test_target_bytes(documents):
    rows = corpus()
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    found = kd_shards(documents(rows), target_bytes=total // 13).collect()
    sizes = check(found, rows, 13)
    assert max(sizes) - min(sizes) <= 0.1 * total / 13


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = kd_shards(awkward)
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    check(found.collect(), rows, 8)
    assert kd_shards(awkward.limit(0)).count() == 0
