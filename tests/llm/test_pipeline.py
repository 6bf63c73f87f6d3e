import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from washline.llm import boosting
from washline.llm.queries import ORACLES, QUERIES, in_fold

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_registered():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact deduplication", "near duplicates", "source mixing", "packing"]
    assert {k for k in QUERIES if k.startswith("op")} == {k for k in QUERIES if k != "pipeline"} and len(QUERIES) == 14
    assert set(ORACLES) <= set(QUERIES) and cp.ORACLE_SQL is None


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, compared with loops over its rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def through(k, df):
        path = str(tmp_path / str(k))
        out = cp.STAGES[k][1](spark, df, SF)
        out.write.parquet(path)
        return spark.read.parquet(path)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = boosting.train(docs, labels.where(~in_fold(2, 4)))
    good = {r.doc_id for r in boosting.score(docs, forest).where("score >= 0.7").collect()}
    first = through(0, docs)
    assert first.columns == docs.columns and plain(first) == plain(docs.where(F.col("doc_id").isin(*good)))

    second = through(1, first)
    groups = defaultdict(list)
    for r in first.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    stay = {min(g, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id for g in groups.values()}
    assert second.columns == docs.columns and plain(second) == plain(first.where(F.col("doc_id").isin(*stay)))

    third = through(2, second)
    rows = second.collect()
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept = Counter(find([r.doc_id for r in rows].index(r.doc_id)) for r in third.collect())
    assert set(kept.values()) == {1} and set(kept) == {find(i) for i in range(len(rows))}
    assert third.columns == docs.columns

    fourth = through(3, third)
    words = lambda df: sum(len(WORD.findall(r.text or "")) for r in df.collect())
    assert fourth.columns == docs.columns and max(plain(fourth).values()) <= 2
    assert set(plain(fourth)) <= set(plain(third))
    assert abs(words(fourth) - 1.5 * words(third)) <= 0.02 * words(third)

    pieces = through(4, fourth)
    total = defaultdict(int)
    for p in pieces.collect():
        total[p.doc_id] += p.length
    each = {p.doc_id: p.doc_tokens for p in pieces.collect()}
    copies = Counter(r.doc_id for r in fourth.collect())
    assert total == {i: each[i] * n for i, n in copies.items()}


def test_two_runs_agree(spark, tmp_path):
    """The near-duplicate and mixing stages on two writes of one table, its rows in other files and another order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = []
    for n in (1, 3):
        path = str(tmp_path / f"{n}-0")
        docs.orderBy(F.xxhash64("doc_id", F.lit(n))).repartition(n).write.parquet(path)
        for k in (2, 3):
            out = cp.STAGES[k][1](spark, spark.read.parquet(path), SF)
            path = str(tmp_path / f"{n}-{k}")
            out.write.parquet(path)
        found.append(plain(spark.read.parquet(path)))
    assert found[0] == found[1] and max(found[0].values()) == 2


def test_run_deletes_what_stages_leave(spark, monkeypatch):
    """After a run only the output of each stage is left."""
    import os

    from washline.llm.common import shared_path

    folder = os.path.dirname(shared_path(spark, "x")).removeprefix("file:")
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    assert cp.run(spark, SF).count() > 0
    assert sorted(x.rsplit("-", 1)[0] for x in there() - before) == sorted(n.replace(" ", "-") for n, _ in cp.STAGES)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_awkward_rows(spark, awkward, k):
    out = cp.STAGES[k][1](spark, awkward, SF)
    assert k == 4 or out.columns == awkward.columns
    rows = out.collect()
    if k == 1:  # rows 5, 5 and 6 share a text; so do the empty ones
        assert sorted(str(r.doc_id) for r in rows) == sorted(["10", "3", "5", "7", "8", "9", "None"])
    if k == 2:
        assert sum(r.text is not None and r.text.startswith("same text") for r in rows) == 1
    assert cp.STAGES[k][1](spark, awkward.limit(0), SF).count() == 0
