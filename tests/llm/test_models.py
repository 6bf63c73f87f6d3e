import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from washline.llm import boosting, ppm
from washline.llm.common import text_buffer


def arrays(texts):
    return text_buffer(pa.array(texts, pa.string()))


def test_code_lengths_against_a_walk_down_the_tree(documents):
    """Bits of each byte as the definition says: escapes of method C, then the byte's own share."""
    trained = ["abracadabra abra", "banana band"]
    order = 2
    trees = ppm.fit(documents([(i, t, f"l{i}", None) for i, t in enumerate(trained)]), order=order)

    def brute(text, own):
        raw, total = text.encode(), 0.0
        counts = {}
        padded = b"\0" * order + own.encode()
        for i in range(len(own)):
            for k in range(order + 1):
                context, symbol = padded[i + order - k : i + order], padded[i + order]
                counts.setdefault(context, {}).setdefault(symbol, 0)
                counts[context][symbol] += 1
        padded = b"\0" * order + raw
        for i in range(len(raw)):
            for k in range(order, -1, -1):
                seen = counts.get(padded[i + order - k : i + order])
                if seen is None:
                    continue
                n, d = sum(seen.values()), len(seen)
                if padded[i + order] in seen:
                    total += np.log2((n + d) / seen[padded[i + order]])
                    break
                total += np.log2((n + d) / d)
            else:
                total += 8
        return total

    texts = ["abra", "bananas!", "", "zzz abracadabra band"]
    data, offsets = arrays(texts)
    got = ppm.code_lengths(trees, trees.slots(), data, offsets)
    want = [[brute(t, own) for own in trained] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-4)


def test_long_texts_in_pieces(documents, monkeypatch):
    trees = ppm.fit(documents([(0, "to be or not to be", "en", None), (1, "être ou ne pas être", "fr", None)]))
    data, offsets = arrays(["to be " * 50, "être " * 70, "x", ""])
    whole = ppm.code_lengths(trees, trees.slots(), data, offsets)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 37)
    np.testing.assert_allclose(ppm.code_lengths(trees, trees.slots(), data, offsets), whole, rtol=1e-6)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    trees = ppm.fit(docs.where(~held))
    found = ppm.predict(docs.where(held).drop("lang", "source"), trees).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_languages_of_awkward_rows(awkward):
    trees = ppm.fit(awkward)
    found = {(r.doc_id, r.lang_pred) for r in ppm.predict(awkward, trees).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (10, "und")} <= found
    assert ppm.predict(awkward, trees).count() == awkward.count()
    assert all(0 <= r.score <= 1 for r in ppm.predict(awkward, trees).collect())
    none = ppm.fit(awkward.limit(0))
    assert {r.lang_pred for r in ppm.predict(awkward, none).collect()} == {"und"}
    assert ppm.predict(awkward.limit(0), trees).count() == 0


def test_trees_stay_bounded(documents):
    rows = [(i, f"{zlib.crc32(str(i).encode()):x} " * 5, "en", None) for i in range(400)]
    trees = ppm.fit(documents(rows), order=3, nodes=64)
    assert max(map(len, trees.nodes)) <= 64


def test_forest_walk_against_nested_branches():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = boosting.fit_forest(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while forest.left[t][node] != node:
                node = forest.left[t][node] if row[forest.feature[t][node]] <= forest.threshold[t][node] else forest.right[t][node]
            total += forest.value[t][node]
        return total

    np.testing.assert_allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_constant_labels_and_no_rows():
    x = np.zeros((4, 3))
    assert (boosting.fit_forest(x, np.ones(4)).score(x) > 0.99).all()
    assert (boosting.fit_forest(x[:0], np.ones(0)).score(x) == 0.5).all()


def test_statistics_do_not_depend_on_the_batch():
    texts = ["One two. two two\nOne two.", "", None, "AB!! 1 # é\n\n a", "x" * 50]
    together = boosting.statistics(*arrays(texts))
    alone = np.concatenate([boosting.statistics(*arrays([t])) for t in texts])
    np.testing.assert_allclose(together, alone)
    assert not together[1].any() and not together[2].any()


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    forest = boosting.train(docs, labels.where(~held))
    found = boosting.score(docs, forest).join(labels.where(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in found]) >= 0.95


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame(
        [(1, 0), (7, 1), (8, 1), (9, 0), (None, 1), (5, None), (6, 0), (6, 1), (7, 1)], "doc_id long, quality int"
    )
    forest = boosting.train(awkward, labels)
    found = boosting.score(awkward, forest)
    assert found.count() == awkward.count() and all(0 <= r.score <= 1 for r in found.collect())
    assert boosting.score(awkward.limit(0), forest).count() == 0
    kept = boosting.accepted(awkward, forest, 0.0)
    assert kept.columns == awkward.columns and kept.exceptAll(awkward).count() == 0 and kept.count() == awkward.count()
    assert boosting.train(awkward, labels.limit(0)).score(np.zeros((1, len(boosting.STATISTICS))))[0] == 0.5
