import numpy as np

from washline.llm import boosting


def test_texts_are_measured_before_the_sample_is_ordered(documents, spark, monkeypatch):
    """No task gets the whole texts of the sample; the rows taken are the same."""
    rows = [(i % 40, f"text {i} " * (1 + i % 7), "en", "a") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    measured, taught = [], []
    measure = boosting.document_statistics

    def record(docs, *args):
        measured.append(docs.count())
        return measure(docs, *args)

    monkeypatch.setattr(boosting, "document_statistics", record)
    monkeypatch.setattr(boosting, "fit_forest", lambda x, y: taught.append((x, y)))
    docs = documents(rows).repartition(4)
    for most in (30, 200):
        boosting.train(docs, labels, max_rows=most)
    # 30 labels have 90 rows, all 40 have 120.
    assert measured == [90, 120]
    assert [len(y) for _, y in taught] == [30, 120] and taught[1][1].sum() == 60
    known = {tuple(np.append(a, b)) for a, b in zip(*taught[1])}
    assert {tuple(np.append(a, b)) for a, b in zip(*taught[0])} <= known
