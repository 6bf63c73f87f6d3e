import random
import re
from collections import Counter
from itertools import permutations

import pytest

from washline.llm.audit import FILTERS, audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails_of(rows):
    out = []
    for i, (doc, text, lang) in enumerate(rows):
        t = text or ""
        w = WORD.findall(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if any((u or "") == t and other is not None and (doc is None or other < doc) for other, u, _ in rows):
            fails.add("E")
        out.append(fails)
    return out


def brute(rows, labels, names="ABCDE"):
    """Every order run over the rows, one filter after the other."""
    fails = fails_of(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations(names):
            alive = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in alive if f in fails[i]}
                redundant = sum(f in fails[i] for i in mine) - len(gone)
                alive -= gone
                out[part, "".join(order), step] = [
                    len(alive), len(gone), redundant, sum(fails[i] & set(names) == {f} for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone),
                ]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (6, 0, 0), (7, 1, 1), (None, 1, 1), (40, 1, 0), (41, None, 1), (99999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_every_order(documents, labels):
    pick = random.Random(5)
    rows = []
    for k in range(120):
        words = [f"w{pick.randrange(60)}" for _ in range(pick.choice([5, 150, 260]))]
        words += ["CAPS"] * pick.choice([0, 40]) + ["#tag"] * pick.choice([0, 0, 1])
        rows.append((k, " ".join(words), pick.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k % 7][1], "en") for k in range(60)]  # copies
    expected = brute(rows, [tuple(r) for r in labels.collect()])
    assert len(expected) == 3 * 600
    assert got(audit(documents(rows).repartition(4), labels)) == expected


def test_awkward_rows(awkward, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in awkward.select("doc_id", "text", "lang").collect()]
    found = audit(awkward, labels)
    assert found.columns == ["part", "filter_order", "step", *COUNTS]
    assert got(found) == brute(rows, [tuple(r) for r in labels.collect()])


def test_no_rows_no_failures_no_labels(documents, awkward, labels):
    assert audit(awkward.limit(0), labels).count() == 0
    fine = [(k, " ".join(f"a{k}b{i}" for i in range(220)), "en") for k in range(3)]
    assert got(audit(documents(fine), labels.limit(0))) == brute(fine, [])


def test_other_filters(documents, labels):
    rows = [(1, "a b", "en"), (2, "a b", "en"), (3, "# c", "en")]
    two = {"E": "is_copy", "D": FILTERS["D"]}
    assert got(audit(documents(rows), labels, two)) == brute(rows, [tuple(r) for r in labels.collect()], "ED")
    with pytest.raises(ValueError, match="letter"):
        audit(documents(rows), labels, {"AB": "has_symbol"})
    with pytest.raises(ValueError, match="alone"):
        audit(documents(rows), labels, {"A": "is_copy OR has_symbol"})
