import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from washline.llm import components as components_module
from washline.llm import forest, substrings
from washline.llm.forest import common_counts, labels, least_similarity, near_duplicates, prefix_length, prefix_lengths
from washline.llm.stream_dedup import exact_duplicates
from washline.llm.substrings import remove_repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """class, class size, links and links to other sets of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    linked = [
        [j for j, b in enumerate(sets) if j != i and a and b and 10 * len(a & b) >= 8 * len(a | b)]
        for i, a in enumerate(sets)
    ]
    root = [-1] * len(rows)
    for i in range(len(rows)):
        if root[i] < 0:
            stack, root[i] = [i], i
            while stack:
                for j in linked[stack.pop()]:
                    if root[j] < 0:
                        root[j] = i
                        stack.append(j)
    out = []
    for i in range(len(rows)):
        members = [j for j in range(len(rows)) if root[j] == root[i]]
        out.append(
            (rows[i][0], rows[min(members, key=key)][0], len(members), len(linked[i]),
             len({sets[j] for j in linked[i]} - {sets[i]}))
        )
    return sorted(out, key=str)


def got_classes(df):
    rows = df.select("doc_id", "class_id", "class_size", "n_links", "n_text_links").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block", [64, 2048])
def test_near_duplicates_against_all_pairs(documents, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK_SETS", block)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(170):  # more near copies than a block holds
        w = list(base)
        w[k % 58] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(500 + k, " ".join(f"{k}u{i}" for i in range(30))) for k in range(30)]
    rows += [(600, " ".join(base)), (601, " ".join(base)), (602, "a b c d"), (603, "a b c d"), (604, "a b c e")]
    assert got_classes(near_duplicates(documents(rows))) == brute_classes(rows)


def test_near_duplicates_of_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert got_classes(near_duplicates(awkward)) == brute_classes(rows)
    assert near_duplicates(awkward.limit(0)).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    assert prefix_length(0.8, 20, 8, 0.999) == 5
    assert prefix_length(0.95, 20, 8, 0.99) == 8
    assert prefix_length(0.1, 2, 8, 0.999) == 1
    t = Fraction(4, 5)
    for size in range(1, 30):  # by trying all pairs of sizes
        all_ = [Fraction(i, size + n - i) for n in range(1, 60) for i in range(1, min(n, size) + 1) if not i == n == size]
        assert least_similarity(size, t) == min((x for x in all_ if x >= t), default=None)
    lengths = prefix_lengths(t, 20, 8, 0.999)
    assert lengths[2] == [] and lengths[5][-1] == 6 and lengths[63] == [5]  # 3, 6 and 64 shingles
    for a in range(1, 65):  # two sets that can be linked have a prefix in common at which they meet often enough
        for b in range(1, 65):
            reach = [Fraction(i, a + b - i) for i in range(1, min(a, b) + 1) if not i == a == b and 5 * i >= 4 * (a + b - i)]
            if reach:
                met = set(lengths[a - 1]) & set(lengths[b - 1])
                assert 1 - (1 - float(min(reach)) ** min(met)) ** 20 >= 0.999


@pytest.mark.parametrize(("n", "span"), [(1, 5), (40, 30), (90, 4000), (300, 90)])
def test_common_counts_against_sets(monkeypatch, n, span):
    monkeypatch.setattr(forest, "_PAIRS", 50)
    pick = random.Random(n)
    left, right = ([sorted({pick.randrange(span) for _ in range(pick.randrange(1, 40))}) for _ in range(k)] for k in (n, n // 2 + 1))
    arrays = [[np.array(x, np.uint64) for x in side] for side in (left, right)]
    found = common_counts(*arrays)
    assert found.tolist() == [[len(set(a) & set(b)) for b in right] for a in left]


def near_copies(n, words=60):
    rows = []
    for k in range(n):
        w = [f"b{i}" for i in range(words)]
        w[k % words] = f"edit{k}"
        rows.append((k, " ".join(w)))
    return rows


def test_rows_grow_with_a_group_not_with_its_square(spark, documents, monkeypatch):
    """Twice as many near copies of one text make at most about twice as many rows in every staged table."""
    monkeypatch.setattr(forest, "BLOCK_SETS", 256)

    def staged(n):
        counts = defaultdict(int)
        real = forest.stage

        def counted(df, name="table"):
            out = real(df, name)
            counts[name] = max(counts[name], out.count())
            return out

        with monkeypatch.context() as m:
            m.setattr(forest, "stage", counted)
            m.setattr(components_module, "stage", counted)
            assert near_duplicates(documents(near_copies(n))).count() == n
        return counts

    small, large = staged(120), staged(240)
    assert all(large[k] <= 2.2 * small[k] + 5 for k in small), (small, large)


def test_recall_at_the_threshold(documents):
    """Pairs with a similarity of 0.8 to 0.9 among unrelated ones: at least 0.9 of them are met; all by the formula but 0.0004."""
    rows, wanted = [], []
    for k in range(300):
        w = [f"{k}w{i}" for i in range(94)]  # 90 shingles
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, " ".join(w + [f"{k}x{i}" for i in range(10 + k % 13)])))  # 0.8 to 0.9
        wanted.append(2 * k)
    found = {r.doc_id: r.class_id for r in near_duplicates(documents(rows)).collect()}
    met = sum(found[i] == found[i + 1] for i in wanted)
    assert met >= 0.99 * len(wanted)
    assert len(set(found.values())) >= len(wanted)


def test_labels_of_equal_sets():
    values = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = labels(np.concatenate([values, values]), np.array([0, 199, 199, 398]), 3, 8)
    assert (found[0] == found[2]).all()


def brute_removed(rows, width):
    order = sorted((i for i in range(len(rows))), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    words = [WORD.findall(t or "") for _, t in rows]
    big = 1 << 62
    ident = [big if r[0] is None else r[0] for r in rows]
    for i in order:
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), ident[i])
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < ident[i]:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((rows[i][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "hot"), [(3, 48), (50, 48), (50, 2)])
def test_repeated_passages_against_brute_force(documents, awkward, monkeypatch, width, hot):
    """Also when every repeated anchor counts as hot and its windows are dealt one by one."""
    monkeypatch.setattr(substrings, "HOT", hot)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(k, f"own{k} x{k} {passage} end{k}") for k in (9, 4, 7, 2)]
    rows += [(20, f"{passage} {passage}"), (21, " ".join(passage.split()[:49])), (3, "a b a b a b a b")]
    rows += [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = remove_repeated(documents(rows).repartition(5), width=width, keep_text=True)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_removed(rows, width)


def test_repeated_passages_of_no_rows(awkward):
    assert remove_repeated(awkward.limit(0)).count() == 0


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        best = min(same, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((rows[i][0], rows[best][0], len(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_duplicates(spark, awkward, write, digest_chars):
    """One hex character as digest makes different texts collide: full texts decide."""
    path = write(awkward.repartition(4))
    found = exact_duplicates(spark, path, digest_chars=digest_chars, batch_bytes=1).collect()  # a file per batch
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_exact(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})


def test_exact_duplicates_of_no_rows(spark, awkward, write):
    assert exact_duplicates(spark, write(awkward.limit(0))).count() == 0
