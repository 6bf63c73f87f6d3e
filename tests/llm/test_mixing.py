import re
from collections import Counter, defaultdict

import pytest

from washline.llm.balance import cycled_targets, mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(rows, cycle=(5, 2, 1), share=1.5, most=2):
    """Targets by handing out the excess round after round."""
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, target, free = share * sum(size.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * size[s]]
        for s in over or free:
            target[s] = most * size[s] if over else weight[s] * level
        free = free - set(over) if over else set()
    return dict(size), target


def corpus(n=400):
    sources = ["Z", "a", "ä", "b", "", None]
    rows = []
    for k in range(n):
        words = " ".join(["w"] * (1 + (k * k * 7919) % 97))
        rows.append((k, words, "en", sources[0] if k % 3 == 0 else sources[k % 6]))
    return rows


def test_targets_and_mix(documents):
    rows = corpus()
    found = mix_sources(documents(rows), cycled_targets()).collect()
    sizes, targets = brute_targets(rows)
    taken = Counter()
    for r in found:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-9)
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2, 0.002 * t)
    again = mix_sources(documents(rows).repartition(7), cycled_targets()).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_rates_are_an_exponential_tilt(documents):
    """Within a source the log odds of the rate are linear in the size, and the rates meet the target."""
    import math

    rows = corpus()
    by = defaultdict(list)
    for r in mix_sources(documents(rows), cycled_targets()).collect():
        by[r.source].append(r)
    for members in by.values():
        if members[0].target >= 2 * members[0].source_size:
            assert all(r.rate == 2 for r in members)
            continue
        slopes = [math.log(r.rate / (2 - r.rate)) / r.size for r in members if 1e-9 < r.rate < 2 - 1e-9]
        assert max(slopes) - min(slopes) < 1e-6
        assert sum(r.rate * r.size for r in members) == pytest.approx(members[0].target, rel=1e-6)


def test_one_size_fills_a_third(documents):
    """A cell with very many equal rows is split, and its copies still add up."""
    rows = [(k, "one two", None, "hot") for k in range(1500)] + [(2000 + k, "a b c", None, "cold") for k in range(90)]
    found = mix_sources(documents(rows), cycled_targets()).collect()
    _, targets = brute_targets(rows)
    for s, t in targets.items():
        assert abs(sum(r.taken for r in found if r.source == s) - t) <= 2


def test_awkward_rows(awkward):
    found = mix_sources(awkward, cycled_targets())
    assert found.columns == ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"]
    assert found.count() == awkward.count()
    assert all(r.taken == 0 for r in found.where("size = 0").collect())
    assert mix_sources(awkward.limit(0), cycled_targets()).count() == 0
    assert mix_sources(awkward.where("doc_id < 4"), cycled_targets()).count() == 3  # no words at all
