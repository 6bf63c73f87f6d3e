import re
from collections import Counter

from washline.llm.rules import STOP_WORDS, apply_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        sum(x.lower() in STOP_WORDS for x in w),
    )


def measured(df):
    return {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_stop_words)
        for r in df.collect()
    }


def test_counts(documents):
    loop = "a b c d e f g h i "
    texts = [
        None, "", " \n\n ", "x", "the END. of The", loop * 2, loop + "j " + loop, "q " * 40, "a\na\n a\na \n\nb|#é$$",
        "one two three four five six seven eight", "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9 9 1 2 3 4 5 6 7 8",
        "\x0b\x0ctab\tcr\r\nü " * 5, "a\x1cb c\x85d", "😀 " * 9,
    ]
    found = measured(apply_rules(documents(list(enumerate(texts)))))
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts(documents):
    clean = " ".join(f"the word{i} of a" for i in range(20))
    texts = {
        1: clean, 2: "too short", 3: "again and again " * 30, 4: clean.replace("word", "### "), 5: None,
        6: " ".join(f"zq{i}" for i in range(40)), 7: " ".join("x" * 40 + str(i) for i in range(30)) + " the the",
    }
    found = {r.doc_id: (r.base_failed, r.kept) for r in apply_rules(documents(list(texts.items()))).collect()}
    assert found == {
        1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False),
        6: (False, False), 7: (False, False),
    }


def test_one_projection_without_python(documents):
    plan = apply_rules(documents([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "Join" not in plan


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = apply_rules(awkward).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_repeat_words) for r in found), key=str) == sorted(
        ((i, brute(t)[0], brute(t)[4]) for i, t in rows), key=str
    )
    assert apply_rules(awkward.limit(0)).count() == 0
