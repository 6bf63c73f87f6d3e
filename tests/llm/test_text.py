import datetime
import re

import pytest
from pyspark.sql import functions as F

from washline.llm import perspectives as pv
from washline.llm.pseudonyms import KINDS, Permutation, luhn, pseudonymise, replace_values

TURNS = "conv_id long, turn long, role string, text string"


def brute_rotation(rows, max_turns, overlap):
    """Rendered dialogues by plain loops over sorted turns."""
    out = {}
    plain = lambda t: (t or "").replace("<|", "< |").replace("|>", "| >")
    for conv in {r[0] for r in rows}:
        turns = sorted(
            (r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "unknown", r[3] or "")
        )
        for at in range(0, len(turns), max_turns):
            own = turns[at : at + max_turns]
            shown = [i for i in range(at) if i >= at - overlap or (i < max_turns and turns[i][2] == "system")]
            for who in {r[2] or "unknown" for r in own} - {"system"}:
                text, spans = "", []
                for i in [*shown, *range(at, at + len(own))]:
                    s = turns[i][2] or "unknown"
                    role = "assistant" if s == who else s if s == "system" else "user name=" + re.sub(r"[^\w.-]+", "_", s)
                    text += f"<|im_start|>{role}\n"
                    body = plain(turns[i][3]) + "<|im_end|>"
                    if s == who and i >= at:
                        spans.append((len(text), len(text) + len(body)))
                    text += body + "\n"
                out[conv, who, at // max_turns] = (len(own), len(shown), len(spans), text, spans)
    return out


ROTATED = [
    (1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b.", "yo"), (1, 3, "ann", None),
    (1, 3, "ann", "tie"), (1, 3, "ann", "tie"), (1, None, "cy\n<|im_start|>", "late"), (2, 0, None, "who"),
    (3, 0, "system", "alone"), (None, 5, "ann", "no id"), (None, 4, "bob", "none"), (4, 0, "ann", "😀 é"),
    (5, 0, "ann", "a"), (5, 1, "system", "second"), (5, 2, "bob", "w" * 300_000), (5, 3, "system", "third"),
    (5, 4, "ann", ""), (5, 5, "bob", "b"), (5, 6, "system", "last"),
]


@pytest.mark.parametrize(("max_turns", "overlap"), [(1, 0), (2, 0), (2, 1), (2, 2), (3, 2), (256, 32)])
def test_rotation(spark, max_turns, overlap):
    df = spark.createDataFrame(ROTATED, TURNS).withColumn("rank", F.lit(1)).withColumn("conv", F.lit("x"))
    found = pv.rotate(df.repartition(3), max_turns=max_turns, overlap=overlap)
    got = {
        (r.conv_id, r.perspective, r.part): (r.n_turns, r.n_context, r.n_own, r.text, [(s.start, s.end) for s in r.spans])
        for r in found.collect()
    }
    assert got == brute_rotation(ROTATED, max_turns, overlap)


def test_rotation_on_awkward_rows(spark, awkward):
    found = pv.rotate(awkward, "source", "doc_id", "lang", max_turns=4, overlap=1).collect()
    rows = [(r.source, r.doc_id, r.lang, r.text) for r in awkward.collect()]
    got = {(r.source, r.perspective, r.part): (r.n_turns, r.n_context, r.n_own, r.text, [tuple(s) for s in r.spans]) for r in found}
    assert got == brute_rotation(rows, 4, 1)


def test_every_part_opens_with_the_system_messages_and_the_turns_before(spark):
    rows = [(7, 0, "system", "rules"), *((7, i, "ab"[i % 2], f"t{i}") for i in range(1, 301))]
    parts = {(r.perspective, r.part): r for r in pv.rotate(spark.createDataFrame(rows, TURNS)).collect()}
    second = parts["a", 1]
    assert (second.n_turns, second.n_context, second.n_own) == (45, 33, 23)
    assert second.text.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nt224<|im_end|>")
    assert second.text[second.spans[0].start :].startswith("t256<|im_end|>")


@pytest.mark.parametrize(("max_turns", "overlap"), [(0, 0), (4, 5), (4, -1)])
def test_lengths_of_parts_are_checked(spark, max_turns, overlap):
    with pytest.raises(ValueError, match="max_turns"):
        pv.rotate(spark.createDataFrame([], TURNS), max_turns=max_turns, overlap=overlap)


def test_the_mask_is_what_the_assistant_says(spark):
    df = spark.createDataFrame([(1, i, "ab"[i % 2], f"turn {i}") for i in range(9)], TURNS)
    for r in pv.rotate(df).collect():
        said = [r.text[s.start : s.end] for s in r.spans]
        assert said == [f"turn {i}<|im_end|>" for i in range(9) if "ab"[i % 2] == r.perspective]


def test_one_long_conversation_is_cut_into_parts(spark):
    rows = [(7, i // 3, "ab"[i % 2], "same") for i in range(2000)]
    found = pv.rotate(spark.createDataFrame(rows, TURNS).repartition(6), max_turns=100).collect()
    assert len(found) == 2 * 20 and all(r.n_turns == 100 for r in found)
    assert sum(r.n_own for r in found) == 2000


def test_rotation_of_no_turns(spark):
    assert pv.rotate(spark.createDataFrame([], TURNS)).count() == 0


VALUES = {
    "email": ["ann.b@mail.example.com", "X9_y@a-b.org"],
    "phone": ["+1 (743) 555-3824", "555-123-4567", "212.555.0199"],
    "card": ["4111 1111 1111 1111", "4041894974608795", "378282246310005"],
    "ip": ["8.8.8.8", "10.0.0.1", "227.5.221.1"],
    "ssn": ["078-05-1120"],
    "date": ["2024-02-29", "1/5/2024", "01/05/2024", "25/12/1999", "12/31/2001"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, values in VALUES.items() for v in values])
def test_values_keep_their_format_and_come_back(kind, value):
    p, counts = Permutation(b"k"), dict.fromkeys(KINDS, 0)
    moved = replace_values(f"see {value}, ok", p, counts)
    inside = moved[4:-4]
    assert counts == {**dict.fromkeys(KINDS, 0), kind: 1} and inside != value
    if kind != "ip":
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
        assert shape(inside) == shape(value)
    if kind == "card":
        assert luhn(re.sub(r"\D", "", inside))
    assert replace_values(moved, p, dict(counts), back=True) == f"see {value}, ok"
    assert replace_values(f"see {value}, ok", Permutation(b"other"), dict(counts)) != moved


@pytest.mark.parametrize("text", [
    "2024-02-30", "13/13/2024", "4111 1111 1111 1112", "256.1.1.1", "000-12-3456", "v1.2.3", "12345", "a@b", "2024", "1,234.50",
    "call 12-34", "abc4111111111111111", "1999-12-31-7",
])
def test_what_fails_its_check_stays(text):
    assert replace_values(text, Permutation(b"k"), dict.fromkeys(KINDS, 0)) == text


def test_permutations_are_one_to_one():
    p = Permutation(b"k")
    for size in (2, 3, 10, 1000, 1025):
        moved = [p.move(i, size, b"t") for i in range(size)]
        assert sorted(moved) == list(range(size))
        assert [p.move(m, size, b"t", back=True) for m in moved] == list(range(size))
    odd = lambda n: n % 2 == 1
    assert sorted(p.move(i, 99, b"t", odd) for i in range(1, 99, 2)) == list(range(1, 99, 2))


def test_dates_are_permuted_within_the_days():
    p, counts = Permutation(b"k"), dict.fromkeys(KINDS, 0)
    first = datetime.date(2020, 1, 1)
    days = [(first + datetime.timedelta(i)).isoformat() for i in range(400)]
    moved = [replace_values(d, p, counts) for d in days]
    assert len(set(moved)) == 400 and all(1900 <= datetime.date.fromisoformat(m).year < 2100 for m in moved)


def test_pseudonyms_link_documents(spark, awkward):
    text = "mail ann@x.org or 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text), (2, text + "!"), (3, None), (4, ""), (5, "clean text"), (None, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in pseudonymise(df, key="k").collect()}
    assert found[2].text == found[1].text + "!" and found[None].text == found[1].text != text
    assert found[3].text is None and found[4].text == "" and found[5].text == "clean text"
    assert (found[1].n_email, found[1].n_card, found[5].n_email) == (1, 1, 0)
    back = pseudonymise(pseudonymise(df, key="k").select("doc_id", "text"), key="k", back=True)
    assert back.select("doc_id", "text").exceptAll(df).count() == 0
    assert pseudonymise(awkward, key="k").count() == awkward.count()
    assert pseudonymise(awkward.limit(0), key="k").count() == 0
