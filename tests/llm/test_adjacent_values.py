import random
import re

import pytest

from washline.llm.pseudonyms import KINDS, Permutation, luhn, replace_values


def moved(text, key=b"k", back=False):
    counts = dict.fromkeys(KINDS, 0)
    return replace_values(text, Permutation(key), counts, back), {k: n for k, n in counts.items() if n}


def card(rng, n):
    body = str(rng.randint(3, 6)) + "".join(rng.choices("0123456789", k=n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def brute_cards(text):
    """(begin, end) of every sub-run of 13 to 19 digits on group boundaries that passes the check."""
    groups = list(re.finditer(r"\d+", text))
    for i, g in enumerate(groups):
        for h in groups[i:]:
            part = text[g.start() : h.end()]
            digits = re.sub(r"\D", "", part)
            if re.fullmatch(r"\d+(?:[ -]\d+)*", part) and 13 <= len(digits) <= 19 and digits[0] != "0" and luhn(digits):
                yield g.start(), h.end()


def test_no_card_number_stays_in_a_run_of_digits():
    rng = random.Random(7)
    for _ in range(1500):
        pieces = []
        for _ in range(rng.randint(1, 4)):
            c = card(rng, rng.choice([13, 14, 15, 16, 16, 16, 19]))
            grouped = re.sub(r"(\d{4})(?=\d)", r"\1" + rng.choice(" -"), c)
            pieces.append(rng.choice([c, grouped, grouped, str(rng.randint(1, 99999)), f"{rng.randint(1, 12):02}/26"]))
        text = "pay " + rng.choice([" ", "-"]).join(pieces) + rng.choice(["", ".", " now"])
        new, _ = moved(text)
        assert len(new) == len(text)
        for begin, end in brute_cards(text):
            assert new[begin:end] != text[begin:end], text
        assert moved(new, back=True)[0] == text


@pytest.mark.parametrize(("text", "counts"), [
    ("7536784127813050 4111111111111111", {"card": 2}),
    ("4111 1111 1111 1111 4111-1111-1111-1111", {"card": 2}),
    ("4111-1111-1111-1111-4111-1111-1111-1111", {"card": 2}),
    ("4111 1111 1111 1111 123", {"card": 1}), ("4111 1111 1111 1111 12/26", {"card": 1}),
    ("4111 1111 1111 1111 078-05-1120", {"card": 1, "ssn": 1}),
    ("4111 1111 1111 1111 555-123-4567", {"card": 1, "phone": 1}),
    ("078-05-1120 2024-02-29 4111111111111111 10.0.0.1", {"ssn": 1, "date": 1, "card": 1, "ip": 1}),
    ("+15551234567", {"phone": 1}), ("+442079460958", {"phone": 1}), ("+44 20 7946 0958", {"phone": 1}),
    ("+44 (0)20 7946 0958", {"phone": 1}), ("+33 1 23 45 67 89", {"phone": 1}), ("0049 30 12345678", {"phone": 1}),
    ("030 12345678", {"phone": 1}), ("+49 30 123456 4111 1111 1111 1111", {"phone": 1, "card": 1}),
    ("29.02.2024", {"date": 1}), ("1.5.2024", {"date": 1}), ("12.31.2001", {"date": 1}), ("29.02.2024.", {"date": 1}),
])
def test_values_that_touch_others(text, counts):
    new, found = moved(f"see {text}, ok")
    assert found == counts
    same = [w for w, v in zip(re.findall(r"\d{5,}|\d[\d -]{11,}\d", text), re.findall(r"\d{5,}|\d[\d -]{11,}\d", new)) if w == v]
    assert not same and moved(new, back=True)[0] == f"see {text}, ok"


def test_formats_of_a_telephone_number_get_one_pseudonym():
    digits = {re.sub(r"\D", "", moved(t)[0]) for t in ("+15551234567", "+1 (555) 123-4567", "+1 555 123 4567")}
    assert len(digits) == 1 and digits != {"15551234567"}
    assert {moved(f"{t} x")[0][:3] for t in ("+442079460958", "+44 20 7946 0958")} == {"+44"}


@pytest.mark.parametrize("text", ["31.02.2024", "1.2.3", "version 10.11.12", "0.4111111111111111", "+12 34", "007 12 34", "2024 2025 2026", "01-02-2024 10:30", "0054994038693466"])
def test_numbers_that_are_no_values_stay(text):
    assert moved(text) == (text, {})


def test_mixed_values_come_back():
    rng = random.Random(3)
    kinds = ["+44 20 7946 0958", "555-123-4567", "078-05-1120", "2024-02-29", "1.5.2024", "10.0.0.1", "4111 1111 1111 1111",
             "378282246310005", "12", "2024", "ann9@x.org", "1/5/2024", "+15551234567", "123", "030 123456", "4111"]
    for _ in range(1500):
        text = "".join(rng.choice(kinds) + rng.choice([" ", " ", "-", ", ", "/", " x "]) for _ in range(rng.randint(1, 9)))
        assert moved(moved(text)[0], back=True)[0] == text


@pytest.mark.parametrize("text", ["١٢٣-٤٥-٦٧٨٩", "at 1 ١٢٣-٤٥-٦٧٨٩", "२०२४-०१-०५", "٤١١١ ١١١١ ١١١١ ١١١١ a@", "+٤٩ ٣٠ ١٢٣٤٥٦٧"])
def test_digits_of_other_scripts_stay_in_every_text(text):
    assert moved(text)[0] == text


def test_values_beside_digits_of_other_scripts_come_back():
    for text in ("١٢ 123-45-6789", "123-45-6789 ١٢", "123-45-6789١", "١ 2024-01-05", "4111 1111 1111 1111 ٣"):
        found = moved(text)[0]
        assert found != text and moved(found, back=True)[0] == text
