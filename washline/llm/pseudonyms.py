"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

A value that passes the checks of its kind is replaced by a keyed permutation of all values
of that kind and format: a Feistel network over whole numbers, walked on until the result
is in the same class again. So a card number stays a valid card number, a date a date; equal
values get equal pseudonyms in all documents, different ones different pseudonyms, and whoever has the
key can restore them. Punctuation, country codes and mail domains stay.

In a run of digit groups every card number on group boundaries is looked for: usual groupings
(4-4-4-4, 4-6-5, 4-6-4, unbroken) first, then the longest, going on behind it. A value that touches other
digits may get another pseudonym than it has alone: one by which the same values are found again. Digits are 0 to 9;
numbers in the digits of other scripts are left as they are, in every text.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "ssn", "date")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9-])")
_SHAPE = re.compile(
    r"(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?!\.?[0-9])"
    r"|(?P<iso>[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
    r"|(?P<slash>[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/])"
    r"|(?P<dotted>[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!\.?[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])"
    r"|(?P<phone>(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"
)
#: Where a value can begin: no value is shorter.
_START = re.compile(r"(?:[+(]|(?<![0-9]))[0-9](?=[0-9() ./-]{6})")
_FREE = re.compile(r"(?<![\w.@/-])")
_CARD_FREE = re.compile(r"(?<![\w@])(?<![0-9]\.)(?<![^0-9]/)")
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
#: Numbers with a country code (behind 00 only with a separator, as ids begin so too), and with the 0 before an area code.
_ABROAD = re.compile(r"(?:\+|00(?=[1-9][0-9]{0,2}[ ./-]))[0-9]+(?:(?:[ ./-]|[ ]?\(|\)[ ]?)[0-9]+)*")
_AREA = re.compile(r"(?![0-9][0-9][-.][0-9][0-9][-.][0-9]{4}\b)0[1-9][0-9]{0,3}(?:[ ./-][0-9]{2,8})+(?![0-9])")
_ONE_DIGIT, _TWO_DIGITS = ("1", "7"), re.compile(r"2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
_CARD_GROUPS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
#: Characters behind its begin that decide whether a value begins there.
_REACH = 128


class Permutation:
    """Keyed permutations of the whole numbers below a size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32, person=b"pseudonyms").digest()

    def _round(self, tweak: bytes, k: int, value: int, width: int) -> int:
        text = tweak + bytes([k]) + value.to_bytes(-(-max(value.bit_length(), 1) // 8), "big")
        return int.from_bytes(hashlib.blake2b(text, digest_size=-(-width // 8), key=self.key).digest(), "big") & ((1 << width) - 1)

    def once(self, value: int, half: int, tweak: bytes, back: bool) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, k, left, half), left
            else:
                left, right = right, left ^ self._round(tweak, k, right, half)
        return left << half | right

    def move(
        self, value: int, size: int, tweak: bytes, same: Callable[[int], bool] = lambda _: True, back: bool = False
    ) -> int:
        """The image of ``value`` among numbers below ``size`` that are ``same``; so is ``value``."""
        half = max(1, -(-(size - 1).bit_length() // 2))
        while True:
            value = self.once(value, half, tweak, back)
            if value < size and same(value):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _with_check(digits: str) -> str:
    return next(digits + c for c in _DIGITS if luhn(digits + c))


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in _DIGITS else c for c in shape)


Fits = Callable[[str], bool]


def _card(p: Permutation, text: str, back: bool, fits: Fits) -> str:
    digits = re.sub(r"[^0-9]", "", text)
    body = digits[1:-1]
    show = lambda n: _refill(text, _with_check(digits[0] + str(n).zfill(len(body))))
    size, tweak = 10 ** len(body), b"card%d" % len(digits) + digits[0].encode()
    return show(p.move(int(body), size, tweak, lambda n: fits(show(n)), back))


def _phone(p: Permutation, text: str, back: bool, fits: Fits) -> str:
    digits = re.sub(r"[^0-9]", "", text)
    head, body = digits[:-10], digits[-10:]
    valid = lambda s: s[0] in "23456789" and s[3] in "23456789"
    kind = valid(body)
    show = lambda n: _refill(text, head + str(n).zfill(10))
    same = lambda n: valid(str(n).zfill(10)) == kind and fits(show(n))
    return show(p.move(int(body), 10**10, b"phone" + head.encode(), same, back))


def _country(digits: str) -> int:
    return 1 if digits[0] in _ONE_DIGIT else 2 if _TWO_DIGITS.match(digits) else 3


def _phone_abroad(p: Permutation, text: str, back: bool, fits: Fits) -> str:
    """Country code, a 0 before the area code and its first digit's being 0 stay."""
    digits = re.sub(r"[^0-9]", "", text)
    zeros = 0 if text[0] == "+" else len(digits) - len(digits.lstrip("0"))
    at = zeros if zeros == 1 else zeros + _country(digits[zeros:])
    at += zeros != 1 and "(0)" in text and digits[at] == "0"
    head, body = digits[:at], digits[at:]
    code = digits[zeros:at]
    if len(body) == 10 and zeros != 1:
        valid = lambda s: s[0] in "23456789" and s[3] in "23456789"
        tweak = b"phone" + code.encode()
    else:
        valid = lambda s: s[0] == "0"
        tweak = b"phone%s/%d" % (code.encode() or b"0", len(body))
    kind = valid(body)
    show = lambda n: _refill(text, head + str(n).zfill(len(body)))
    same = lambda n: valid(str(n).zfill(len(body))) == kind and fits(show(n))
    return show(p.move(int(body), 10 ** len(body), tweak, same, back))


def _is_ip(text: str) -> bool:
    try:
        return bool(ipaddress.IPv4Address(text))
    except ValueError:
        return False


def _ip(p: Permutation, text: str, back: bool, fits: Fits) -> str:
    value = int(ipaddress.IPv4Address(text))
    kind = ipaddress.IPv4Address(value).is_global
    same = lambda n: ipaddress.IPv4Address(n).is_global == kind and fits(str(ipaddress.IPv4Address(n)))
    return str(ipaddress.IPv4Address(p.move(value, 1 << 32, b"ip", same, back)))


def _is_ssn(text: str) -> bool:
    s = text.replace("-", "")
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def _ssn(p: Permutation, text: str, back: bool, fits: Fits) -> str:
    show = lambda n: _refill(text, str(n).zfill(9))
    same = lambda n: _is_ssn(str(n).zfill(9)) and fits(show(n))
    return show(p.move(int(text.replace("-", "")), 10**9, b"ssn", same, back))


def _read_date(text: str) -> tuple[datetime.date, bool] | None:
    """The day, and whether day and month stand in the order that is not usual with the separator."""
    try:
        if "-" in text:
            day, swapped = datetime.date.fromisoformat(text), False
        elif "." in text:
            a, b, year = map(int, text.split("."))
            swapped = b > 12
            day = datetime.date(year, a, b) if swapped else datetime.date(year, b, a)
        else:
            a, b, year = map(int, text.split("/"))
            swapped = a > 12
            day = datetime.date(year, b, a) if swapped else datetime.date(year, a, b)
    except ValueError:
        return None
    return (day, swapped) if _FIRST_DAY <= day.toordinal() <= _LAST_DAY else None


def _date(p: Permutation, text: str, back: bool, fits: Fits) -> str:
    day, swapped = _read_date(text)
    if "-" in text:
        sep, fields, tweak = "-", [], b"date"
    else:
        sep = "." if "." in text else "/"
        fields = text.split(sep)
        tweak = b"date" + str([len(x) for x in fields]).encode() + bytes([swapped]) + bytes(x[0] == "0" for x in fields)
        tweak += b"." * (sep == ".")

    def show(n: int) -> str:
        d = datetime.date.fromordinal(_FIRST_DAY + n)
        if sep == "-":
            return d.isoformat()
        parts = (d.day, d.month) if swapped == (sep == "/") else (d.month, d.day)
        return sep.join([*(str(x).zfill(len(w)) for x, w in zip(parts, fields)), str(d.year)])

    def same(n: int) -> bool:
        # Formats that do not show every day are permuted among those they show: a two-digit field
        # with a leading zero shows days below ten, one without does not.
        d, shown = datetime.date.fromordinal(_FIRST_DAY + n), show(n)
        if swapped and d.day <= 12:
            return False
        alike = all(len(x) == len(w) and (x[0] == "0") == (w[0] == "0") for x, w in zip(shown.split(sep), fields))
        return alike and fits(shown)

    return show(p.move(day.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, tweak, same, back))


def _mail(p: Permutation, text: str, back: bool) -> str | None:
    name, domain = text.rsplit("@", 1)
    classes = [next((s for s in (_LOWER, _UPPER, _DIGITS) if c in s), c) for c in name]
    size, value = 1, 0
    for c, s in zip(name, classes):
        value, size = value * len(s) + s.index(c), size * len(s)
    if size < 2:
        return None
    moved = p.move(value, size, b"mail" + repr([s[0] for s in classes]).encode(), back=back)
    out = []
    for s in reversed(classes):
        moved, k = divmod(moved, len(s))
        out.append(s[k])
    return "".join(reversed(out)) + "@" + domain


_DATE = ("date", _date, _read_date)
_BY_GROUP = {
    "ip": ("ip", _ip, _is_ip), "iso": _DATE, "slash": _DATE, "dotted": _DATE, "ssn": ("ssn", _ssn, _is_ssn),
    "phone": ("phone", _phone, bool), "abroad": ("phone", _phone_abroad, bool), "card": ("card", _card, bool),
}


def _cards(text: str, at: int) -> Iterator[tuple[int, bool]]:
    """Ends of the card numbers that begin here, longest first, and whether their groups are usual."""
    if not _CARD_FREE.match(text, at) or not (run := _GROUPS.match(text, at, at + 40)):
        return
    ends = [m.end() for m in re.finditer(r"[0-9]+", run[0])]
    for k in range(len(ends), 0, -1):
        digits = re.sub(r"[^0-9]", "", run[0][: ends[k - 1]])
        if 13 <= len(digits) <= 19 and digits[0] != "0" and luhn(digits):
            yield at + ends[k - 1], k == 1 or [len(x) for x in re.split("[ -]", run[0][: ends[k - 1]])] in _CARD_GROUPS


def _usual_card(text: str, at: int) -> int | None:
    return next((end for end, usual in _cards(text, at) if usual), None)


def _shaped(text: str, at: int, last: int) -> tuple[int, str] | None:
    """End and group of the value that its separators show; ``last`` is the end of the value before."""
    joined = at == last + 1 and text[last] in "-/"
    if not (joined or _FREE.match(text, at)) or not (m := _SHAPE.match(text, at)):
        return None
    follows = r"-" if m.lastgroup in ("iso", "ssn") else r"-[0-9]" if m.lastgroup == "phone" else r"(?!)"
    if re.match(follows, text[m.end() : m.end() + 2]) and not _usual_card(text, m.end() + 1):
        return None
    return (m.end(), m.lastgroup) if _BY_GROUP[m.lastgroup][2](m[0]) else None


def _gives_way(text: str, at: int, end: int) -> bool:
    """Whether a card number of usual groups begins inside, or a value that goes on behind the end."""
    for m in _START.finditer(text, at + 1, end + _REACH // 2):
        if m.start() >= end:
            break
        if _usual_card(text, m.start()) or (found := _shaped(text, m.start(), -2)) and found[0] > end:
            return True
    return False


def _abroad(text: str, at: int, last: int) -> int | None:
    """End of the telephone number with a country or area code: 8 to 15 digits, up to 11 or more if they go on."""
    joined = at == last + 1 and text[last] in "-/"
    if not (joined or _FREE.match(text, at)):
        return None
    if m := _ABROAD.match(text, at, at + 48):
        zeros = 0 if text[at] == "+" else 2
        best = None
        for g in re.finditer(r"[0-9]+", m[0]):
            digits = re.sub(r"[^0-9]", "", m[0][: g.end()])[zeros:]
            if len(digits) > 15 or digits[0] == "0" or at + g.end() == at + 48:
                break
            wanted = 11 if digits[0] == "1" else 8
            if len(digits) >= wanted and not _gives_way(text, at, at + g.end()):
                best = at + g.end()
            if len(digits) >= 11:
                break
        return best
    m = _AREA.match(text, at, at + 48)
    if m and 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 12 and not _gives_way(text, at, m.end()):
        return m.end()
    return None


def _value_at(text: str, at: int, last: int) -> tuple[int, str] | None:
    if found := _shaped(text, at, last):
        return found
    if text[at] in "+0" and (end := _abroad(text, at, last)):
        return end, "abroad"
    if end := _usual_card(text, at):
        return end, "card"
    end = next((end for end, _ in _cards(text, at) if not _gives_way(text, at, end)), None)
    return (end, "card") if end else None


def _scan(text: str, at: int = 0, last: int = -2, stop: float = float("inf")) -> list[tuple[int, int, str]]:
    """(begin, end, group) of the values that begin up to ``stop``, first come first served."""
    spans = []
    while (m := _START.search(text, at)) and m.start() <= stop:
        found = _value_at(text, m.start(), last)
        if found:
            spans.append((m.start(), *found))
            at = last = found[0]
        else:
            at = m.start() + 1
    return spans


def _numbers(text: str, permutation: Permutation, counts: dict[str, int], back: bool) -> str:
    """Each value is moved on until the values in front of it and itself are found as before.

    They then are found in the new text too; to restore them the last comes first, so that each has
    the surroundings it was moved in.
    """
    spans = _scan(text)
    if not spans:
        return text
    chars, shift = list(text), 0
    for k in reversed(range(len(spans))) if back else range(len(spans)):
        begin, end, group = spans[k]
        begin, end = begin + shift, end + shift
        first, j = max(0, begin - _REACH), k
        while j and spans[j - 1][1] > first:
            j -= 1
            first = min(first, spans[j][0])
        edge = max(0, first - 2)
        left, right = "".join(chars[edge:begin]), "".join(chars[end : end + _REACH])
        ahead = [(b - edge, e - edge, g) for b, e, g in spans[j:k]]
        last = spans[j - 1][1] - edge if j else -2

        def fits(new: str) -> bool:
            found = _scan(left + new + right, first - edge, last if last >= 0 else -2, len(left))  # noqa: B023
            return found == [*ahead, (len(left), len(left) + len(new), group)]  # noqa: B023

        kind, change, _ = _BY_GROUP[group]
        new = change(permutation, "".join(chars[begin:end]), back, fits)
        counts[kind] += 1
        chars[begin:end] = new
        spans[k] = (begin, begin + len(new), group)
        if not back:
            shift += len(new) - (end - begin)
    return "".join(chars)


def replace_values(text: str, permutation: Permutation, counts: dict[str, int], back: bool = False) -> str:
    """The text with its values replaced; ``counts`` gets their number by kind."""
    out, at = [], 0
    for m in _MAIL.finditer(text) if "@" in text else ():
        found = _mail(permutation, m[0], back)
        counts["email"] += found is not None
        out += [_numbers(text[at : m.start()], permutation, counts, back), found or m[0]]
        at = m.end()
    return "".join([*out, _numbers(text[at:], permutation, counts, back)])


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False
) -> DataFrame:
    """One row for each row: id, text with pseudonyms, and the number of values by kind (n_email, n_phone ...).

    A null text stays null. A value that fails its check (an impossible date, a card number with a
    wrong check digit) stays. ``back`` restores the values of a text made with the same key.
    """
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(secret)
        for batch in batches:
            texts, tables = batch.column(1).to_pylist(), []
            for i, (text, wanted) in enumerate(zip(texts, batch.column(2).to_pylist())):
                counts = dict.fromkeys(KINDS, 0)
                if wanted:
                    texts[i] = replace_values(text, permutation, counts, back)
                tables.append(counts)
            columns = [pa.array([t[k] for t in tables], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *columns], names=names)

    names = [id_col, text_col, *(f"n_{k}" for k in KINDS)]
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    # Only texts with a digit or an @ can have a value.
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(text.rlike("[0-9@]"), F.lit(False)).alias("wanted"))
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, `{text_col}` string, " + ", ".join(f"n_{k} long" for k in KINDS)
    )
