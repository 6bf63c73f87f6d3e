"""Text to timestamps and numbers, as column expressions that never raise.

The parsers are long, so they are written as SQL text: one call builds the whole expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from washline.functions.names import quoted_name
from washline.functions.text import WHITESPACE


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body``, where ``name`` stands for a value computed once.

    Spelled out instead, every mention would repeat the whole expression, and a filter on
    the result, which Spark pushes below projections, would multiply it beyond measure.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# Name fragments that hint at a kind of content.
DATETIME_HINTS = ("date", "time", "timestamp", "created", "modified", "updated", "dt")
NUMERIC_HINTS = (
    "price", "amount", "total", "cost", "score", "rate", "balance", "qty", "quantity",
)

# ISO currency codes, removed as whole words.
CURRENCY_CODES = (
    "USD", "EUR", "JPY", "GBP", "INR", "AUD", "CAD", "CHF", "CNY", "HKD", "SGD", "MXN",
    "NZD", "SEK", "NOK", "DKK", "KRW", "RUB", "BRL", "ZAR", "THB", "TRY", "ARS", "EGP",
    "PLN", "BGN", "HUF", "COP", "ILS", "SAR", "BHD", "KWD", "AED", "DZD", "NGN", "PHP",
    "PKR", "BDT", "VND", "IDR", "MYR", "CLP", "CZK",
)

# Currency symbols, removed wherever they stand.
CURRENCY_SYMBOLS = (
    "$", "€", "¥", "£", "₹", "A$", "C$", "NZ$", "S$", "kr", "₩", "₽", "R$", "R", "฿",
    "₺", "zł", "лв", "Ft", "₪", "﷼", "د.إ", "₦", "₱", "₨", "₫", "Rp",
)

# The limits of nanosecond timestamps.
EARLIEST = "1677-09-21 00:12:43.145225"
LATEST = "2262-04-11 23:47:16.854775"

# ------------------------------------------------------------------ timestamps

_MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? )?"
_NTH = r"(\d{1,2})(?:st|nd|rd|th)?\.?"

# Each rule rewrites one date shape as year-month-day. A tilde after the year says that
# month and day may change places, a bar that they may not.
_DIGIT_RULES = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(3[2-9]|[4-9]\d)(\d{2})(\d{2})$", "$1|$2-$3"),
    (r"^(\d{2})(\d{2})(\d{2})$", "$3~$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$", "$3~$1-$2"),
    (r"^(\d{1,2})-(\d{4})$", "$2-$1-1"),
)
_WORD_RULES = (
    (rf"^{_WEEKDAY}({_MONTH})\.?[ -]?{_NTH},?[ -](\d{{4}})$", "$3-$1-$2"),
    (rf"^{_WEEKDAY}{_NTH}[ -]?({_MONTH})\.?,?[ -]?(\d{{4}}|\d{{2}})$", "$3-$2-$1"),
    (rf"^(\d{{4}}),?[ -]({_MONTH})\.?[ -](\d{{1,2}})$", "$1-$2-$3"),
    (rf"^({_MONTH})\.?,?[ -](\d{{4}})$", "$2-$1-1"),
    (r"^(\d{4})-?q([1-4])$", "$1-q$2-1"),
    (r"^([1-4])q-?(\d{4}|\d{2})$", "$2-q$1-1"),
)

# What any accepted shape starts with.
_DATE_START = (
    rf"^(?:\d{{1,4}}[-/. ,]|\d{{4}}|[1-4]q|\d{{1,2}}(?:st|nd|rd|th)?\.?[ -]?{_MONTH}|{_WEEKDAY}(?:{_MONTH}|\d))"
)

# The most common shape needs no rule.
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ t]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"

# Time of day at the end of a cell: 10:30, 10:30:05.123, 10:30 pm, 10pm, 10:30:05+02:00.
# It follows blanks, or a "t" right after a digit; a run of blanks is looked at once.
_CLOCK_TEXT = (
    r"(\d{1,2})(?::(\d{2})(?::(\d{2}(?:\.\d{1,9})?))? ?([ap]m)?| ?([ap]m))"
    r" ?(z|utc|gmt|[+-]\d{2}:?\d{2})?$"
)
_CLOCK = rf"(?:(?<! ) ++t?|(?<=\d)t ?){_CLOCK_TEXT}"
_CLOCK_ALONE = rf"^[ t]+{_CLOCK_TEXT}"


def _rewritten(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    for shape, form in rules:
        text = f"regexp_replace({text}, r'{shape}', '{form}')"
    return text


# The time of day can stand before the year: Fri Jan  5 10:30:00 2024.
_TIME_BEFORE_YEAR = (
    rf"^({_WEEKDAY}{_MONTH})\.? +(\d{{1,2}}) +(\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?) +(\d{{4}})$"
)

# Digits-only stamps get a visible time of day: 20240105103000 -> 20240105 10:30:00.
_SPACED = r"""
    CASE WHEN t RLIKE r'^\d{8}t?\d{6}$'
         THEN regexp_replace(t, r'^(\d{8})t?(\d{2})(\d{2})(\d{2})$', '$1 $2:$3:$4')
         WHEN t RLIKE r'^\d{8}t?\d{4}$'
         THEN regexp_replace(t, r'^(\d{8})t?(\d{2})(\d{2})$', '$1 $2:$3')
         WHEN t RLIKE r' \d{4}$' AND contains(t, ':')
         THEN regexp_replace(t, r'{_TIME_BEFORE_YEAR}', '$1 $2 $4 $3')
         ELSE t END""".replace("{_TIME_BEFORE_YEAR}", _TIME_BEFORE_YEAR)

# Date text rewritten by the rule of its shape. What it begins with leaves few rules to try:
# a year, a quarter, a day, else a month or a weekday, behind which anything but a year may stand.
_YEAR_FIRST = tuple(r for r in _WORD_RULES if r[0].startswith(r"^(\d{4})"))
_QUARTER_FIRST = tuple(r for r in _WORD_RULES if r[0].startswith("^([1-4])q"))
_DAY_FIRST = tuple(r for r in _WORD_RULES if r[0].startswith(f"^{_WEEKDAY}{_NTH}"))
_NAME_FIRST = tuple(r for r in _WORD_RULES if r not in _YEAR_FIRST + _QUARTER_FIRST)
_YEAR_MONTH_DAY = rf"""
    CASE WHEN day RLIKE r'^[-/. 0-9]+$'
         THEN {_rewritten("translate(day, '/. ', '---')", _DIGIT_RULES)}
         WHEN day RLIKE r'^\d{{4}}' THEN {_rewritten("day", _YEAR_FIRST)}
         WHEN day RLIKE r'^[1-4]q' THEN {_rewritten("day", _QUARTER_FIRST)}
         WHEN day RLIKE r'^\d' THEN {_rewritten("day", _DAY_FIRST)}
         ELSE {_rewritten("day", _NAME_FIRST)} END"""

# Two-digit years follow the POSIX rule: 69-99 are 1969-1999, 00-68 are 2000-2068.
_FULL_YEAR = """
    concat(CASE WHEN length(y) > 2 THEN '' WHEN y >= '69' THEN '19' ELSE '20' END, y)"""

_MONTH_NUMBER = r"""
    CASE WHEN m RLIKE r'^\d' THEN m
         WHEN startswith(m, 'q') THEN cast(instr('1..2..3..4', substr(m, 2, 1)) AS string)
         ELSE cast(cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', substr(m, 1, 3)) + 2) / 3
                        AS int) AS string) END"""

# DATE from year-month-day text, where the month may be a name or a quarter. Every part has
# digits only, so no text after a date gets lost.
_PART = r"'^\d{1,2}$'"
_LOOSE_DATE = f"""
    CASE WHEN size(a) = 3 AND p.y RLIKE r'^\\d{{4}}$' AND p.m RLIKE r{_PART} AND p.d RLIKE r{_PART}
         THEN coalesce(try_cast(concat(p.y, '-', p.m, '-', p.d) AS date),
                       CASE WHEN contains(ymd, '~')
                            THEN try_cast(concat(p.y, '-', p.d, '-', p.m) AS date) END) END"""
_PARTS = f"""
    named_struct('y', {_let("y", "get(a, 0)", _FULL_YEAR)},
                 'm', {_let("m", "get(a, 1)", _MONTH_NUMBER)},
                 'd', get(a, 2))"""
_DATE = f"""
    CASE WHEN ymd RLIKE r'[~|a-z]'
         THEN {_let("a", "split(ymd, r'[-~|]')", _let("p", _PARTS, _LOOSE_DATE))}
         WHEN ymd RLIKE r'^\\d{{4}}(?:-\\d{{1,2}}){{0,2}}$' THEN try_cast(ymd AS date) END"""

# Time of day as 24-hour text, and the offset from UTC in minutes.
_CLOCK_PARTS = f"""
    named_struct({", ".join(
        f"'{name}', regexp_extract(tail, r'{_CLOCK_ALONE}', {i})"
        for i, name in enumerate(("h", "m", "s", "half_a", "half_b", "zone"), 1)
    )})"""
_HOUR = r"""
    CASE WHEN concat(k.half_a, k.half_b) = '' THEN k.h
         WHEN NOT k.h RLIKE r'^(?:0?[1-9]|1[0-2])$' THEN 'x'
         ELSE cast(cast(k.h AS int) % 12
                   + CASE WHEN 'pm' IN (k.half_a, k.half_b) THEN 12 ELSE 0 END AS string) END"""
_OFFSET = r"""
    CASE WHEN k.zone RLIKE r'^[+-]'
         THEN cast(concat(substr(k.zone, 1, 1), '1') AS int)
              * (cast(substr(k.zone, 2, 2) AS int) * 60 + cast(substr(k.zone, -2, 2) AS int))
         ELSE 0 END"""
_STAMP = f"""
    try_cast(concat(cast(date AS string), ' ', {_HOUR}, ':',
                    CASE WHEN k.m = '' THEN '0' ELSE k.m END, ':',
                    CASE WHEN k.s = '' THEN '0' ELSE k.s END) AS timestamp_ntz)
    - make_dt_interval(0, 0, {_OFFSET})"""
_WITH_CLOCK = f"""
    CASE WHEN tail = '' THEN cast(date AS timestamp_ntz)
         WHEN date IS NOT NULL THEN {_let("k", _CLOCK_PARTS, _STAMP)} END"""

_DAY = "substr(text, 1, length(text) - length(tail))"
_FROM_TEXT = _let(
    "tail",
    f"regexp_extract(text, r'{_CLOCK}', 0)",
    _let("date", _let("ymd", _let("day", _DAY, _YEAR_MONTH_DAY), _DATE), _WITH_CLOCK),
)


# Shapes of digits and separators only, those with separators with years far from the limits, each with
# the rule that reads it; ``c`` is the trimmed cell. They are most of what tables hold, and as their rules bind nothing,
# they stay in generated code.
_NEAR_YEAR = r"(?:1[7-9]|2[01])\d\d"
_PLAIN_YEAR_FIRST = rf"^{_NEAR_YEAR}[-/.]\d{{1,2}}[-/.]\d{{1,2}}\z"
_PLAIN_YEAR_LAST = rf"^\d{{1,2}}[-/.]\d{{1,2}}[-/.]{_NEAR_YEAR}\z"
_PLAIN_STAMP = rf"^{_NEAR_YEAR}[-/.]\d{{1,2}}[-/.]\d{{1,2}} \d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?\z"
_PLAIN_DIGITS = r"^(?:\d{4}|\d{6}|\d{8})\z"
# Numbers that are no date: all but years, digits with a month and a day in them, stamps, and a year and a
# month with a dot. They start like a date, so without this look each would go through all the rules.
_TWO_MONTH, _TWO_DAY, _FOUR_YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:1[6-9]|2[0-2])\d\d"
_NO_DATE = (
    rf"^(?!(?:{_FOUR_YEAR}(?:{_TWO_MONTH}{_TWO_DAY})?|{_TWO_DAY}{_TWO_DAY}\d\d"
    rf"|(?:3[2-9]|[4-9]\d){_TWO_MONTH}{_TWO_DAY}|\d{{12}}(?:\d\d)?|\d{{4}}\.\d{{1,2}}|\d{{1,2}}\.\d{{4}})\z)"
    r"[0-9,]*+\.?[0-9,]*+\z"
)


def _century(year: str) -> str:
    return f"CASE WHEN {year} >= '69' THEN '19' ELSE '20' END"


def _digits_rule(c: str) -> str:
    """Date of four (a year), six (month, day, year, or year first) or eight digits (year first)."""

    def date(*parts: str) -> str:
        return f"try_cast(concat_ws('-', {', '.join(parts)}) AS date)"

    first, second, third = (f"substr({c}, {k}, 2)" for k in (1, 3, 5))
    front, back = (f"concat({_century(y)}, {y})" for y in (first, third))
    return f"""
        try_cast(CASE length({c})
            WHEN 8 THEN CASE WHEN {c} BETWEEN '16770922' AND '22620411'
                             THEN {date(f"substr({c}, 1, 4)", f"substr({c}, 5, 2)", f"substr({c}, 7, 2)")} END
            WHEN 6 THEN CASE WHEN {first} >= '32' THEN {date(front, second, third)}
                             ELSE coalesce({date(back, first, second)}, {date(back, second, first)}) END
            ELSE CASE WHEN {c} BETWEEN '1678' AND '2262' THEN try_cast({c} AS date) END
        END AS timestamp_ntz)"""


def _plain_rules(c: str, bare_digits: bool) -> list[tuple[str, str]]:
    dashed = f"translate({c}, '/.', '--')"
    year, first, second = (f"split_part({dashed}, '-', {k})" for k in (3, 1, 2))
    rules = [
        (f"{c} RLIKE r'{_NO_DATE}' OR NOT {c} RLIKE '[0-9]'", "NULL"),
        (f"{c} RLIKE r'{_PLAIN_DIGITS}'", _digits_rule(c) if bare_digits else "NULL"),
        (f"{c} RLIKE r'{_PLAIN_YEAR_FIRST}'", f"try_cast(try_cast({dashed} AS date) AS timestamp_ntz)"),
        (
            f"{c} RLIKE r'{_PLAIN_YEAR_LAST}'",
            f"""try_cast(coalesce(try_cast(concat({year}, '-', {first}, '-', {second}) AS date),
                          try_cast(concat({year}, '-', {second}, '-', {first}) AS date)) AS timestamp_ntz)""",
        ),
        (
            f"{c} RLIKE r'{_PLAIN_STAMP}'",
            f"try_cast(concat(translate(split_part({c}, ' ', 1), '/.', '--'), ' ', split_part({c}, ' ', 2)) AS timestamp_ntz)",
        ),
    ]
    return rules


def parse_datetime(column: str, *, bare_digits: bool = True, plain_shapes: bool = True) -> Column:
    """Timestamp (no zone) read from a text column in any of the accepted shapes, else NULL.

    Numeric dates are read month first, day first where the month would exceed 12. An
    offset is applied, so results are UTC. ``bare_digits=False`` refuses digits only
    (``2024``, ``20240105``, ``20240105103000``). ``plain_shapes=False`` sends shapes of digits and
    separators the way of all others, with the same results.
    """
    mixed = "" if bare_digits else r"AND NOT c RLIKE r'^\d+(?:[tT]\d+)?$'"
    # One cheap look settles most cells: an accepted cell starts like a date.
    candidate = f"""
        CASE WHEN c RLIKE r'[0-9]' {mixed}
                  AND lower(c) RLIKE r'{_DATE_START}' THEN lower(c) END"""
    parsed = _let(
        "t",
        _let("c", f"trim({quoted_name(column)})", candidate),
        f"""
        CASE WHEN t RLIKE r'{_ISO}' THEN try_cast(upper(t) AS timestamp_ntz)
             WHEN t IS NOT NULL THEN {_let("text", _SPACED, _FROM_TEXT)} END""",
    )
    in_range = f"""
        CASE WHEN stamp BETWEEN timestamp_ntz'{EARLIEST}' AND timestamp_ntz'{LATEST}'
             THEN stamp END"""
    long = _let("stamp", parsed, in_range)
    if not plain_shapes:
        return F.expr(long)
    rules = _plain_rules(f"trim({quoted_name(column)})", bare_digits)
    return F.expr(f"CASE {' '.join(f'WHEN {shape} THEN {rule}' for shape, rule in rules)} ELSE {long} END")


# --------------------------------------------------------------------- numbers

_WORD_CHARACTER = r"[\p{L}\p{N}_]"


def _currency_pattern(ignore_case: bool) -> str:
    codes = "|".join(CURRENCY_CODES)
    flag = "i" if ignore_case else ""
    # Three letters standing alone are looked at closely, anything else is passed over.
    whole_word = rf"(?=[A-Za-z]{{3}}(?!{_WORD_CHARACTER}))(?<!{_WORD_CHARACTER})(?{flag}:{codes})"
    long = sorted((s for s in CURRENCY_SYMBOLS if len(s) > 1), key=len, reverse=True)
    single = "".join(s for s in CURRENCY_SYMBOLS if len(s) == 1)
    marks = "|".join(s.replace("$", r"\$") for s in long)
    return rf"{whole_word}|{marks}|[{single}]"


# A word of four or more letters with one of these letters among its first four is neither
# a code (three letters) nor made of symbols, "e" or "inf": such a cell cannot be a number.
# This keeps the costly patterns away from prose; it never rejects a number.
_ORDINARY_WORD = r"(?i)(?=[a-z]{4})[a-z]{0,3}?[bdghjlmoquvwx]"

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))$"
_INTEGER = r"^[+-]?[0-9]+$"

# Without a digit only an infinity can be meant.
_SOME_NUMBER = r"[0-9]|(?i:inf)"

# Bare as they are. Nothing is bound for them, so they stay in generated code.
_PLAIN_NUMBER = r"^[+-]?[0-9]+\.?[0-9]*\z"


def _bare_number_sql(column: str, ignore_code_case: bool) -> str:
    bare = rf"""
        CASE WHEN plain RLIKE r'{_NUMBER}' THEN plain
             ELSE regexp_replace(regexp_replace(plain, r'\(([0-9.,]+)\)', '-$1'),
                                 r'[,{WHITESPACE}]', '') END"""
    plain = rf"""
        CASE WHEN c RLIKE r'[^-+.,()0-9eE ]'
             THEN regexp_replace(c, r'{_currency_pattern(ignore_code_case)}', '') ELSE c END"""
    cell = f"CASE WHEN NOT c RLIKE r'{_ORDINARY_WORD}' THEN {_let('plain', plain, bare)} END"
    name = quoted_name(column)
    return f"""
        CASE WHEN {name} RLIKE r'{_PLAIN_NUMBER}' THEN {name}
             WHEN {name} RLIKE r'{_SOME_NUMBER}' THEN {_let("c", name, cell)} END"""


def bare_number_text(column: str, *, ignore_code_case: bool = True) -> Column:
    """Text without its currency marks: codes, symbols, commas and blanks go.

    ``(12.5)`` becomes ``-12.5``. Cells that cannot be a number give NULL.
    """
    return F.expr(_bare_number_sql(column, ignore_code_case))


def parse_number(column: str, *, ignore_code_case: bool = True) -> Column:
    """Double read from a text column, NULL where the text is no number."""
    number = f"CASE WHEN b RLIKE r'{_NUMBER}' THEN try_cast(b AS double) END"
    long = _let("b", _bare_number_sql(column, ignore_code_case), number)
    name = quoted_name(column)
    return F.expr(f"""
        CASE WHEN {name} RLIKE r'{_PLAIN_NUMBER}' THEN try_cast({name} AS double)
             WHEN {name} RLIKE r'{_SOME_NUMBER}' THEN {long} END""")


def number_of(bare: Column) -> Column:
    """Double for text in number form, else NULL: ``1d``, ``0x1f`` and ``nan`` are refused."""
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def integer_of(bare: Column) -> Column:
    """64-bit integer for whole-number text in its range, else NULL."""
    return F.when(bare.rlike(_INTEGER), bare.try_cast("bigint"))


def parse_integer(column: str, *, ignore_code_case: bool = True) -> Column:
    """64-bit integer read from a text column, every digit kept."""
    return integer_of(bare_number_text(column, ignore_code_case=ignore_code_case))


def is_integer_text(bare: Column) -> Column:
    return integer_of(bare).isNotNull()


def decimal_of(bare: Column) -> Column:
    """Whole number of up to 38 digits, else NULL."""
    return F.when(bare.rlike(_INTEGER), bare.try_cast("decimal(38,0)"))


def is_whole_text(bare: Column) -> Column:
    """Whole numbers of any length, also those beyond 64 bits."""
    return bare.rlike(_INTEGER)


def may_parse(c: Column) -> Column:
    """False for cells that no parser accepts: a date has a digit, a number too or is infinite."""
    return c.rlike(r"\p{Nd}|(?i:inf)")


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")
