"""Text expressions. All stay in the JVM except NFKC, which Spark has no function for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Cells that stand for "missing" inside text columns.
NULL_TOKENS = ("nan", "none", "null")

# The characters Unicode (and Python's str.isspace) count as white space.
WHITESPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A lone plain space needs no rewriting, so the pattern does not match it: ordinary prose
# goes through without a single replacement.
_UNTIDY_SPACE = rf"[{WHITESPACE}&&[^ ]][{WHITESPACE}]*| [{WHITESPACE}]+"

_NON_ASCII = r"[^\x00-\x7F]"

# Of the cells of a batch, which are Arrow bytes, about this many at a time are Python's text.
_PIECE_BYTES = 1024 * 1024


def _nfkc(c: Column) -> Column:
    piece_bytes = _PIECE_BYTES

    # Defined inside, so tasks get the function itself and need not import this package. Functions of
    # iterators would yield the pieces, but take a Python process for each column.
    @arrow_udf(StringType())
    def normalized(cells: pa.Array) -> pa.Array:
        from unicodedata import normalize

        rows = max(1, len(cells) * piece_bytes // max(1, cells.nbytes))
        pieces = [
            pa.array([t and normalize("NFKC", t) for t in cells.slice(i, rows).to_pylist()], pa.string())
            for i in range(0, len(cells), rows)
        ]
        return pa.concat_arrays(pieces) if pieces else cells

    return normalized(c)


def null_tokens(c: Column) -> Column:
    """NULL for cells that are exactly a null token."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def tidy_space(c: Column) -> Column:
    """Strip both ends and turn every inner run of white space into one plain space."""
    even = F.when(c.rlike(_UNTIDY_SPACE), F.regexp_replace(c, _UNTIDY_SPACE, " ")).otherwise(c)
    return F.trim(even)


def without_null_tokens(c: Column, after_strip: bool) -> Column:
    """Not NULL exactly where the cleaned cell is not missing."""
    return null_tokens(tidy_space(c)) if after_strip else null_tokens(c)


def has_non_ascii(c: Column) -> Column:
    return c.rlike(_NON_ASCII)


def nfkc(c: Column) -> Column:
    """Unicode NFKC. ASCII cells are already normal and never leave the JVM."""
    return F.coalesce(_nfkc(F.when(has_non_ascii(c), c)), c)


def tidy_text(c: Column, *, tokens_after_strip: bool = False) -> Column:
    """Null tokens become NULL and white space becomes tidy, in this order by default."""
    return null_tokens(tidy_space(c)) if tokens_after_strip else tidy_space(null_tokens(c))
