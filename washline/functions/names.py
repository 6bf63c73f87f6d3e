"""Column-name rules. Pure functions over the (small) list of names."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: object) -> str:
    """Lower-case ASCII words joined by single underscores; anything else separates."""
    text = "" if name is None else str(name)
    return re.sub(r"[^0-9a-z]+", "_", text.strip().lower()).strip("_")


def unique_names(
    names: Iterable[str],
    *,
    joiner: str = "_",
    fold: Callable[[str], str] = lambda name: name,
) -> list[str]:
    """Keep the first use of a name; number the repeats with the first free suffix."""
    taken: set[str] = set()
    result: list[str] = []
    for name in names:
        options = itertools.chain([name], (f"{name}{joiner}{k}" for k in itertools.count(1)))
        chosen = next(o for o in options if fold(o) not in taken)
        taken.add(fold(chosen))
        result.append(chosen)
    return result


def quoted_name(name: str) -> str:
    """A column name in backticks, for SQL text; it may hold dots, blanks or backticks."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """Reference a column whatever its name holds."""
    return F.col(quoted_name(name))
