"""Strings of well-log files. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at a string's ends and between fields: Unicode's, and the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: Column | str) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(_col(x), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def fields(x: Column | str) -> Column:
    """The fields of a line that white space separates."""
    return F.split(trim_ws(x), rf"(?U){_SPACE}+")


def stem_first(name: Column | str) -> Column:
    """What stands before the first dot."""
    return F.substring_index(_col(name), ".", 1)


def stem_last(name: Column | str) -> Column:
    """The name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(_col(name), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def without(name: Column | str, part: str) -> Column:
    """The name without every occurrence of part: a well from `well_traces.csv`."""
    return F.replace(_col(name), F.lit(part), F.lit(""))


def has_suffix(name: Column | str, suffix: str, any_case: bool = False) -> Column:
    x = _col(name)
    return F.endswith(F.lower(x), F.lit(suffix.lower())) if any_case else F.endswith(x, F.lit(suffix))


def first_number(line: Column | str, signed: bool = False) -> Column:
    """The first number in a line, as a double; null without one.

    Only numbers with a decimal point keep their sign, unless signed is set: `-5` is 5 and `-5.5` is -5.5. Exponents are
    not read.
    """
    pattern = r"[-+]?\d*\.\d+|[-+]?\d+" if signed else r"[-+]?\d*\.\d+|\d+"
    found = F.regexp_extract(_col(line), pattern, 0)
    return F.when(found != "", found.cast("double"))


def parse_double(x: Column | str) -> Column:
    """A finite double, or null where x is none; type letters as in `1.0d` are none."""
    text = trim_ws(x)
    value = F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)
