"""Checks of suggested texts: whether they can be pasted, and whether they keep to a style."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import docs
from ..functions._lift import any_of, arrow_function, col

_LINES = "\n"


def _is_string(text: str | None) -> bool:
    """Whether the text is the inside of a documentation string."""
    try:
        ast.parse('"""' + (text or "") + '\n"""')
    except (SyntaxError, ValueError):
        return False
    return True


@arrow_function("boolean")
def parses(text: pd.Series) -> pd.Series:
    return text.map(_is_string)


def indentation_ok(text, step: int = 4, most: int = 12) -> Column:
    """Every line is indented by a multiple of ``step``, at most ``most``."""
    lead = lambda x: F.length(x) - F.length(F.ltrim(x))
    return F.forall(F.split(col(text), _LINES), lambda x: (F.trim(x) == "") | ((lead(x) % step == 0) & (lead(x) <= most)))


def quotes_ok(text) -> Column:
    t = col(text)
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit('"""'), F.lit("")))) / 3) % 2 == 0


def vague(text) -> Column:
    t = F.lower(F.trim(col(text)))
    return (F.length(t) < 50) & any_of(t, docs.VAGUE)


def problems(text, style: str | None = None) -> Column:
    """What keeps a suggestion from being pasted, as an array of names."""
    t = F.coalesce(col(text), F.lit(""))
    found = [
        F.when(F.trim(t) == "", "empty"), F.when(~parses(t), "not a string"), F.when(~indentation_ok(t), "indentation"), F.when(~quotes_ok(t), "quotes"), F.when(vague(t), "vague"),
        *([F.when(F.size(style_problems(t, style)) > 0, "style")] if style else []),
    ]
    return F.array_compact(F.array(*found))


def _line_after(lines: Column, head: str, ok) -> Column:
    """Whether each line that matches head is followed by one (not blank) for which ok holds."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    heads = F.filter(at, lambda a: F.rlike(a["x"], F.lit(head)))
    return F.forall(heads, lambda h: F.coalesce(ok(h["x"], F.get(F.filter(F.slice(lines, h["i"] + 2, F.size(lines) + 1), lambda x: F.trim(x) != ""), F.lit(0))), F.lit(False)))


_TITLE = r"^\s*(Args|Arguments|Returns|Raises|Yields|Example|Examples|Note):\s*$"
_UNDER = r"^\s*(Parameters|Returns|Raises|Yields|Examples|Notes)\s*$"


def style_problems(text, style: str) -> Column:
    """Breaches of a style's formatting, as an array of names."""
    t = F.coalesce(col(text), F.lit(""))
    lines = F.split(t, _LINES)
    lead = lambda x: F.length(x) - F.length(F.ltrim(x))
    if style == "google":
        found = [
            F.when(~_line_after(lines, _TITLE, lambda h, x: lead(x) > lead(h)), "section not indented"),
            F.when(t.rlike(r"(?m)^\s*(args|arguments|returns|raises|yields):\s*$"), "section title in lower case"),
            F.when(t.rlike(docs.NUMPY_UNDERLINED) | t.rlike(r"(?m)^\s*:(param|returns?|raises|type|rtype)\b"), "mixed styles"),
        ]
    elif style == "numpy":
        found = [
            F.when(~_line_after(lines, _UNDER, lambda h, x: F.rlike(x, F.lit(r"^\s*-{3,}\s*$"))), "section without underline"),
            F.when(~_line_after(lines, _UNDER, lambda h, x: F.length(F.trim(x)) == F.length(F.trim(h))), "underline of another length"),
            F.when(t.rlike(r"(?m)^\s*(Args|Arguments):\s*$") | t.rlike(r"(?m)^\s*:(param|returns?|raises|type|rtype)\b"), "mixed styles"),
        ]
    else:
        found = [
            F.when(t.rlike(r"(?m)^\s*:param\s*:") | t.rlike(r"(?m)^\s*:type\s*:"), "field without a name"),
            F.when(t.rlike(r"(?m)^\s*:param\s+\w+\s*$"), "field without a colon"),
            F.when(t.rlike(r"(?m)^\s*(Args|Arguments|Returns|Raises):\s*$") | t.rlike(docs.NUMPY_UNDERLINED), "mixed styles"),
        ]
    return F.array_compact(F.array(*found))
