"""JSON inside free text, and findings recovered from text that isn't JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import arrow_function, col, lookup

#: A finding as a model reports it.
FINDING = "issues array<struct<type:string, description:string, suggestion:string, confidence:double, line_number:int>>, analysis_notes string, confidence double"
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


@arrow_function("string")
def braced(text: pd.Series) -> pd.Series:
    """The first balanced {...} that parses and has issues; strings are not looked into."""

    def find(t: str | None) -> str | None:
        for start in [i for i, c in enumerate(t or "") if c == "{"]:
            depth, quoted, escaped = 0, False, False
            for i in range(start, len(t)):
                c = t[i]
                if quoted:
                    escaped = c == "\\" and not escaped
                    quoted = c != '"' or (escaped if c == "\\" else t[i - 1] == "\\")
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        part = t[start : i + 1]
                        try:
                            if "issues" in json.loads(part):
                                return part
                        except ValueError:
                            pass
                        break
        return None

    return text.map(find)


def extract(text) -> Column:
    """The JSON document of a reply: all of it, a fenced block, or a braced part; else null."""
    t = col(text)
    whole = F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), t)
    fenced = F.regexp_extract(t, FENCE, 1)
    return F.coalesce(whole, F.when((fenced != "") & F.try_parse_json(fenced).isNotNull(), fenced), braced(t))


def findings(document) -> Column:
    return F.from_json(col(document), FINDING)


def valid_finding(x: Column) -> Column:
    return x["type"].isNotNull() & (F.trim(F.coalesce(x["description"], F.lit(""))) != "") & (F.trim(F.coalesce(x["suggestion"], F.lit(""))) != "") & F.coalesce(x["confidence"].between(0.0, 1.0), F.lit(False)) & F.coalesce(x["line_number"] >= 1, F.lit(True))


# What a model calls an issue, and what it is here.
REPLY_TYPES = {"behavior_mismatch": "description_outdated", "missing_edge_case": "description_outdated", "example_error": "example_invalid", "missing_exception": "missing_raises", "type_mismatch": "parameter_type_mismatch", "version_mismatch": "description_outdated"}


def issue_type(reported) -> Column:
    return F.coalesce(lookup(col(reported), REPLY_TYPES), F.lit("description_outdated"))


def recovered(text) -> Column:
    """Sentences of unparseable text that speak of a problem, with confidence 0.3, cut at 200."""
    lines = F.regexp_extract_all(col(text), F.lit(r"(?im)^.*?(?:issue|problem|error|mismatch|missing|incorrect)\b.*$"), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.left(F.trim(x), F.lit(200)).alias("description"), F.lit(0.3).alias("confidence")))
