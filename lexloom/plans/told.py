"""Answers told by hand, as SQL: for each kind of made file, with the keys of the part table."""

from __future__ import annotations


def literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else str(x)


def told(columns: str, rows: list[tuple]) -> str:
    """SQL of rows (kind, values ...) for every part of that kind; {k}, {p} and {n} in text
    are the part's key, the one before and the next."""
    cols = columns.split()
    texts = {c for i, c in enumerate(cols, 1) if any(isinstance(r[i], str) for r in rows)}
    fill = lambda c: f"replace(replace(replace({c}, '{{k}}', p_partkey::varchar), '{{p}}', (p_partkey - 1)::varchar), '{{n}}', (p_partkey + 1)::varchar) as {c}"
    values = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return f"select {', '.join(fill(c) if c in texts else c for c in cols)} from part join (values {values}) as t(_shape, {', '.join(cols)}) on p_partkey % 10 = _shape"
