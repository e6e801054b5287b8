from __future__ import annotations

import pytest

from lexloom.operators import docstrings, parse, suggestions

SOURCE = '''
import os
from . import sibling
from ..top import thing as t

__all__ = ["outer", "K"]


async def outer(a, /, b: int = 1, *args: str, c, d=None, **kw) -> "str | None":
    """Short."""

    def inner():
        yield 1

    for x in a:
        for y in x:
            print(y)
    raise ValueError("no")


class K:
    @property
    def size(self) -> int:
        return self._n[0]

    @classmethod
    def make(cls, n: int = None):
        return cls(n)
'''


def by_name(path="pkg/sub/mod.py", source=SOURCE):
    return {f[4]: f for f in parse.functions_of(path, source)}


def test_functions_parameters_and_methods():
    f = by_name()
    assert set(f) == {"outer", "inner", "size", "make"}
    outer = f["outer"]
    assert [(p["name"], p["type_annotation"], p["default_value"], p["is_required"]) for p in outer[10]] == [
        ("a/", None, None, True), ("b", "int", "1", False), ("*args", "str", None, False), ("c", None, None, True), ("d", None, "None", False), ("**kw", None, None, False),
    ]
    assert outer[6] and outer[11] == "Short." and not outer[7]
    assert f["size"][7] and f["size"][8] == ["property"] and f["make"][8] == ["classmethod"]


def test_broken_file_gives_what_comes_before_the_error():
    f = parse.functions_of("x.py", "def good():\n    return 1\n\n\ndef bad(:\n    pass\n")
    assert [x[4] for x in f] == ["good"] and "line 5" in f[0][12]
    assert parse.functions_of("x.py", "") == [] and parse.functions_of("x.py", ")(") == []


def test_imports_and_exports():
    i = {(x[1], x[2]) for x in parse.imports_of("pkg/sub/mod.py", SOURCE)}
    assert i == {("standard", "os"), ("relative", "pkg.sub"), ("relative", "pkg.top")}
    assert parse.exports_of("pkg/sub/mod.py", SOURCE)[0][1] == ["K", "outer"]
    assert parse.exports_of("m.py", "def a(): pass\ndef _b(): pass\nclass C: pass")[0][1] == ["C", "a"]


def test_exceptions_keep_the_surest_of_each_type():
    e = parse.exceptions_of("    def f(x):\n        int(x)\n        x[0]\n        if x:\n            raise ValueError()\n        raise\n")
    assert [(x["exception_type"], x["confidence"]) for x in e] == [("ValueError", 0.95), ("Exception", 0.8), ("IndexError", 0.4), ("KeyError", 0.4)]


def test_behaviour_and_returns():
    found = {b["pattern"] for b in parse.behaviour_of(by_name()["outer"][9])}
    assert {"iteration", "nested_iteration", "output", "generator"} <= found
    r = parse.returns_of("def f(x):\n    if x:\n        return 1\n    return\n")
    assert r == {"return_types": ["None", "int"], "yield_types": [], "is_generator": False}


GOOGLE = """Fetch rows.

    More about it.

    Args:
        url (str): Where
            from.
        limit (int, optional): How many. Defaults to 10.
        **kw: Others.

    Returns:
        list[str]: The rows.

    Raises:
        ValueError: If it is bad.

    Example:
        >>> fetch("x")
    """
NUMPY = """Fetch rows.

Parameters
----------
url : str
    Where from.
limit : int, optional
    How many. Defaults to 10.

Returns
-------
list[str]
    The rows.

Raises
------
ValueError
    If it is bad.
"""
SPHINX = """Fetch rows.

:param url: Where from.
:type url: str
:param int limit: How many. Defaults to 10.
:returns: The rows.
:rtype: list[str]
:raises ValueError: If it is bad.
"""


@pytest.mark.parametrize(("text", "style"), [(GOOGLE, "google"), (NUMPY, "numpy"), (SPHINX, "sphinx")])
def test_docstring_styles(text, style):
    d = docstrings.parse(text)
    assert d["format"] == style and d["summary"] == "Fetch rows."
    assert [(p["name"], p["type_str"], p["default_value"]) for p in d["parameters"][:2]] == [("url", "str", None), ("limit", "int", "10")]
    assert d["returns"] == {"type_str": "list[str]", "description": "The rows."}
    assert d["raises"] == [{"exception_type": "ValueError", "description": "If it is bad."}]


@pytest.mark.parametrize("style", ["google", "numpy", "sphinx", "rest"])
@pytest.mark.parametrize("text", [GOOGLE, NUMPY, SPHINX])
def test_rendered_documentation_reads_back(style, text):
    d = docstrings.parse(text)
    again = docstrings.parse(docstrings.render(d, style))
    key = lambda x: ([(p["name"], p["type_str"]) for p in x["parameters"]], x["returns"], x["raises"], x["summary"])
    assert key(again) == key(d)


def test_no_documentation_and_odd_ones():
    assert docstrings.parse(None) is None and docstrings.parse("  \n ") is None
    assert docstrings.parse("Args:\n    not a parameter\n")["parse_errors"]


def test_repair_keeps_what_was_said_and_renames():
    params = [{"name": "label", "type_annotation": "str", "is_required": True, "default_value": None}, {"name": "n", "type_annotation": "int", "is_required": False, "default_value": "1"}]
    d = suggestions.repaired("f", params, "int", [{"exception_type": "KeyError", "description": "x", "confidence": 0.95}], "Do.\n\nArgs:\n    labels (str): The words on it.\n")
    assert [(p["name"], p["description"]) for p in d["parameters"]] == [("label", "The words on it."), ("n", "The n.")]
    assert d["returns"]["type_str"] == "int" and d["raises"][0]["exception_type"] == "KeyError"


def test_merge_by_confidence():
    old, new = docstrings.parse(GOOGLE), docstrings.parse(NUMPY) | {"examples": []}
    assert docstrings.merge(None, new, 0.1) is new
    assert docstrings.merge(old, new, 0.4) == old
    assert docstrings.merge(old, new | {"raises": []}, 0.9)["raises"] == old["raises"]


def test_statements_and_nodes_come_as_the_tree_has_them():
    import ast

    from lexloom.operators import parse

    source = "import a\nclass A:\n    @d(x)\n    def f(self, y=lambda: 1):\n        try:\n            import b\n        except E:\n            def g(): pass\n        else:\n            from c import z\n        finally:\n            class B: pass\n    if q:\n        def h(): return [i for i in y if i.w]\nmatch v:\n    case [1, k] if k:\n        def m(): pass\nwith o as t:\n    async def n(): await t\n"
    tree = ast.parse(source)
    all_ = list(ast.walk(tree))
    assert [n for n, _ in parse.statements(tree) if isinstance(n, ast.stmt)] == [n for n in all_ if isinstance(n, ast.stmt)]
    assert [n.name for n, inside in parse.statements(tree) if inside and isinstance(n, ast.FunctionDef)] == ["f"]
    assert parse.walk(tree) == [n for n in all_ if not isinstance(n, ast.expr_context)]
    assert [r[4] for r in parse.functions_of("a.py", source)] == [n.name for n in all_ if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    # Most of a tree is not visited for its statements.
    assert len(parse.statements(tree)) < len(all_) / 2
