"""Documentation text -> structure, and back in another style."""

from __future__ import annotations

import re
import textwrap

import pandas as pd

from ..functions._lift import arrow_function

DOC = """format string, summary string, description string, parameters array<struct<name:string, type_str:string, description:string, is_optional:boolean, default_value:string>>,
 returns struct<type_str:string, description:string>, raises array<struct<exception_type:string, description:string>>, examples array<string>, is_valid boolean, parse_errors array<string>"""
# Section titles of the styles and what they hold.
SECTIONS = {"args": "parameters", "arguments": "parameters", "parameters": "parameters", "params": "parameters", "returns": "returns", "return": "returns", "yields": "returns", "raises": "raises", "raise": "raises", "example": "examples", "examples": "examples", "note": "other", "notes": "other", "see also": "other", "references": "other", "warnings": "other", "attributes": "other"}
_DEFAULT = re.compile(r"[Dd]efaults?(?:\s+(?:is|to|value:?)|:|=)\s*`?('[^']*'|\"[^\"]*\"|[^\s`,;]+?)`?[.,;]?(?:\s|$)")


def detect(text: str) -> str:
    if any(m in text for m in (":param", ":type", ":returns:", ":rtype:", ":raises:")):
        return "rest" if ":Example:" in text or ".. code-block::" in text else "sphinx"
    lines = [x.strip() for x in text.strip().split("\n")]
    if any(a in ("Parameters", "Returns", "Raises", "Examples", "Notes") and b and set(b) == {"-"} for a, b in zip(lines, lines[1:], strict=False)):
        return "numpy"
    return "google"


def _parameter(name: str, kind: str | None, text: str) -> dict:
    kind = (kind or "").strip()
    optional = bool(re.search(r"\boptional\b", kind)) or kind.startswith("Optional[")
    kind = re.sub(r",?\s*\boptional\b", "", kind)
    found = re.search(r",?\s*default:?\s*=?\s*(\S+)$", kind)
    kind = kind[: found.start()] if found else kind
    default = found[1] if found else (m[1] if (m := _DEFAULT.search(text)) else None)
    return {"name": name, "type_str": kind.strip(" ,") or None, "description": text, "is_optional": optional or default is not None, "default_value": default}


def _entries(lines: list[str]) -> list[tuple[str, str]]:
    """Head lines at the least indentation, each with its deeper lines joined."""
    body = textwrap.dedent("\n".join(lines)).split("\n")
    out: list[list[str]] = []
    for line in body:
        if line.strip() and not line[0].isspace():
            out.append([line.strip(), ""])
        elif line.strip() and out:
            out[-1][1] = f"{out[-1][1]} {line.strip()}".strip()
    return [(a, b) for a, b in out]


def _sections(text: str, numpy: bool) -> tuple[list[str], list[tuple[str, list[str]]]]:
    lines = text.split("\n")
    front: list[str] = []
    found: list[tuple[str, list[str]]] = []
    i = 0
    while i < len(lines):
        title = lines[i].strip()
        under = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if numpy and title.lower() in SECTIONS and under and set(under) == {"-"}:
            found.append((SECTIONS[title.lower()], []))
            i += 2
            continue
        m = None if numpy else re.fullmatch(r"([A-Z][A-Za-z ]*):", title)
        if m and m[1].lower() in SECTIONS:
            found.append((SECTIONS[m[1].lower()], []))
        else:
            (found[-1][1] if found else front).append(lines[i])
        i += 1
    return front, found


def parse(raw: str | None) -> dict | None:
    """A documentation text as a record of DOC; None if there is none."""
    if raw is None or not raw.strip():
        return None
    text = textwrap.dedent(raw).strip("\n")
    style = detect(text)
    out = {"format": style, "summary": "", "description": None, "parameters": [], "returns": None, "raises": [], "examples": [], "is_valid": True, "parse_errors": []}
    if style in ("sphinx", "rest"):
        front = _fields(text, out)
    else:
        front, sections = _sections(text, style == "numpy")
        for what, lines in sections:
            _section(what, lines, style, out)
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", "\n".join(front).strip())]
    out["summary"] = paragraphs[0] if paragraphs else ""
    out["description"] = "\n\n".join(paragraphs[1:]) or None
    return out


def _section(what: str, lines: list[str], style: str, out: dict) -> None:
    if what == "examples":
        if example := textwrap.dedent("\n".join(lines)).strip():
            out["examples"].append(example)
        return
    for head, more in _entries(lines):
        if what == "parameters":
            m = re.match(r"(\*{0,2}\w+)\s*(?:\(([^)]*(?:\([^)]*\))?[^)]*)\))?\s*:\s*(.*)", head) if style == "google" else re.match(r"(\*{0,2}\w+(?:\s*,\s*\*{0,2}\w+)*)(?:\s*:\s*(.*))?$", head)
            if not m:
                out["parse_errors"].append(f"parameter: {head[:60]}")
            elif style == "google":
                out["parameters"].append(_parameter(m[1], m[2], f"{m[3]} {more}".strip()))
            else:
                out["parameters"] += [_parameter(n.strip(), m[2], more) for n in m[1].split(",")]
        elif what == "raises":
            name, _, rest = head.partition(":")
            if re.fullmatch(r"[\w.]+", name.strip()):
                out["raises"].append({"exception_type": name.strip(), "description": f"{rest.strip()} {more}".strip()})
            else:
                out["parse_errors"].append(f"raises: {head[:60]}")
        elif what == "returns" and out["returns"] is None:
            m = re.match(r"([\w.\[\], |]+?)\s*:\s+(.*)|([\w.\[\], |]+):$", f"{head}" if style == "google" else "")
            if style == "numpy":
                name, sep, kind = head.partition(" : ")
                out["returns"] = {"type_str": (kind if sep else name).strip() or None, "description": more}
            elif m:
                out["returns"] = {"type_str": (m[1] or m[3]).strip(), "description": f"{m[2] or ''} {more}".strip()}
            else:
                out["returns"] = {"type_str": None, "description": f"{head} {more}".strip()}


def _fields(text: str, out: dict) -> list[str]:
    """``:field arg: text`` lists; returns the lines before the first."""
    front: list[str] = []
    fields: list[list[str]] = []
    example: list[str] | None = None
    open_ = False
    for line in text.split("\n"):
        m = re.match(r"\s*:(\w+)(?:\s+([^:]+))?:\s*(.*)", line)
        if re.match(r"\s*(?:\.\. code-block::|:Example:)", line):
            example, open_ = [], False
        elif m:
            fields.append([m[1], (m[2] or "").strip(), m[3].strip()])
            open_ = True
        elif example is not None:
            example.append(line)
        elif open_ and line.strip():
            fields[-1][2] = f"{fields[-1][2]} {line.strip()}".strip()
        elif not fields:
            front.append(line)
        else:
            open_ = False
    if example and (code := textwrap.dedent("\n".join(example)).strip()):
        out["examples"].append(code)
    types = {arg: t for f, arg, t in fields if f == "type"}
    kind = next((t for f, _, t in fields if f == "rtype"), None)
    for f, arg, t in fields:
        if f == "param":
            *before, name = arg.split() or [""]
            if re.fullmatch(r"\*{0,2}\w+", name):
                out["parameters"].append(_parameter(name, " ".join(before) or types.get(name), t))
            else:
                out["parse_errors"].append(f"parameter: {arg[:60]}")
        elif f in ("raises", "raise"):
            out["raises"].append({"exception_type": arg, "description": t})
        elif f in ("returns", "return"):
            out["returns"] = {"type_str": kind, "description": t}
    if kind and out["returns"] is None:
        out["returns"] = {"type_str": kind, "description": ""}
    return front


@arrow_function(DOC, once=True)
def parsed(raw: pd.Series) -> pd.DataFrame:
    """Column function: a text -> struct (all null without a text)."""
    names = ["format", "summary", "description", "parameters", "returns", "raises", "examples", "is_valid", "parse_errors"]
    return pd.DataFrame([parse(r) or dict.fromkeys(names) for r in raw], columns=names)


def render(doc: dict, style: str, width: int = 88) -> str:
    """A parsed documentation as text in a style. Long lines wrap and keep their indent."""
    out = [doc["summary"] or ""]
    if doc.get("description"):
        out += ["", *(w for p in doc["description"].split("\n\n") for w in [*textwrap.wrap(p, width), ""])][:-1]
    params = list(doc.get("parameters") if doc.get("parameters") is not None else [])
    raises = list(doc.get("raises") if doc.get("raises") is not None else [])
    examples = list(doc.get("examples") if doc.get("examples") is not None else [])
    ret = doc.get("returns")
    wrap = lambda head, text, pad: textwrap.wrap(f"{head}{text or ''}".rstrip(), width, initial_indent=" " * pad, subsequent_indent=" " * (pad + 4)) or [" " * pad + head]
    if style == "google":
        opt = lambda p: ", optional" if p["is_optional"] else ""
        if params:
            out += ["", "Args:", *(x for p in params for x in wrap(f"{p['name']} ({p['type_str']}{opt(p)}): " if p["type_str"] else f"{p['name']}: ", p["description"], 4))]
        if ret:
            out += ["", "Returns:", *wrap(f"{ret['type_str']}: " if ret["type_str"] else "", ret["description"], 4)]
        if raises:
            out += ["", "Raises:", *(x for r in raises for x in wrap(f"{r['exception_type']}: ", r["description"], 4))]
        if examples:
            out += ["", "Example:", *textwrap.indent("\n".join(examples), "    ").split("\n")]
    elif style == "numpy":
        section = lambda t: ["", t, "-" * len(t)]
        if params:
            out += section("Parameters")
            for p in params:
                out += [f"{p['name']} : {p['type_str']}{', optional' if p['is_optional'] else ''}" if p["type_str"] else p["name"], *wrap("", p["description"], 4)]
        if ret:
            out += [*section("Returns"), ret["type_str"] or "object", *wrap("", ret["description"], 4)]
        if raises:
            out += [*section("Raises"), *(x for r in raises for x in [r["exception_type"], *wrap("", r["description"], 4)])]
        if examples:
            out += [*section("Examples"), *"\n".join(examples).split("\n")]
    else:
        fields = []
        for p in params:
            fields += wrap(f":param {p['name']}: ", p["description"], 0)
            fields += [f":type {p['name']}: {p['type_str']}"] if p["type_str"] else []
        if ret:
            fields += wrap(":returns: ", ret["description"], 0)
            fields += [f":rtype: {ret['type_str']}"] if ret["type_str"] else []
        for r in raises:
            fields += wrap(f":raises {r['exception_type']}: ", r["description"], 0)
        out += ["", *fields] if fields else []
        if examples:
            out += ["", ".. code-block:: python" if style == "rest" else ":Example:", "", *textwrap.indent("\n".join(examples), "    ").split("\n")]
    return "\n".join(x.rstrip() for x in out).strip()


def converter(style: str, width: int = 88):
    """Column function: a documentation text in any style -> the same in this one."""

    @arrow_function("string")
    def convert(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: render(d, style, width) if (d := parse(r)) else r)

    return convert


def boundaries(text: str) -> list[tuple[str, int, int]]:
    """(title, first line, line after the last) of each section, its title line included; what
    is before the first is ``front``. Sections of unknown titles count too: a title is a word
    with a colon alone on its line, or one that is underlined."""
    lines = text.split("\n")
    heads = []
    for i, x in enumerate(lines):
        m = re.fullmatch(r"([A-Z][A-Za-z ]*):", x.strip())
        under = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if m and not (i and lines[i - 1].strip().endswith(",")):
            heads.append((i, m[1].lower()))
        elif x.strip() and len(under) >= 3 and set(under) == {"-"}:
            heads.append((i, x.strip().lower()))
    starts = [(0, "front"), *heads]
    return [(t, a, b) for (a, t), b in zip(starts, [*(i for i, _ in heads), len(lines)], strict=True) if b > a]


# The order of sections.
ORDER = ("front", "args", "arguments", "parameters", "returns", "yields", "raises", "example", "examples", "note", "notes")


def put_section(text: str, section: str) -> str:
    """text with a section replaced by one of the same kind, or put where the order of
    sections has it; all others, also ones of unknown titles, stay as they are."""
    new = section.strip("\n").split("\n")
    kind = boundaries("\n" + "\n".join(new))[-1][0]
    lines, parts = text.split("\n"), boundaries(text)
    kinds = lambda t: SECTIONS.get(t, t)
    for t, a, b in parts:
        if t != "front" and kinds(t) == kinds(kind) and (kinds(t) != "other" or t == kind):
            tail = [""] if b < len(lines) else []
            return "\n".join([*lines[:a], *new, *tail, *lines[b:]])
    place = lambda t: ORDER.index(t) if t in ORDER else len(ORDER)
    # After the last section that comes before this kind; sections of unknown titles hold no place.
    at = max([b for t, _, b in parts if t in ORDER and place(t) <= place(kind)], default=0)
    before = lines[:at]
    while before and not before[-1].strip():
        before.pop()
    return "\n".join([*before, "", *new, *(["", *lines[at:]] if at < len(lines) else [])])


@arrow_function("string")
def with_section(text: pd.Series, section: pd.Series) -> pd.Series:
    return pd.Series([put_section(t, s) if t and s else t or s for t, s in zip(text, section, strict=True)])


def merge(old: dict | None, new: dict, confidence: float) -> dict:
    """Section by section: from 0.8 on the new one, from 0.5 on the new one where the old is
    missing, else the old. Descriptions of parameters that stay are kept unless generic."""
    if old is None:
        return new
    out = dict(old)
    for k in ("parameters", "returns", "raises", "examples"):
        if new.get(k) and (confidence >= 0.8 or confidence >= 0.5 and not old.get(k)):
            out[k] = new[k]
    if confidence >= 0.8 and old.get("parameters") and new.get("parameters"):
        told = {p["name"]: p["description"] for p in old["parameters"]}
        out["parameters"] = [p | {"description": told[p["name"]] if p["name"] in told and not generic(told[p["name"]]) else p["description"]} for p in new["parameters"]]
    return out


def generic(text: str | None) -> bool:
    t = (text or "").lower().strip(" .")
    return len(t) < 5 or t in ("todo", "description", "the parameter", "parameter", "value", "the value") or t.startswith(("todo", "[todo", "description of", "description for"))
