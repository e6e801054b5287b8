"""Documentation text: formats, styles, completeness, actionability, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import any_of, clip, col

# Markers of the documentation formats.
SPHINX_MARKERS = (":param", ":type", ":returns:", ":rtype:", ":raises:")
REST_MARKERS = (":Example:", ".. code-block::")
NUMPY_UNDERLINED = r"(?m)^[ \t]*(?:Parameters|Returns|Raises|Examples|Notes)[ \t]*\n[ \t]*-+[ \t]*$"


def format_of(text) -> Column:
    """sphinx, rest, numpy or google (also the default), by explicit markers first."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(any_of(t, SPHINX_MARKERS), F.when(any_of(t, REST_MARKERS), "rest").otherwise("sphinx")).when(t.rlike(NUMPY_UNDERLINED), "numpy").otherwise("google")


# For each style the patterns that count two, a half, and minus one and a half; and its weight.
STYLE_SIGNS = {
    "google": ((r"Args?:", r"Returns?:", r"Raises?:"), (r"Yields?:", r"Note:", r"Example:"), (r"Parameters\s*\n\s*-{3,}", r":param\s+\w+:", r"^\s*\.\.\s+"), 1.0),
    "numpy": ((r"Parameters\s*\n\s*-{3,}", r"Returns\s*\n\s*-{3,}"), (r"Yields\s*\n\s*-{3,}", r"Raises\s*\n\s*-{3,}", r"Notes\s*\n\s*-{3,}", r"Examples\s*\n\s*-{3,}"), (r"Args?:", r":param\s+\w+:", r"^\s*\.\.\s+"), 1.0),
    "sphinx": ((r":param\s+\w+:", r":returns?:", r":rtype:"), (r":type\s+\w+:", r":raises?\s+\w+:", r":yields?:"), (r"Args?:", r"Parameters\s*\n\s*-{3,}", r"^\s*\.\.\s+"), 1.0),
    "rest": ((r"^\s*\.\.\s+", r"^\s*\*\s+", r"^\s*\d+\.\s+"), (r"^\s*::\s*$", r"^\s*\.\.\s+note::", r"^\s*\.\.\s+warning::"), (r"Args?:", r"Parameters\s*\n\s*-{3,}", r":param\s+\w+:"), 0.8),
}


def style_score(text, style: str) -> Column:
    """How well a text fits a style, 0 to 1."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    required, optional, forbidden, weight = STYLE_SIGNS[style]
    hits = lambda ps: sum((t.rlike(f"(?im){p}").cast("int") for p in ps), F.lit(0))
    return clip((hits(required) * 2.0 + hits(optional) * 0.5 - hits(forbidden) * 1.5) * weight / 5.0)


def best_style(text, least: float = 0.3) -> Column:
    """struct(style, score) of the best style, the first on a tie; google below ``least``."""
    scores = F.array(*(F.struct(style_score(text, s).alias("score"), F.lit(-i).alias("order"), F.lit(s).alias("style")) for i, s in enumerate(STYLE_SIGNS)))
    top = F.array_max(scores)
    return F.struct(F.when(top["score"] >= least, top["style"]).otherwise("google").alias("style"), top["score"].alias("score"))


def completeness(text) -> Column:
    """How complete a suggested documentation text is, 0 to 1."""
    t = F.coalesce(col(text), F.lit(""))
    low = F.lower(t)
    has = lambda w, *ps: F.when(any_of(low, ps), w).otherwise(0.0)
    example = F.when(any_of(low, ("example:",)) | F.contains(t, F.lit(">>>")), 0.15).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        F.when(F.trim(t) != "", 0.2).otherwise(0.0) + has(0.2, "args:", "arguments:") + has(0.2, "returns:", "return:") + has(0.1, "raises:", "raise:") + example + F.when(F.length(t) > 100, 0.15).otherwise(0.0),
    )


# Phrases without content, and words that name an action.
VAGUE = ("fix this", "review this", "check this", "update this", "improve this", "clarify this", "consider this", "think about", "look at", "make sure", "be careful", "pay attention")
ACTIONS = ("add", "remove", "change", "replace", "specify", "include", "document", "mention", "note that", "explain", "describe", "list", "provide example", "use", "implement")


def actionable(text) -> Column:
    """Long enough, names an action, and isn't a short vague phrase."""
    s = F.trim(F.lower(F.coalesce(col(text), F.lit(""))))
    return (F.length(s) >= 10) & ~(any_of(s, VAGUE) & (F.length(s) < 50)) & any_of(s, ACTIONS)


def text_profile(text) -> Column:
    """Length, lines, tokens, flags and a five-part complexity of a prompt."""
    t = F.coalesce(col(text), F.lit(""))
    examples, fmt = t.rlike("example|Example|EXAMPLE"), t.rlike("JSON|json|format")
    count = lambda s: F.floor((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s))
    score = sum((c.cast("int") for c in (F.length(t) > 1000, count("{") > 10, examples, fmt, t.rlike("CRITICAL|IMPORTANT"))), F.lit(0)) / 5
    lines = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\n$", ""), "\n")))
    return F.struct(
        F.length(t).alias("characters"), lines.alias("lines"), F.floor(F.length(t) / 4).cast("int").alias("tokens"), examples.alias("has_examples"), fmt.alias("has_format"), score.alias("complexity"),
        F.array_compact(F.array(
            F.when(F.length(t) > 4000, "too long"), F.when(~examples, "no examples"), F.when(~fmt, "no format"), F.when(count("```") % 2 != 0, "unmatched code block"), F.when(t.rlike(r"\{[^}]*\{"), "nested placeholder"),
        )).alias("problems"),
    )


def doc_quality(parameters: Column, described: Column, returns: Column, examples: Column, description: Column) -> Column:
    """1 to 5: sections that a documentation has."""
    score = 1 + (F.length(description) > 20).cast("int") + parameters.cast("int") + (parameters & described).cast("int") + returns.cast("int") + examples.cast("int")
    return F.least(score, F.lit(5))


def vocabulary(text, words: tuple[str, ...] | None = None) -> Column:
    """Lower-case words of three letters and more, or only the given ones."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[a-z]{3,}"), F.lit(0))
    return found if words is None else F.filter(found, lambda w: w.isin(*words))
