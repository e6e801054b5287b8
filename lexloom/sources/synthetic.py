"""Source files with known defects, made from the rows of a table by their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: key % 8 -> what is wrong with the function's documentation.
DEFECTS = ("none", "missing parameter", "renamed parameter", "wrong type", "no returns", "undocumented exception", "wrong default", "wrong return type")


def source_files(parts: DataFrame) -> DataFrame:
    """part rows -> (p_partkey, path, content): one module with one function for each. Rows
    are dealt out first, as a small table's bytes say nothing of the texts made from it."""
    parts = shared.dealt(parts, "p_partkey")
    k = F.col("p_partkey") % 8
    pick = lambda n, yes, no: F.when(k == n, F.lit(yes)).otherwise(F.lit(no))
    name = F.concat(F.lit("get_"), F.regexp_replace(F.lower("p_name"), "[^a-z]+", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    text = F.concat(
        F.lit("import os\n\n\ndef "), name, F.lit("(size: int, label: str = 'x', *rest) -> int:\n"),
        F.lit('    """Look the part up.\n\n    Args:\n'),
        pick(1, "", "        size (int): How large.\n").cast("string"),
        F.when(k == 2, F.lit("        tag (str): What it says. Defaults to 'x'.\n")).when(k == 3, F.lit("        label (float): What it says. Defaults to 'x'.\n")).when(k == 6, F.lit("        label (str): What it says. Defaults to 'y'.\n")).otherwise(F.lit("        label (str): What it says. Defaults to 'x'.\n")),
        F.lit("        *rest: More.\n"),
        pick(4, "", "\n    Returns:\n") , F.when(k == 4, F.lit("")).when(k == 7, F.lit("        str: The number.\n")).otherwise(F.lit("        int: The number.\n")),
        pick(5, "", "\n    Raises:\n        ValueError: If it is negative.\n"),
        F.lit('    """\n    if size < 0:\n        raise ValueError(label)\n    return size\n'),
    )
    return parts.select("p_partkey", F.concat(F.lit("shop/"), F.translate(F.lower("p_brand"), "# ", "__"), F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("content"))
