"""Source files of many shapes, made from the rows of a table by their key: methods, nested
and async functions, decorators, four documentation styles, syntax errors, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._lift import lookup
from . import shared

#: key % 10 -> path and content; {k} is the key, {p} the one before, {n} the next.
FILES: dict[int, tuple[str, str]] = {
    0: ("shop/box_{k}.py", '''class Box{k}:
    """A box."""

    @property
    def size{k}(self) -> int:
        """Size of the box."""
        return self._size

    @classmethod
    def make{k}(cls, size: int) -> "Box{k}":
        """Make a box.

        Args:
            size (int): How large.

        Returns:
            Box{k}: The box.
        """
        return cls(size)

    def grow{k}(self, by: Optional[int] = None, *more, **rest) -> None:
        """Grow the box.

        Args:
            by (int): How much.
        """
        for x in more:
            self._size += x
'''),
    1: ("shop/fetch_{k}.py", '''async def fetch{k}(url: str, retries: Union[int, None] = 3, timeout: float = 1.0) -> Dict[str, int]:
    """Fetch a page.

    Parameters
    ----------
    timeout : float
        Seconds to wait.
    url : str
        Where it is.
    retries : int, optional
        How often to try.

    Returns
    -------
    Dict[str, int]
        The counts.
    """
    async with opened(url) as f:
        return {"n": size(await f.read())}
'''),
    2: ("shop/walk_{k}.py", '''def walk{k}(items: list) -> Iterator[int]:
    """Walk over items.

    :param items: What to walk over.
    :type items: list
    :returns: The lengths.
    :rtype: Iterator[int]
    :raises KeyError: If one is missing.
    """
    def inner{k}(x):
        if x not in items:
            raise KeyError(x)
        return x + 1
    for i in items:
        yield inner{k}(i)
'''),
    3: ("shop/build_{k}.py", '''def build{k}(cls, name: str = None, count: int = 2):
    """Build it.

    Args:
        name (str): The name.
        count (int): How many. Defaults to 3.
    """
    return [name] * count
'''),
    4: ("pkg/sub/mod_{k}.py", '''import os.path as p
from ..util import first as f, second
from . import sibling


def good{n}(x):
    return f(x, retries=2)
'''),
    5: ("shop/broken_{k}.py", '''def good{k}(x):
    """A good one, told at length."""
    return x["a"].b


def broken(:
    pass
'''),
    6: ("pkg{k}/__init__.py", '''"""A package.

describe{k}: Tells what the thing is about.
"""
__all__ = ["describe{k}", "more"]
'''),
    7: ("pkg{p}/core.py", '''def describe{p}(thing):
    return thing
'''),
    8: ("lib/home{k}.py", '''def shared{k}(value: float, lable: str = "x") -> float:
    """Twice the value, as everybody expects of it.

    Args:
        value (float): What to double.
        label (str): What it is called.

    Returns:
        float: The double.
    """
    return value * 2


def __len__(self) -> int:
    return 0
'''),
    9: ("app/use{p}.py", '''from lib.home{p} import shared{p}


def shared{p}(value):
    return value


def lonely{k}(x):
    if x:
        return "a"
    return None
'''),
}


def _filled(text: Column, key: Column) -> Column:
    for mark, value in (("{k}", key), ("{p}", key - 1), ("{n}", key + 1)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return text


def source_files(parts: DataFrame) -> DataFrame:
    """part rows -> (p_partkey, path, content). Rows are dealt out first, as a small table's
    bytes say nothing of the texts made from it."""
    parts = shared.dealt(parts, "p_partkey")
    key = F.col("p_partkey")
    path, content = (lookup(key % 10, {k: f[i] for k, f in FILES.items()}) for i in (0, 1))
    return parts.select("p_partkey", _filled(path, key).alias("path"), _filled(content, key).alias("content"))
