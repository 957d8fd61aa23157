"""Character classes and trimming, as the markup defines them.

White space in patterns is TAB, LF, FF, CR and the Unicode separators; trimming takes TAB and the space separators. Both are
spelt out because Java's own classes are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IN_SPACE = r"\t\n\f\r\p{Z}"
SPACE = f"[{IN_SPACE}]"
NOT_SPACE = f"[^{IN_SPACE}]"
BLANK = r"[\t\p{Zs}]"
#: The newline set is wider than the three line ends that normalisation knows.
NEWLINES = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def trim_newlines(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{NEWLINES}+|{NEWLINES}+\z", "")


def ordered_join(order: list[Column], text: Column, between: str) -> Column:
    """Aggregate: the texts of a group in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), between)
