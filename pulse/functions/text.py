"""Text predicates and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a removed post.
PLACEHOLDERS = ("[deleted]", "[removed]")


def usable(text: Column, min_length: int = 1) -> Column:
    """Not null, not a placeholder, at least min_length characters after trimming blanks."""
    t = F.coalesce(text, F.lit(""))
    return ~t.isin(*PLACEHOLDERS) & (F.length(F.trim(t)) >= 1) & (F.length(t) >= min_length)


def clean(text: Column) -> Column:
    """Markdown and links out: URLs, then /r/ and /u/ names, link brackets, marks, and runs of white space.

    URLs go first, with a bracket that closes right after them. Null and
    placeholders become empty.
    """
    # Fixed values of the cleaning rules, in their order.
    rules = (
        (r"(?U)https?://\S+", ""),
        (r"(?U)/r/\w+", ""),
        (r"(?U)/u/\w+", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"[*_~`#>]", ""),
        (r"(?U)\s+", " "),
    )
    t = F.coalesce(text, F.lit(""))
    out = F.when(t.isin(*PLACEHOLDERS), F.lit("")).otherwise(t)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)
