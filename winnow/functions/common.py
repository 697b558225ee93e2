"""Text, array and number helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, plus the four ASCII separators that text tools also strip.
_SPACE = r"[\s\x1c-\x1f]"


def pattern(text: str, ignore_case: bool = False) -> str:
    """A Java pattern whose \\s, \\w and \\b follow Unicode."""
    return ("(?iU)" if ignore_case else "(?U)") + text


def found(col: Column, text: str, ignore_case: bool = False) -> Column:
    return col.rlike(pattern(text, ignore_case))


def nested(alternatives: list[str]) -> str:
    """One group for alternatives whose order does not matter, nested by first letter.

    At each place of a text only the alternatives sharing its letter are tried, instead of all of them.
    """
    by_first: dict[str, list[str]] = {}
    for text in alternatives:
        plain = text[:1].isalnum() and text[1:2] not in ("?", "*", "+", "{")
        by_first.setdefault(text[0] if plain else "", []).append(text[1:] if plain else text)
    return "(?:" + "|".join(first + "(?:" + "|".join(rest) + ")" for first, rest in by_first.items()) + ")"


def alternatives(pattern_text: str) -> list[str]:
    """The alternatives of a pattern, split at the bars outside of groups."""
    parts, depth = [""], 0
    for char in pattern_text:
        depth += {"(": 1, ")": -1}.get(char, 0)
        if char == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts


def found_any(col: Column, pattern_text: str) -> Column:
    """Whether any alternative of a pattern occurs."""
    return found(col, nested(alternatives(pattern_text)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(col, pattern(rf"^{_SPACE}+|{_SPACE}+$"), "")


def is_blank(col: Column) -> Column:
    return ~found(col, r"[^\s\x1c-\x1f]")


def text_lines(col: Column) -> Column:
    return F.split(col, "\n")


def join_lines(col: Column) -> Column:
    return F.array_join(col, "\n")


def numbered(items: Column, keep: Callable[[Column], Column]) -> Column:
    """Items passing ``keep`` as structs ``(at, item)`` with their 0-based place in ``items``."""
    pairs = F.transform(items, lambda item, at: F.struct(at.alias("at"), item.alias("item")))
    return F.filter(pairs, lambda p: keep(p["item"]))


def empty_texts() -> Column:
    return F.array().cast("array<string>")


def exact_round(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, the way Python's ``round`` does.

    ``bround`` rounds the shortest decimal text of the value instead, which differs near ties. The value is split
    into two halves short enough for exact products, so the distance to the tie keeps its sign.
    """
    scale = float(10 ** digits)

    def settle(x: Column) -> Column:
        nearest = F.rint(x * scale)
        high = x * 134217729.0 - (x * 134217729.0 - x)
        low = x - high
        over = high * scale - nearest
        rest = low * scale
        above = (over - 0.5) + rest
        below = (over + 0.5) + rest
        odd = F.abs(nearest % 2) == 1
        return (
            F.when((above > 0) | ((above == 0) & odd), nearest + 1)
            .when((below < 0) | ((below == 0) & odd), nearest - 1)
            .otherwise(nearest)
        ) / scale

    return let(value.cast("double"), settle)
