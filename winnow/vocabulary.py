"""The skill vocabulary: an ordered list of terms, given as a parameter.

Order and repetitions matter: matched skills are reported in vocabulary order, and a term listed twice counts
twice. ``load`` reads a list of any field from a text file (one term per line) or a CSV with a ``skill`` column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from winnow import fixed

# Terms compiled into one pattern. A longer vocabulary is matched by several patterns over the same text.
TERMS_PER_PATTERN = 1000


def load(spark: SparkSession, path: str, column: str | None = None) -> tuple[str, ...]:
    """Terms of a vocabulary file, in file order, lower-cased.

    A vocabulary is configuration compiled into the plan, so its lines come to the driver; the file is read as one
    record to keep its order.
    """
    text = spark.read.text(path, wholetext=True).head()[0]
    rows = [line for line in text.splitlines() if line.strip()]
    if column is None:
        return tuple(row.strip().lower() for row in rows)
    position = [name.strip() for name in rows[0].split(",")].index(column)
    return tuple(row.split(",")[position].strip().lower() for row in rows[1:])


def as_table(spark: SparkSession, terms=tuple(fixed.SKILLS)) -> DataFrame:
    """The vocabulary as rows ``(ord, skill)``, ``ord`` counting from 1."""
    return spark.createDataFrame([(i, term) for i, term in enumerate(terms, 1)], "ord int, skill string")


def patterns(terms) -> list[str]:
    """Patterns whose first group is the longest term starting at a word boundary, one match per start.

    The group sits in a look-ahead, so a term inside or overlapping another is found as well. Alternatives are
    nested by first character to keep the work per word small. Where all terms begin with a letter or digit, a place
    after one is no such start, which a look-behind tells sooner than the boundary.
    """
    distinct = list(dict.fromkeys(terms))
    result = []
    for start in range(0, len(distinct), TERMS_PER_PATTERN):
        by_first: dict[str, list[str]] = {}
        for term in distinct[start:start + TERMS_PER_PATTERN]:
            by_first.setdefault(term[0], []).append(term)
        branches = []
        for first, group in by_first.items():
            tails = [_literal(term[1:]) for term in sorted(group, key=len, reverse=True)]
            branches.append(_literal(first) + "(?:" + "|".join(tails) + ")")
        inner = "(?<![A-Za-z0-9_])" if all(c.isascii() and c.isalnum() for c in by_first) else ""
        result.append(inner + r"\b(?=((?:" + "|".join(branches) + r"))\b)")
    return result


def contained_prefixes(terms) -> list[tuple[str, str]]:
    """Pairs ``(longer, shorter)`` where finding ``longer`` implies ``shorter`` starts at the same place."""
    distinct = list(dict.fromkeys(terms))
    known = set(distinct)
    pairs = []
    for longer in distinct:
        for cut in range(1, len(longer)):
            shorter = longer[:cut]
            if shorter in known and _word(longer[cut - 1]) != _word(longer[cut]):
                pairs.append((longer, shorter))
    return pairs


def _word(char: str) -> bool:
    return char == "_" or char.isalnum()


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)
