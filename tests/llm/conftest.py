from __future__ import annotations

import pytest

from winnow.llm.common import ship

# Nulls, empty and long texts, ties, repeated rows, other scripts, and columns whose names the operators use inside.
ROWS = [
    (1, "The cat sat on the mat, and the dog didn't mind."), (2, None), (3, ""), (4, " \t\n"), (None, "no id at all"),
    (5, "long " * 9000 + "end"), (6, "The cat sat on the mat, and the dog didn't mind."), (6, "same id, other text"),
    (7, "Ünïcödé ΣΑΣ ﬁne İstanbul 你好 🙂 x́ <|endoftext|> 's <|ENDOFTEXT|> é,"), (8, "12 3.4!? ***it's*** ÀÉ×÷ß"),
    (9, "repeated row"), (9, "repeated row"), (10, "a"), (None, None),
]
CLASHING = ["place", "rank", "n", "length", "part", "shard", "slot", "key", "pos", "start", "_row", "hit", "word"]


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    rows = [(i, t, "en", None, 0, *range(len(CLASHING))) for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} int" for c in CLASHING)
    return llm.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
