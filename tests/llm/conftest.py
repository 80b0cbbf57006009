from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def llm(spark):
    """The session, prepared for the operators."""
    from yieldspark.llm.common import prepare

    return prepare(spark)


@pytest.fixture
def odd_texts(llm):
    """Documents with null, empty, repeated, long and unusual texts, and columns named like results."""
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "a" * 3000), (4, "<|endoftext|> it's <|endoftext|>x" * 40), (5, "漢字 é ́\x1c\x85" * 200),
        (6, "one two three four five six " * 90), (6, "one two three four five six " * 90), (None, "no id"), (7, "One two  three   four\n \nfive"), (8, "it's 9"),
    ]
    return llm.createDataFrame([(i, t, None, -1, "x") for i, t in rows], "doc_id long, text string, lang string, n_tokens long, component_id string")
