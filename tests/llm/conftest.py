import random

import pytest
from pyspark.sql import types as T

#: Columns whose names the operators use for themselves.
CLASHING = ("row", "words", "point", "spans", "kept", "term", "blob", "n_words", "text2", "shard", "token_ids")


def _schema(extra=()):
    fields = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    return T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in extra)])


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, extra=()):
        full = []
        for r in rows:
            doc_id, text, lang = (*r, None)[:3]
            full.append((doc_id, text, lang, "src", None if text is None else len(text), *["x"] * len(extra)))
        return spark.createDataFrame(full, _schema(extra))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and repeated ids, null, empty, blank and very long texts, ties."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, long),
        (5, "one"),
        (5, "one"),
        (None, "no id has this text, it is kept all the same"),
        (None, None),
        (6, "ÄÖ\u00a0ü é \U0001f600 İ \u2028 x"),
        (7, "\\ < > </turn> <|endoftext|> \x00 \x7f"),
    ]
