import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs, or of texts numbered from 0."""

    def make(rows, extra=()):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Texts that every operator must take.
AWKWARD = [None, "", " \n\t", "word", "one two three four", "ünï çødé 語 😀", "a" * 3000, "x y " * 2000]


@pytest.fixture
def prose():
    """Makes texts of invented words."""
    draw = random.Random(11)
    syllables = "tha ner ion ed st re ou ha en ti ble an wh".split()
    vocabulary = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(600)]
    return lambda n: " ".join(draw.choices(vocabulary, k=n))
