import pytest

#: Columns of every shape that an operator doesn't know, some with names it uses inside.
CLASHING = "body string, k string, t string, seq int, n string, lang_guess string, vec string, h int, part int, rank int, key string, size string, box string, label string, stats string"


@pytest.fixture
def clashing(spark):
    """Adds columns with clashing names, all null or odd, to a frame that lacks them."""
    from pyspark.sql import functions as F

    def add(df):
        for column in CLASHING.split(", "):
            name, kind = column.split()
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        return df

    return add
