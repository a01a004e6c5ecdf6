import pytest


@pytest.fixture
def frame(spark):
    """Make a DataFrame of rows, spread over three partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)

    return make


def words(n, start=0, base=7919):
    """n words that hardly repeat."""
    return " ".join(f"w{(start + i) * base % 100_003:x}" for i in range(n))


def even_and_odd():
    """Two words that polynomial hashes modulo a power of two do not tell apart."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return [one, one.translate({97: 98, 98: 97})]
