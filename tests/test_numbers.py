"""Rounding and formatting as Python does them, on ties and near ties."""

import random

import pytest

from ferrule.functions import numbers
from ferrule.operators import quality
from ferrule.config import Policy

TIES = [0.0625, 0.1875, 0.03125, 0.00015, 2.00005, 0.5, 1.5, 2.5, 0.125, 0.375, 1e-7, 123456.5, 1234565.0, 1e16, -0.0625, -0.00005, 0.0, 1.005, 2.675, 0.9999995]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    near = [(2 * rng.randrange(10**5) + 1) / 2 / 10**4 for _ in range(300)]
    return [*TIES, *near, *(rng.random() for _ in range(300)), None, float("nan")]


def same(a, b):
    return a == b or (a != a and b != b)


@pytest.mark.parametrize("digits", [1, 3, 4, 6])
def test_as_python(spark, values, digits):
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.select("x", numbers.rounded(df.x, digits).alias("r"), numbers.fixed(df.x, digits).alias("f"), numbers.general(df.x).alias("g")).collect()
    assert len(got) == len(values)
    for x, r, f, g in got:
        if x is None:
            assert (r, f, g) == (None, None, None)
        else:
            assert same(r, round(x, digits)) and f == f"{x:.{digits}f}" and g == f"{x:g}"


def test_reasons(spark):
    """The two pages that half-up rounding got wrong, and other ties."""
    cover = [0.0625, 0.0615, 0.0635, 0.0005]
    df = spark.createDataFrame([(i, 200, c, 0.01) for i, c in enumerate(cover)], "page_num int, boxes int, box_coverage double, dark_ratio double")
    got = {r["page_num"]: r["reason"] for r in quality.trace(df, Policy()).collect()}
    assert got == {i: f"sparse cov {c:.3f} < 0.1 (title/divider)" for i, c in enumerate(cover)}


def test_whole_numbers(spark):
    df = spark.createDataFrame([(3,)], "x int")
    assert tuple(df.select(numbers.rounded(df.x, 2), numbers.general(df.x)).first()) == (3.0, "3")
