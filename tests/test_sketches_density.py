"""Sketched name sets and binned densities against their exact forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import density, profile, sketches
from tests.conftest import rows

FACT = "name string, asab string, region string, year int"


def fact(spark, seed=1, n=6000, names=900):
    rng = random.Random(seed)
    data = [(f"n{int(names * rng.random() ** 2)}" if rng.random() > 0.01 else None, rng.choice("FM"), rng.choice("abc") if rng.random() < 0.7 else "hot", rng.randrange(1990, 1996))
            for _ in range(n)]
    return spark.createDataFrame(data, FACT)


def test_small_sets_are_counted_exactly(spark):
    """Below the size of a sketch every roll-up and intersection equals the exact query."""
    df = fact(spark)
    cells = sketches.name_sketches(df)
    for by in ([], ["region"], ["year"], ["region", "asab"]):
        want = df.groupBy(*by).agg(F.count_distinct("name").alias("n_names"), F.count("*").alias("entries"))
        assert rows(sketches.estimates(sketches.roll_up(cells, by)), *by, "n_names", "entries") == rows(want, *by, "n_names", "entries")
    some = sketches.estimates(sketches.roll_up(cells, where=F.col("year") < 1992)).first()["n_names"]
    assert some == df.where("year < 1992").select("name").dropna().distinct().count()
    got = sketches.unisex_sketch(cells).first()
    assert got["both"] == profile.unisex_intersection(df.dropna()).count()
    classes = {r["class"]: r.n for r in profile.attestation_class(df.dropna()).groupBy("class").agg(F.count("*").alias("n")).collect()}
    assert (got.f_only, got.m_only) == (classes.get("F only", 0), classes.get("M only", 0))
    assert got.fem == got.both + got.f_only


def test_large_sets_stay_within_the_stated_error(spark):
    df = spark.range(60_000).select(F.format_string("x%d", "id").alias("name"), F.when(F.col("id") % 3 == 0, "F").otherwise("M").alias("asab"),
                                    F.lit("a").alias("region"), (F.col("id") % 7).cast("int").alias("year"))
    both = df.union(df.where("year < 3").withColumn("asab", F.when(F.col("asab") == "F", "M").otherwise("F")))
    cells = sketches.name_sketches(both, lg_entries=10)
    assert sketches.estimates(sketches.roll_up(cells, lg_entries=10)).first()["n_names"] == pytest.approx(60_000, rel=4 * sketches.standard_error(10))
    exact = profile.unisex_intersection(both).count()
    got = sketches.unisex_sketch(cells, lg_entries=10).first()["both"]
    assert got == pytest.approx(exact, rel=4 * sketches.standard_error(10) * math.sqrt(60_000 / exact))


def test_empty_facts_and_one_sex(spark):
    empty = spark.createDataFrame([], FACT)
    assert sketches.estimates(sketches.name_sketches(empty)).collect() == []
    one = sketches.name_sketches(spark.createDataFrame([("Ann", "F", "a", 1990), (None, "F", "a", 1990)], FACT))
    got = sketches.unisex_sketch(one).first()
    assert (got.fem, got.msc, got.both, got.f_only, got.m_only) == (1, 0, 0, 1, 0)


@pytest.mark.parametrize("refine", [1, 3, 8])
def test_binned_density_stays_within_its_bound(spark, refine):
    """Random facets, one with a third of all points, one without spread, one with NULLs and points outside."""
    rng = np.random.default_rng(refine)
    data = []
    for g, n in (("hot", 900), ("wide", 400), ("few", 12)):
        points = rng.normal(0.5, rng.uniform(0.08, 0.3), (n, 2))
        data += [(g, float(x), float(y)) for x, y in points]
    data += [("flat", 0.5, 0.5)] * 5 + [("few", None, 0.3), (None, 0.2, 0.9), (None, 0.4, 0.7), (None, 0.1, 0.3), (None, 0.6, 0.2)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    limits = (["g"], "x", "y", (0.0, 1.0), (0.0, 1.0), 17)
    exact = density.density2d(df, *limits).toPandas().set_index(["g", "ix", "iy"]).sort_index()
    binned = density.density2d_binned(df, *limits, refine=refine).toPandas().set_index(["g", "ix", "iy"]).sort_index()
    assert len(exact) == len(binned) and list(exact.index) == list(binned.index)
    off = np.abs(exact["density"].to_numpy() - binned["density"].to_numpy())
    assert (off <= binned["error"].to_numpy() + 1e-12).all()
    assert np.allclose(binned["error"], binned["error"].groupby(level=0, dropna=False).transform("first"))
    if refine == 8:
        assert off.max() < 0.02 * exact["density"].max()
