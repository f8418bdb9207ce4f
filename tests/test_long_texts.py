"""Expressions over long texts and vectors."""

import time

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators import mlprep


def test_arguments_of_long_texts(spark):
    """The depth at each character was an array built anew for each character."""
    long = "x" * 20_000
    cases = [f"f({long}) z", "a, g(b, (c)), d", "", " , ", "(()", ")a,b(", "(a)(b)", "(é,\n)", None]
    began = time.time()
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = rows.select("i", text.matching_paren("c").alias("at"), text.split_arguments("c").alias("a")).orderBy("i").collect()
    assert [r["at"] for r in got] == [20_003, 12, 0, 0, 0, 0, 3, 5, 0]
    assert [r["a"] for r in got] == [[f"f({long}) z"], ["a", "g(b, (c))", "d"], [], [], ["(()"], [")a,b("], ["(a)(b)"], ["(é,\n)"], None]
    assert time.time() - began < 60


def test_softmax_of_long_vectors(spark):
    """The largest logit was looked for again at each logit."""
    began = time.time()
    rows = spark.range(20).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: (i % 1000).cast("double")).alias("x"))
    got = rows.select(mlprep.softmax(F.transform("x", lambda v: v + 1)).alias("s")).select("s.predicted", F.size("s.probs").alias("n"), "s.confidence").distinct().collect()
    assert [(r["predicted"], r["n"], round(r["confidence"], 6)) for r in got] == [(998, 20_000, 0.031606)]
    none = spark.range(1).select(mlprep.softmax(F.lit(None).cast("array<double>")).alias("s")).select("s.*").first()
    assert tuple(none) == (None, None, None)
    assert time.time() - began < 60
