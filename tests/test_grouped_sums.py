import math
import random

from lexiprobe.plans import grouped


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    """Improvements of nothing are told from rounding by their sign, so sums must not depend on where rows lie."""
    rng = random.Random(2)
    rows = [(i, "en", "train" if i % 3 else "test", 0, round(rng.random() * 9, 3)) for i in range(6000)]
    want = {}
    for part in ("train", "test"):
        y = [r[4] for r in rows if r[2] == part]
        want[part] = (len(y), math.fsum(y), math.fsum(v * v for v in y))
    for parts in (1, 7):
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, language string, split string, x int, value double").repartition(parts)
        got = grouped.statistics(frame, {"task": "value"}, seeds=(1,)).collect()
        assert {(r["part"], r["control_index"]): (r["n"], r["sy"], r["syy"]) for r in got} == {("train", 0): want["train"], ("train", 1): want["train"], ("test", 0): want["test"]}


def test_sums_of_values_that_are_no_decimals(spark):
    frame = spark.createDataFrame([(1.5,), (1e300,), (1e300,), (-2.0,)], "v double").repartition(2)
    assert frame.agg(grouped._exact_sum(frame["v"]).alias("s")).first()["s"] == 2e300
    assert math.isnan(spark.createDataFrame([(1.5,), (float("nan"),)], "v double").agg(grouped._exact_sum(grouped.F.col("v")).alias("s")).first()["s"])
