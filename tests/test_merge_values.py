"""What is done to the values is done before the rows of a name meet."""
from collections import Counter

from pyspark.sql import functions as F

from featurelab.operators import align as A
from featurelab.plans import q_prep as Q


def test_values_are_rounded_once_a_row(spark, tmp_path):
    rows = [(k, f"name {k % 3}" if k % 7 else None, None if k % 11 == 5 else k + 0.123456) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = Q.q_merge_by_name(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "round(" not in plan[:plan.index("Join")]
    want = Counter()
    for k, name, v in rows:
        values = [x * 2 if x is not None else None for i, n, x in rows if i % 3 == 0 and n == name and n is not None]
        for x in values or [None]:
            x = v if x is None else x
            want[k, name, None if x is None else round(x, 4)] += 1
    assert Counter((r["key"], r["name"], r["value"]) for r in got.collect()) == want


def test_each_is_applied_to_both_sides(spark):
    dst = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), (None, 3.0, 3), ("c", None, 4)], "name string, value double, key int")
    src = spark.createDataFrame([("a", 10.0), ("a", None), ("d", 5.0)], "name string, value double")
    got = A.merge_by_name(dst, src, each=lambda c: c * 2).collect()
    assert Counter(map(tuple, got)) == Counter([("a", 20.0, 1), ("a", 2.0, 1), ("b", 4.0, 2), (None, 6.0, 3), ("c", None, 4)])
    assert A.merge_by_name(dst, src).columns == dst.columns and A.merge_by_name(dst, src).where(F.col("key") == 2).first()["value"] == 2.0
