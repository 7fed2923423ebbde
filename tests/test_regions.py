"""Every declared region meets the other rows, beyond 64 too; regions are summed up as SQL does."""

import random

from tessera import plans

from tests.compare import connect, difference


def test_manual_region_takes_all_regions(spark, tmp_path):
    spark.range(70).selectExpr("id as r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(3).selectExpr("id as n_nationkey", "id as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    found = {(r[0], r[1]) for r in plans.QUERIES["j17_manual_region"](spark, str(tmp_path)).collect()}
    assert found == {(r, n) for r in range(70) for n in range(3) if r != n}


def test_region_summary_of_unknown_and_repeated_parts(spark, tmp_path):
    rng = random.Random(5)
    some = lambda x: None if rng.random() < 0.1 else x
    price = lambda: rng.choice([float("nan"), 0.0, -0.0, *(float(k) for k in range(30))])
    rows = [(some(rng.randrange(300)), some(rng.choice("ab")), some(rng.choice("xy")), some(rng.randrange(-8, 20)), some(price())) for _ in range(500)]
    rows += [(1000, "c", "x", 1, 1.0), (1000, "c", "x", 2, 2.0), (1001, "d", "x", None, None), (1002, "d", "x", 3, None)] + [(2000 + k, "e", "x", 7, float(k)) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = connect(str(tmp_path))
    assert difference(spark, con, plans.QUERIES["a16_region_summary"], plans.ORACLES["a16_region_summary"], str(tmp_path)) is None


def test_region_summary_makes_no_pairs(spark, tmp_path):
    """One block of very many differing parts: 3.6e9 pairs, which are counted by sorts."""
    spark.range(60_000).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size", "cast(id as double) as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    row = plans.QUERIES["a16_region_summary"](spark, str(tmp_path)).first()
    near = sum(1200 * 1200 for a in range(50) for b in range(50) if abs(a - b) <= 5) - 60_000
    assert tuple(row) == ("b", 60_000 * 59_999, near, 60_000 * 59_999 - near, near // 2, near // 2, 0)
