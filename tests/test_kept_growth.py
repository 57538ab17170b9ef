"""What a merge into a kept table shuffles."""

from ledgerline.sources import kept


def test_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "RANGE_ROWS", 500)
    path, plans = str(tmp_path / "t"), []
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS n", "concat('K-', id) AS key")
    real = type(rows).repartition

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a)

    monkeypatch.setattr(type(rows), "repartition", seen)
    kept.merge_kept(rows, path, "key", lambda _: rows)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning" not in plans[0]
    stored = kept.read_kept(spark, path)
    assert stored.count() == 4000 and stored.select("key").distinct().count() == 4000
