"""Rich text goes to Python by few rows, and only where it is a tree."""

from pyspark.sql import functions as F

from ledgerline.functions import richtext


def test_only_trees_leave_the_jvm(spark):
    tree = '{"type": "doc", "content": [{"type": "text", "text": "a"}]}'
    df = spark.createDataFrame([(1, tree), (2, "plain"), (3, None), (4, "{no tree")], "id int, body string")
    told = df.select("id", richtext.plain_text(F.col("body")).alias("t"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert dict(told.collect()) == {1: "a", 2: "plain", 3: None, 4: "{no tree"}
