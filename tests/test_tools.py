import re

from skarn.plans import tools


def test_line_items_are_shuffled_once(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tools.make_repos(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange ", plan)) == 3, "one for each of parts, line items and documents"
    lines = plan[: plan.index("hashpartitioning(l_partkey")]
    assert "keys=[l_partkey" in lines and "Aggregate" not in plan[len(lines) :], "no rows are folded before the shuffle"


def test_partitions_grow_with_the_table(spark, sf, monkeypatch):
    least = spark.sparkContext.defaultParallelism
    assert tools.partitions_of(spark, sf, "lineitem") == least
    size = tools.source_state(spark, sf, ("lineitem",))[0][0]
    monkeypatch.setattr(tools, "PARTITION_BYTES", size // 50)
    assert 50 <= tools.partitions_of(spark, sf, "lineitem") <= 51
