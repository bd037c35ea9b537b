"""Every registered query has a name of its own and plans over the supplied tables."""

from tidewell import catalog

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_gate_reads_only_what_it_needs(spark):
    plan = catalog.queries()["trend_gate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_does_not_shuffle_beyond_spreading_a_small_input(spark):
    plan = catalog.queries()["scan_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") + plan.count("REPARTITION_BY_NUM") \
        or plan.count("Exchange ") <= 1
