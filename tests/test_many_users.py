"""Settings and verdicts that are small as files and large as rows are not broadcast."""

from pyspark.sql import functions as F

from tidewell.functions import sizing
from tidewell.operators.fusion import fuse_verdicts


def test_many_users_are_not_broadcast(spark, tmp_path):
    spark.range(700_000).selectExpr("id AS user_id").write.parquet(str(tmp_path / "users"))
    users = spark.read.parquet(str(tmp_path / "users"))
    settings = users.selectExpr("user_id", "map('keyword', true, 'semantic', user_id % 2 = 0) AS toggles", "'balanced' AS popup_policy")
    verdicts = users.selectExpr("user_id AS msg_id", "CAST(NULL AS STRING) AS raw", "CAST(NULL AS STRING) AS error")
    assert sizing.estimated_bytes(settings) <= sizing.BROADCAST_LIMIT_BYTES < sizing.held_bytes(settings)
    scanned = spark.createDataFrame([(1, 1, 0), (2, 2, 3), (3, None, 3)], "msg_id long, user_id long, level int").selectExpr(
        "*", "false AS tier3", "level > 0 AS matched", "false AS received_threat", "CAST(array() AS array<string>) AS categories")
    fused = fuse_verdicts(scanned, verdicts, settings)
    assert "Broadcast" not in fused._jdf.queryExecution().executedPlan().toString().replace("autoBroadcast", "")
    assert {r["msg_id"]: (r["risk_level"], r["source"], r["recorded"]) for r in fused.collect()} == {
        1: ("none", "disabled", False), 2: ("high", "fail_safe", True), 3: ("high", "fail_safe", False)}
    few = fuse_verdicts(scanned, verdicts.where("msg_id < 3"), settings.where(F.col("user_id") < 3).limit(3))
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
