"""Steps that must spread over tasks: sources of many files, layouts of few files, passes that are made once."""

import os

import pytest
from pyspark.sql import functions as F

from crowdweave.operators import overlap, policy, registry
from crowdweave.plans import commit_queries, delivery_queries, file_queries, stream_queries
from crowdweave.plans.queries import QUERIES
from crowdweave.plans.roles import Roles
from crowdweave.sources import sinks
from crowdweave.streaming import ingest


def test_running_figures_are_columns_of_the_state_store(spark, tmp_path):
    schema = "video_id string, viewer_id string, interaction_at timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/o")
    plan = ingest.viewer_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/o"))._jdf.queryExecution().logical().toString()
    assert "Pandas" not in plan and "Aggregate" in plan


def test_a_batch_of_a_stream_holds_many_files(spark, tmp_path):
    roles = Roles(spark, str(tmp_path))
    rows = spark.range(0, 100, 1, 6).withColumn("_n", F.col("id"))
    seen = []
    file_queries._streamed(roles, file_queries._source(roles, rows), lambda batch, n: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count())))
    assert sum(n for n, _ in seen) == 100 and len(seen) == 2 and all(files > 1 for _, files in seen)


def test_many_channels_make_few_files(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(0))
    rows = spark.range(300).select(F.concat(F.lit("c"), "id").alias("channel_id"), F.lit("v").alias("video_id"), F.lit("comment").alias("source_type"), F.lit("w").alias("viewer_id"), at.alias("first_seen"), at.alias("last_seen"), F.lit(1).cast("long").alias("appearances"))
    sinks.merge_presence(spark, f"{tmp_path}/p", rows)
    sinks.merge_presence(spark, f"{tmp_path}/p", rows.where("channel_id = 'c7'").withColumn("appearances", F.lit(5).cast("long")))
    sinks.write_observations(rows, f"{tmp_path}/o")
    found = spark.read.schema(rows.schema).parquet(f"{tmp_path}/p")
    assert len(found.inputFiles()) <= sinks.BUCKETS and len(spark.read.parquet(f"{tmp_path}/o").inputFiles()) <= sinks.BUCKETS
    assert found.count() == 300 and found.where("appearances = 5").select("channel_id").collect() == [("c7",)]


def test_edges_are_made_once_before_they_are_named(spark):
    seen = spark.createDataFrame([(c, "v", u, "comment", None) for c in "ABC" for u in "xy"], "creator_id string, video_id string, viewer_id string, source_type string, observed_at timestamp")
    accounts = spark.createDataFrame([("1", "youtube", "A", "first")], "id string, platform string, platform_id string, name string")
    named = registry.network_table(overlap.overlap_edges(seen), accounts)
    assert "hashpartitioning(block" not in named._jdf.queryExecution().executedPlan().toString()
    assert [(r.channel_a, r.channel_b, r.shared_viewers) for r in named.collect()] == [("first", "B", 2), ("first", "C", 2), ("B", "C", 2)]


def test_edges_are_named_after_they_are_dealt_into_ranges(spark):
    seen = spark.createDataFrame([(c, "v", u, "comment", None) for c in "ABC" for u in "xy"], "creator_id string, video_id string, viewer_id string, source_type string, observed_at timestamp")
    accounts = spark.createDataFrame([("1", "youtube", "A", "first")], "id string, platform string, platform_id string, name string")
    plan = registry.network_table(overlap.overlap_edges(seen), accounts)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    dealt = [i for i, line in enumerate(lines) if "rangepartitioning(" in line]
    assert len(dealt) == 1 and dealt[0] > max(i for i, line in enumerate(lines) if "Join" in line)


FOLDER = "/root/testdata/sf0.001"


def test_presence_of_snapshots_is_dealt_once(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    plan = overlap.viewer_presence(Roles(spark, FOLDER).snapshots)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(" in line for line in plan.splitlines()) == 1


def test_counting_interactions_deals_nothing_but_the_join(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    roles = Roles(spark, FOLDER)
    assert roles.facts.count() == roles.interactions.count() == roles.interactions.distinct().count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = QUERIES["fingerprint_inputs"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("creator_id" in line or "viewer_id" in line for line in dealt)


@pytest.mark.parametrize(("module", "name", "size"), [(delivery_queries, "seed_candidates", "SEEDS_A_FILE"), (commit_queries, "guarded_rows", "ROWS_A_FILE")])
def test_files_that_one_task_reads_are_several(spark, tmp_path, monkeypatch, module, name, size):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    monkeypatch.setattr(module, "fresh_folder", lambda _: f"{tmp_path}/in")
    few = sorted(map(tuple, getattr(module, name)(Roles(spark, FOLDER)).collect()), key=repr)
    monkeypatch.setattr(module, "fresh_folder", lambda _: f"{tmp_path}/more")
    monkeypatch.setattr(module, size, 5)
    many = sorted(map(tuple, getattr(module, name)(Roles(spark, FOLDER)).collect()), key=repr)
    assert few == many and len(few) > 0
    found = {n: spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/{n}").inputFiles() for n in ("in", "more")}
    assert len(found["more"]) > len(found["in"])


def test_a_policy_walk_makes_one_pass_over_its_records(spark, monkeypatch):
    plans = []

    def written(rows, write=policy.written):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows)

    monkeypatch.setattr(policy, "written", written)
    records = spark.createDataFrame([(1, '{"a": {"viewer_id": "u", "b": ["{\\"author_id\\": 1}"]}}'), (2, "x"), (3, None)], "id long, record string")
    found = {tuple(r) for r in policy.findings(records, "id", "record").collect()}
    assert found == {(1, "private", "viewer_id"), (1, "private", "author_id")}
    assert plans and not any("Union" in plan for plan in plans)


def test_thread_items_are_made_in_one_pass_and_stay_where_they_are(spark, monkeypatch):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    monkeypatch.setattr(stream_queries, "LINES_A_TASK", 1000)
    plan = stream_queries.thread_items(Roles(spark, FOLDER)).groupBy("video_id", "ordinal").count()._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Exchange hashpartitioning") == 1
