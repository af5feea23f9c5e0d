"""Attaching accounts, accepting outcomes, canonical records, on rows by hand."""

import json
import random

from pyspark.sql import functions as F

from crowdweave.operators import attach, selection, workflow


def made(draw, depth=0):
    kind = draw.randrange(6 if depth < 4 else 4)
    if kind == 0:
        return draw.randrange(-(10**12), 10**12)
    if kind == 1:
        return "".join(draw.choice('aé"\\ /ช\n\tß') for _ in range(draw.randrange(6)))
    if kind == 2:
        return draw.choice([None, True, False])
    if kind == 3:
        return draw.randrange(1, 100) / 8
    if kind == 4:
        return [made(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {"".join(draw.choice("abBé_1") for _ in range(3)): made(draw, depth + 1) for _ in range(draw.randrange(4))}


def test_canonical_json_is_sorted_and_compact_at_any_depth(spark):
    draw = random.Random(3)
    values = [{"k": made(draw), "a": made(draw)} for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(v, indent=1, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)] + [(60, "no json"), (61, None)], "i int, t string")
    found = {r.i: r.c for r in rows.select("i", attach.canonical_json(F.col("t")).alias("c")).collect()}
    assert found.pop(60) is None and found.pop(61) is None
    for i, text in found.items():
        assert json.loads(text) == values[i]

        def whole(v):  # numbers are equal by value, 5.0 is 5
            if isinstance(v, dict):
                return {k: whole(x) for k, x in v.items()}
            return [whole(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() else v

        assert text == json.dumps(whole(values[i]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_talents(spark):
    talents = spark.createDataFrame(
        [
            (1, "none", None, "ACTIVE", ("xUC", "n"), ("12x", "u", None)), (2, "shared", ["PNG"], "ACTIVE", ("UCs", "n"), None), (3, "shares", ["PNG"], "ACTIVE", ("UCs", "n"), ("77", "Seven", "t")),
            (4, "torn", ["3D"], "ACTIVE", ("UCa", ""), ("5", "u", "t")), (5, "known", ["3D"], "RETIRED", ("UCb", ""), ("9", "Nine", None)), (6, "new", ["PNG", "PNG"], "RETIRED", ("UCc", ""), None),
        ],
        "id long, name string, types array<string>, status_type string, youtube struct<channel_id: string, name: string>, twitch struct<channel_id: string, username: string, name: string>",
    )
    accounts = spark.createDataFrame([("a", "youtube", "UCa", None), ("t5", "twitch", "5", ""), ("b", "youtube", "UCb", ""), ("t9", "twitch", None, "@nine")], "id string, platform string, platform_id string, handle string")
    links = spark.createDataFrame([("a", "p1", "verified"), ("t5", "p2", "pending"), ("b", "p3", "verified"), ("t9", "p4", "rejected")], "account_id string, persona_id string, review_status string")
    plan = attach.talent_plan(talents, accounts, links)
    found = {r.talent_id: (r.outcome, r.persona_type, r.status) for r in plan["outcomes"].collect()}
    assert found == {
        1: ("no_stable_account", None, None), 2: ("shared_channel", None, None), 3: ("shared_channel", None, None), 4: ("conflict_multi_persona", None, None),
        5: ("matched_existing", None, None), 6: ("new_persona", "pngtuber", "graduated"),
    }
    assert [(r.platform_id, r.name) for r in plan["accounts"].collect()] == [("UCc", "new")]
    assert sorted((r.persona_id, r.account_id[:4]) for r in plan["links"].collect() if r.persona_id == "p3") == [("p3", "t9")]
    assert plan["links"].count() == 2


def test_outcomes_are_accepted_as_a_whole(spark):
    jobs = spark.createDataFrame([(j, "c", "v", "comment", s) for j, s in [("ok", "SUCCESS"), ("empty", "EMPTY_RESULT"), ("lies", "EMPTY_RESULT"), ("other", "SUCCESS"), ("odd", "?"), ("none", None), ("slow", "RATE_LIMITED"), ("off", "COMMENTS_DISABLED"), ("noted", "RATE_LIMITED")]], "job_id string, channel_id string, video_id string, source_type string, status string")
    events = spark.createDataFrame([("ok", "c", "v", "comment"), ("ok", "c", "v", "comment"), ("lies", "c", "v", "comment"), ("other", "c", "v", "comment"), ("other", "c", None, "comment"), ("noted", "x", "v", "comment")], "job_id string, channel_id string, video_id string, source_type string")
    found = {r.job_id: (r.status, r.records, r.retry, r.wait) for r in attach.accepted(jobs, events).collect()}
    assert found == {
        "ok": ("SUCCESS", 2, False, None), "empty": ("EMPTY_RESULT", 0, False, None), "lies": ("STORAGE_FAILURE", 0, True, 30), "other": ("STORAGE_FAILURE", 0, True, 30),
        "odd": ("EXTRACTION_FAILURE", 0, True, 30), "none": ("EXTRACTION_FAILURE", 0, True, 30), "slow": ("RATE_LIMITED", 0, True, 60), "off": ("COMMENTS_DISABLED", 0, False, 30), "noted": ("RATE_LIMITED", 0, True, 60),
    }
    assert {r.job_id for r in attach.publishable(jobs, events).collect()} == {"ok"}


def test_coerced(spark):
    rows = spark.createDataFrame([("12", "0.5", "3", "4", "YES"), (" -7 ", "x", "", "1.5", " true "), (None, None, None, None, None), ("9" * 30, "nan", "1e3", "+2", "off")], "subscriber_count string, thai_confidence string, source_count string, streams_collected string, enabled string")
    found = [tuple(r) for r in attach.coerced(rows).collect()]
    assert found[:3] == [(12, 0.5, 3, 4, True), (-7, 0.0, 1, 0, True), (0, 0.0, 1, 0, True)] and found[3][0] == 0 and found[3][2:] == (1, 2, False)


def test_reviews_with_nulls_do_not_pass(spark):
    at = "timestamp'2024-01-01'"
    candidates = spark.sql(f"SELECT id AS candidate_id, {at} AS discovered_at, array('s') AS source_refs, 'needs-evidence' AS review_status FROM VALUES ('time'), ('form'), ('good'), ('none') AS t(id)")
    reviews = spark.sql(f"""
        SELECT id AS candidate_id, 'approved' AS decision, 'r' AS reviewer, 'why' AS reason, if(id = 'time', null, {at}) AS reviewed_at, array('s') AS source_refs, array('singer') AS roles,
            if(id = 'form', null, 'PNG') AS presentation_format, true AS is_virtual_creator, cast(null AS string) AS verified_channel_id FROM VALUES ('time'), ('form'), ('good') AS t(id)""")
    found = {r.candidate_id: r for r in workflow.reviewed(candidates, reviews).collect()}
    assert {k: (r.review_status, r.problem) for k, r in found.items()} == {
        "time": ("needs-evidence", "before_discovery"), "form": ("needs-evidence", "unknown_format"), "good": ("approved", None), "none": ("needs-evidence", None),
    }
    assert [len(found[k].history) for k in ("time", "form", "good", "none")] == [0, 0, 1, 0] and found["good"].history[0].reviewer == "r"
    past = candidates.withColumn("history", F.array(F.struct(F.lit("rejected").alias("decision"), F.lit("x").alias("reviewer"), F.expr(at).alias("reviewed_at"), F.lit("y").alias("reason"), F.array(F.lit("s")).alias("source_refs"))))
    assert {r.candidate_id: [h.decision for h in r.history] for r in workflow.reviewed(past, reviews).collect()}["good"] == ["rejected", "approved"]


def test_rotating_pages(spark):
    rows = spark.range(23).withColumn("x", F.col("id") * 2)
    for cursor, size in ((0, 5), (20, 5), (22, 1), (45, 4), (3, 40)):
        expected = sorted({(cursor + k) % 23 for k in range(size)})
        assert sorted(r.id for r in selection.rotating(rows, "id", cursor, size).collect()) == expected
    assert selection.rotating(rows.limit(0), "id", 3, 4).collect() == []
