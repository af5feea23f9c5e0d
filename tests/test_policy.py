"""The policy walk on nested records and on files."""

import json
import sqlite3

import pandas as pd
import pytest

from crowdweave.operators import policy

KEY = "AIza" + "x" * 35
COUNTERS = {"TOTAL_ROWS": 3, "NON_EMPTY": 2, "MISSING": 1, "INVALID": 0}


def nested(depth, inner):
    for k in range(depth):
        inner = {"a": inner} if k % 3 else [inner]
    return inner


CASES = {
    "prose": ('she wrote "viewer_id": 5 in the text', set()),
    "object": (json.dumps({"viewer_id": 5}), {("private", "viewer_id")}),
    "placeholder": ('{"viewer_id": ...}', set()),
    "prose in a field": (json.dumps({"note": 'the "viewer_id": 5 column'}), set()),
    "summary": (json.dumps({"viewer_hash": COUNTERS, "display_name": COUNTERS}), set()),
    "half summary": (json.dumps({"viewer_hash": {"TOTAL_ROWS": 3}}), {("private", "viewer_hash")}),
    "fractions": (json.dumps({"viewer_hash": COUNTERS | {"INVALID": 0.0}}), {("private", "viewer_hash")}),
    "flags": (json.dumps({"viewer_hash": COUNTERS | {"INVALID": True}}), {("private", "viewer_hash")}),
    "empty": (json.dumps({"viewer_id": "", "author_id": None}), set()),
    "zero": (json.dumps({"viewer_id": 0, "user_key": False, "author_id": []}), {("private", "viewer_id"), ("private", "user_key"), ("private", "author_id")}),
    "person": (json.dumps([{"x": {"channel_url": "u", "display_name": "n"}}]), {("person", "channel_url")}),
    "creator": (json.dumps({"channel_url": "u", "display_name": "n", "vtuber_channel_id": "UC"}), set()),
    "nameless": (json.dumps({"channel_url": "u", "display_name": ""}), set()),
    "text in text": (json.dumps({"p": json.dumps([json.dumps({"user_key": ["k"]})])}), {("private", "user_key")}),
    "secret key": (json.dumps({"A": [{"Password": "x"}]}), {("secret", "Password")}),
    "secret shape": (json.dumps({"A": [KEY]}), {("secret", "")}),
    "secret in prose": (f"use {KEY} here", {("secret", "")}),
    "deep": (json.dumps(nested(100, {"viewer_id": "u", "b": KEY})), {("private", "viewer_id"), ("secret", "")}),
    "deep clean": (json.dumps(nested(101, {"viewer": "u"})), set()),
    "scalar": ("5", set()), "list": ("[]", set()), "blank": ("", set()), "null": (None, set()),
}


def test_findings(spark):
    records = spark.createDataFrame([(k, t, "other") for k, (t, _) in CASES.items()], "name string, body string, id string")
    found = {k: set() for k in CASES}
    for r in policy.findings(records, "name", "body").collect():
        assert (r.rule, r.key) not in found[r.id]
        found[r.id].add((r.rule, r.key))
    assert found == {k: want for k, (_, want) in CASES.items()}
    assert {r.id for r in policy.unreadable(records, "name", "body").collect()} == {"placeholder"}


def test_no_records(spark):
    assert policy.findings(spark.createDataFrame([], "name string, body string"), "name", "body").collect() == []


@pytest.fixture
def folder(tmp_path):
    def put(name, data):
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("clean.json", json.dumps({"channel": "UC1", "shared": 4}))
    put("private.json", json.dumps({"rows": [{"viewer_id": "u1"}]}))
    put("secret.json", json.dumps({"api_key": "x", "viewer_id": "u"}))
    put("broken.json", '{"viewer_id": "u"')
    put("a/lines.jsonl", '{"x": 1}\n\n{"viewer_hash": "u"}\n')
    put("a/broken.jsonl", '{"viewer_hash": "u"}\nno json\n')
    put("table.csv", '﻿name,viewer_id\n"one, two",u1\n')
    put("public.csv", 'name,viewer_id\n"one\ntwo",\n')
    put("notes.txt", "a column viewer_hash: described here")
    put("page.html", "var x = {'viewer_hash': '" + "ab" * 32 + "'}")
    put("key.log", f"x {KEY}")
    put("binary.bin", b"\xff\xfe\x00 viewer")
    pd.DataFrame({"viewer_id": ["u1", None], "n": [1, 2]}).to_parquet(tmp_path / "files" / "rows.parquet")
    pd.DataFrame({"channel": ["c"], "t": [pd.Timestamp("2024-01-01")], "note": [KEY]}).to_parquet(tmp_path / "files" / "named.data")
    sqlite3.connect(tmp_path / "files" / "store.db").execute("CREATE TABLE t (viewer_id)").connection.commit()
    return str(tmp_path / "files")


def test_files(spark, folder):
    found = {r.path.rpartition("files/")[2]: (r.format, r["class"], r.readable) for r in policy.inspect_files(spark, folder).collect()}
    public, private, secret = "PUBLIC_RESEARCH_DATA", "PRIVATE_DATA", "SECRET_CREDENTIAL"
    assert found == {
        "clean.json": ("json", public, True), "private.json": ("json", private, True), "secret.json": ("json", secret, True), "broken.json": ("json", public, False),
        "a/lines.jsonl": ("jsonl", private, True), "a/broken.jsonl": ("jsonl", public, False), "table.csv": ("csv", private, True), "public.csv": ("csv", public, True),
        "notes.txt": ("text", public, True), "page.html": ("text", private, True), "key.log": ("text", secret, True), "binary.bin": ("text", public, True),
        "rows.parquet": ("parquet", private, True), "named.data": ("parquet", secret, True), "store.db": ("database", public, False),
    }
