"""Operator 13 against a document-by-document audit and against its SQL."""

import os
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from crowdweave.llm import audit
from crowdweave.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, part string, mask int, n int, cells string, id long, digest string, good int, quality int"
LABELS = "doc_id long, quality int, toxic int, id long, lang string, text string"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
PROSE = " ".join(f"word{i}" for i in range(120))


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Every document is sent through every order."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    failing = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        failing.append((lang or "", {x for x in fails if fails[x]}, i in good and i is not None, i in toxic and i is not None))
    found = defaultdict(lambda: dict.fromkeys(COLUMNS, 0))
    for order in permutations("ABCDE"):
        for part, fails, is_good, is_toxic in failing:
            gone = False
            for step, letter in enumerate(order, 1):
                row = found[part, "".join(order), step]
                here = letter in fails and not gone
                row["removed"] += here
                row["redundant"] += letter in fails and gone
                row["unique_fails"] += fails == {letter}
                row["good_lost"] += here and is_good
                row["toxic_lost"] += here and is_toxic
                gone = gone or here
                row["kept"] += not gone
    shapley = defaultdict(int)
    for (part, order, step), row in found.items():
        shapley[part, order[step - 1]] += row["removed"]
    for (part, order, step), row in found.items():
        row["shapley"] = shapley[part, order[step - 1]]
    return dict(found)


def collected(frame):
    rows = frame.collect()
    found = {(r.part, r.filter_order, r.step): {c: r[c] for c in COLUMNS} for r in rows}
    assert len(found) == len(rows)
    return found


AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, None, None), (4, " \n\t ", ""), (5, PROSE, "en"), (6, PROSE, "en"), (6, PROSE, "en"), (5, PROSE, "de"), (5, PROSE, "en"),
    (None, PROSE, "en"), (None, PROSE, "de"), (7, PROSE.upper(), "de"), (8, PROSE + " #", "de"), (9, "a b " * 60, "de"), (10, "É Ü x y " * 40, "fr"),
    (11, PROSE + " same same", "fr"), (12, PROSE + " word0" * 31, "fr"), (13, "AB" + "x" * 18, "fr"), (14, "AB" + "x" * 17, "fr"), (15, "x " * 99, "fr"),
    (16, " ".join(f"w{i % 80}" for i in range(100)), "fr"), (17, " ".join(f"w{i % 79}" for i in range(100)), "fr"), (18, "long " * 50_000, "es"),
    (2, "other text under an id that is there twice", "en"), (19, "a\x0bb\x1cc|", "es"),
]
MARKS = [(1, 1, 0), (5, 1, 1), (5, 0, 0), (6, None, 1), (None, 1, 1), (7, None, None), (9, 0, 1), (18, 1, 0), (18, 1, 0), (99, 1, 1)]


def frames(spark, docs, labels):
    docs = spark.createDataFrame([(i, t, p, "s", "x", 1, 2, "c", 3, "d", 4, 5) for i, t, p in docs], DOCS).repartition(3)
    return docs, spark.createDataFrame([(*row, 1, "x", "y") for row in labels], LABELS)


def test_awkward_rows(spark):
    assert collected(audit.filter_audit(*frames(spark, AWKWARD, MARKS))) == plain(AWKWARD, MARKS)


def test_without_labels_and_without_documents(spark):
    assert collected(audit.filter_audit(*frames(spark, AWKWARD[:8], []))) == plain(AWKWARD[:8], [])
    assert audit.filter_audit(*frames(spark, [], MARKS)).collect() == []


def test_nulls_in_all_columns(spark):
    docs, labels = spark.createDataFrame([(None,) * 12] * 2, DOCS), spark.createDataFrame([(None,) * 6], LABELS)
    assert collected(audit.filter_audit(docs, labels)) == plain([(None, None, None)] * 2, [])


def test_a_text_that_fills_the_table(spark):
    docs = [(i, PROSE if i % 3 else f"{PROSE} {i}", "en" if i % 2 else None) for i in range(600)]
    assert collected(audit.filter_audit(*frames(spark, docs, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 4)]))) == plain(
        docs, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 4)]
    )


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_and_its_sql(spark):
    found = collected(registered.QUERIES["op13_filter_audit"](spark, FOLDER))
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found == plain(docs, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    cursor = con.execute(registered.ORACLE_SQL["op13_filter_audit"])
    names = [d[0] for d in cursor.description]
    rows = [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
    assert {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in COLUMNS} for r in rows} == found
