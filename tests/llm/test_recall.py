"""Recall of near-duplicate classes: every row whose id is divisible by 50 against all rows.

On a larger folder: RECALL_FOLDER=/path/to/tables python -m pytest tests/llm/test_recall.py -s
"""

import os
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest

from crowdweave.llm import near_dup

FOLDER = os.environ.get("RECALL_FOLDER", "/root/testdata/sf0.01")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sequence(text):
    """Five-word shingles, each with how many equal ones come before it."""
    words, seen, out = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), Counter(), []
    for i in range(len(words) - 4):
        k = tuple(words[i : i + 5])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def aligned(a, b):
    place = {x: i for i, x in enumerate(b)}
    tails = []
    for x in (place[k] for k in a if k in place):
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: sequence(r.text) for r in docs.select("doc_id", "text").collect()}
    classes = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    holders = defaultdict(set)
    for i, s in texts.items():
        for k in set(s):
            holders[k].add(i)
    links = found = 0
    for q in (i for i in texts if i % 50 == 0):
        shared = Counter(j for k in set(texts[q]) for j in holders[k] if j != q)
        for j, n in shared.items():
            if n >= 0.8 * (len(texts[q]) + len(texts[j]) - n) - 1e-9:
                m = aligned(texts[q], texts[j])
                if m >= 0.8 * (len(texts[q]) + len(texts[j]) - m) - 1e-9:
                    links += 1
                    found += classes[q] == classes[j]
    print(f"links {links}, in one class {found}")
    assert found >= 0.9 * links
