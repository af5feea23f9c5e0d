"""The training-data operators against plain versions, on small tables and awkward rows."""

import hashlib
import math
import os
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdweave.llm import chat, ctw, fingerprint, graph, html_text, line_dedup, mixing, near_dup, packing, quality, substring_dedup
from crowdweave.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, kept string, block int"

LONG = " ".join(f"word{i * 7919 % 997}" for i in range(700))
PROSE = " ".join(f"alpha{i} beta{i * 3} gamma" for i in range(60))
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, PROSE), (6, PROSE), (7, PROSE.replace("gamma", "Gamma", 1)), (8, LONG), (9, LONG + " tail"),
    (10, "a" * 3000), (11, "é ﬁ Ａ\u00a0x"), (12, "line that many pages share, footer\nown line number twelve here"), (13, "line that many pages share, footer"),
    (14, PROSE + "\n" + PROSE), (15, "\n".join(["same line here is repeated"] * 40)), (16, "x\x00y z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "k", "k", 1) for i, t in AWKWARD]
    return spark.createDataFrame([*rows, rows[4]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(params=["awkward", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return WORD.findall(text)


OPERATORS = [
    ctw.scores, fingerprint.fingerprints, line_dedup.line_dedup, line_dedup.deduplicated, mixing.schedule, mixing.mixed, near_dup.classes, near_dup.one_of_each,
    packing.pack_documents, quality.quality, quality.filter_kept, substring_dedup.remove_repeats,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f"{f.__module__.rpartition('.')[2]}.{f.__name__}")
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f"{f.__module__.rpartition('.')[2]}.{f.__name__}")
def test_nulls_in_all_columns(spark, operator):
    rows = spark.createDataFrame([(None,) * 8, (None,) * 8, (1, "one text", *[None] * 6)], DOCS)
    found = operator(rows).collect()
    # every row has its result; the two null rows are copies of each other, and all are too short for the quality rules
    assert len(found) == {"one_of_each": 2, "filter_kept": 0}.get(operator.__name__, 3)


def test_scores(docs):
    rows = texts(docs)
    tokens = [(i, [*words(t.translate(LOWER)), None]) for i, t in rows]
    counts = Counter(x for i, t in tokens if zlib.crc32(str(i).encode()) % 7 != 2 for x in t)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((i, zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 5)) for i, t in tokens)
    found = ctw.scores(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    assert all(r.score < 0 for r in found)


def brute_tree(train, text, depth):
    """Probability of a text by the same mixture, node by node."""
    counts = defaultdict(lambda: [0, 0])
    for t in train:
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[s[i - d : i], bit, s[i] >> (8 - bit)][s[i] >> (7 - bit) & 1] += 1

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    children = defaultdict(set)
    for c, bit, p in counts:
        if c:
            children[c[1:], bit, p].add((c, bit, p))
    weights = {}

    def weighted(node):
        if node not in weights:
            own = kt(*counts[node])
            inner = sum(weighted(k) for k in children[node])
            weights[node] = own if len(node[0]) == depth else np.logaddexp(own, inner) - math.log(2)
        return weights[node]

    total, s = 0.0, b"\xff" * depth + text + b"\xff"
    for i in range(depth, len(s)):
        for bit in range(8):
            q = None
            for d in range(depth, -1, -1):
                node = (s[i - d : i], bit, s[i] >> (8 - bit))
                if node not in counts:
                    continue
                z, o = counts[node]
                own = ((o if s[i] >> (7 - bit) & 1 else z) + 0.5) / (z + o + 1)
                if q is None:
                    q = own
                else:
                    share = 1 / (1 + math.exp(min(700, sum(weighted(k) for k in children[node]) - kt(z, o))))
                    q = share * own + (1 - share) * q
            total += math.log10(0.5 if q is None else q)
    return total


def test_scores_against_a_plain_tree(spark):
    data = [(i, t) for i, t in enumerate(["the cat sat", "the mat sat", "a cat", "on the mat", "The Cat sat on", "xyz", "", "the cat  sat\n"])]
    found = {r.doc_id: r.score for r in ctw.scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    coded = {i: " ".join(words(t.translate(LOWER))).encode() for i, t in data}
    train = [coded[i] for i in coded if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, t in coded.items():
        assert found[i] == pytest.approx(brute_tree(train, t, ctw.DEPTH), rel=1e-4)


def test_scores_do_not_depend_on_the_blocks(spark, documents):
    few = {r.doc_id: r for r in ctw.scores(documents).collect()}
    many = {r.doc_id: r for r in ctw.scores(documents, block_bytes=20_000).collect()}
    assert few.keys() == many.keys()
    assert all(a.n_known == many[i].n_known and a.score == pytest.approx(many[i].score, rel=1e-6) for i, a in few.items())


def test_line_dedup(docs):
    rows = docs.collect()
    sites, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for i, line in enumerate((r.text or "").split("\n")):
            if k := line.strip(" "):
                sites[k].add(r.source or "")
                first.setdefault(k, (r.doc_id, i))
    for least in (2, 3):
        expected = []
        for r in rows:
            lines = [] if r.text is None else r.text.split("\n")
            keep = [x for i, x in enumerate(lines) if not (k := x.strip(" ")) or len(sites[k]) < least or first[k] == (r.doc_id, i)]
            expected.append((r.doc_id, len(lines), len(lines) - len(keep), None if r.text is None else "\n".join(keep)))
        found = line_dedup.line_dedup(docs, min_sites=least).select("row.doc_id", "n_lines", "n_removed", "row.text").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert line_dedup.deduplicated(docs).columns == docs.columns


def test_sketches_far_above_the_threshold(spark):
    rows = [(i, "a very common line of text\nunique line number " + str(i), f"site{i}") for i in range(300)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=250)
    assert sorted(r.n_removed for r in found.collect()) == [0] + [1] * 299


def test_short_boilerplate_goes_in_the_pipeline(spark):
    import corpus_pipeline

    rows = [(i, f"And x.\n \n\nown line number {i}\n only nine " if i < 9 else f"And x.\nown {i}", f"site{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, docs, FOLDER).collect()}
    assert found == {i: t if i == 0 else t.removeprefix("And x.\n") for i, t, _ in rows}


def deviation(rows, share):
    """Greatest distance, in blocks, of a source from its share at any slot while all sources last."""
    slots = {r.slot: r.source for r in rows}
    last = min(max(r.slot for r in rows if r.source == s) for s in share)
    done, worst = Counter(), 0.0
    for t in range(last):
        done[slots.get(t)] += 1
        worst = max(worst, *(abs(done[s] - share[s] * (t + 1)) for s in share))
    return worst


def test_mixing_stays_within_a_block(spark):
    sizes = {"big": 600, "mid": 150, "small": 90, None: 60}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)], "doc_id long, source string")
    found = mixing.schedule(docs, {"big": 0.5, "mid": 0.3, "small": 0.15, None: 0.05}, block_docs=1, resolution=100).collect()
    assert len(found) == len(rows) and len({r.slot for r in found}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in found)
    assert deviation(found, {"big": 0.5, "mid": 0.3, "small": 0.15, None: 0.05}) < 1


def test_mixing_keeps_true_weights_over_many_periods(spark):
    sizes = {"a": 90_000, "b": 5_003, "c": 777, "d": 11}
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    total = sum(math.sqrt(n) for n in sizes.values())
    share = {s: math.sqrt(n) / total for s, n in sizes.items()}
    rows = mixing.schedule(docs, block_docs=1).collect()
    assert len({r.slot for r in rows}) == len(rows)
    for r in rows:
        assert math.floor(r.block / share[r.source] - 1e-6) <= r.slot < math.ceil((r.block + 1) / share[r.source] + 1e-6)
    weights = {"a": 0.99999, "b": 0.00001}
    two = mixing.schedule(docs.where("source in ('a', 'b')").where("source = 'a' or doc_id % 1000 = 0"), weights, block_docs=1).collect()
    assert all(r.block * 100_000 <= r.slot < (r.block + 1) * 100_000 for r in two if r.source == "b")


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 0.7, "b": 0.29999, "c": 0.00001}, {"a": 5, "b": 0, "c": 2.5}, None])
def test_mixing_is_earliest_deadline_first(spark, monkeypatch, weights):
    from fractions import Fraction

    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0 if weights else mixing.MOST_BROADCAST)
    sizes = {"a": 70, "b": 31, "c": 9}
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    exact = {s: Fraction(repr(float((weights or {s: n**0.5 for s, n in sizes.items()})[s]))) for s, n in sizes.items()}
    total, done, slot, expected = sum(exact.values()), Counter(), 0, {}
    while any(done[s] < n and exact[s] for s, n in sizes.items()):
        free = [(math.ceil((done[s] + 1) * total / exact[s]), s) for s, n in sizes.items() if exact[s] and done[s] < n and math.floor(done[s] * total / exact[s]) <= slot]
        if free:
            due, s = min(free)
            expected[s, done[s]] = slot
            done[s] += 1
        slot += 1
    found = {(r.source, r.block): r.slot for r in mixing.schedule(docs, weights, block_docs=1).collect()}
    assert {k: v for k, v in found.items() if exact[k[0]]} == expected and len(found) == len(set(found.values())) == 110


def test_mixing_keeps_every_row(docs):
    found = mixing.schedule(docs, block_docs=2).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs.collect())
    blocks = defaultdict(set)
    for r in found:
        blocks[r.slot].add((r.source, r.block))
    assert all(len(b) == 1 for b in blocks.values())
    mixed = mixing.mixed(docs, block_docs=2)
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, docs.collect()))


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def test_fingerprints(docs):
    distinct = docs.dropDuplicates(["doc_id"])
    rows = sorted(texts(distinct))
    found = {r.doc_id: r for r in fingerprint.fingerprints(distinct).collect()}
    first, prints = {}, {}
    for i, t in rows:
        first.setdefault(canonical(t), i)
    for k, (i, t) in enumerate(rows):
        after, half, r = rows[(k + 1) % len(rows)][1], len(t) // 2, found[i]
        edited = t[: len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.class_id == first[canonical(t)] and prints.setdefault(canonical(t), r.fingerprint) == r.fingerprint
        assert r.near_next == (canonical(t) == canonical(after)) and r.near_edited == (canonical(t) == canonical(edited))
        assert (r.fingerprint == r.edited_fingerprint) == (canonical(t) == canonical(edited))
    assert len(set(prints.values())) == len(prints)


def test_equal_digests_are_told_apart_by_bytes(spark):
    rows = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "d", "x"), (4, "e", "z")], "id long, digest string, canon string")
    found = fingerprint.exact_classes(rows).collect()
    assert sorted((r.digest, r.class_id, r.copies, r.sha is not None) for r in found) == [("d", 1, 2, True), ("d", 2, 1, True), ("e", 4, 1, False)]


def test_an_edited_text_that_meets_a_digest_is_told_apart(spark):
    known = spark.createDataFrame([("d", None, 1, 2, "aa"), ("e", "bb", 3, 1, "bb"), ("e", "cc", 4, 1, "cc")], "digest string, sha string, class_id long, copies long, canon_sha string")
    fields = "id long, n_chars long, edited_sha256 string, digest string, canon_sha string, edited_digest string, edited_canon_sha string, near_edited double, near_next double"
    rows = [(1, "d", "aa", "d", "aa"), (2, "d", "aa", "d", "zz"), (3, "e", "bb", "x", "yy"), (4, "e", "cc", "e", "cc")]
    light = spark.createDataFrame([(i, 1, "", d, s, e, t, 0.0, 0.0) for i, d, s, e, t in rows], fields)
    found = {r.id: (r.fingerprint, r.edited_fingerprint) for r in fingerprint.named(light, known).collect()}
    assert found == {1: ("d", "d"), 2: ("d", "d-zz"), 3: ("e-bb", "x"), 4: ("e-cc", "e-cc")}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_next_documents_by_ids_of_any_kind(spark, kind):
    ids = [f"k{i:03}" if kind == "string" else 2**60 + i for i in range(90)] + [None]
    rows = spark.createDataFrame([(x, f"text {x}", "d") for x in ids], f"id {kind}, text string, digest string").repartition(5)
    found = {r.id: r.next_text for r in fingerprint.neighbours(rows).collect()}
    order = [None, *ids[:-1]]
    assert found == {x: f"text {order[(i + 1) % len(order)]}" for i, x in enumerate(order)}


def test_next_documents_where_one_id_repeats(spark):
    rows = spark.createDataFrame([(i if i % 3 else 7, f"text {i}", "d") for i in range(120)], "id long, text string, digest string")
    hashed = rows.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(hashed, key=lambda r: (r.id, r.h))
    expected = {r.text: order[(i + 1) % len(order)].text for i, r in enumerate(order)}
    assert {r.text: r.next_text for r in fingerprint.neighbours(rows).collect()} == expected


def test_repeated_substrings(docs):
    rows = texts(docs)
    coded = [(i, t.encode()) for i, t in rows]
    n = substring_dedup.LENGTH
    counts = Counter(b[k : k + n] for _, b in coded for k in range(len(b) - n + 1))
    expected = []
    for i, b in coded:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if counts[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        expected.append((i, len(b), sum(gone), len([1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])]), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == sorted(expected)


def sequence(text):
    w, seen, out = words(text.translate(LOWER)), Counter(), []
    for k in range(len(w) - 4):
        s = tuple(w[k : k + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_removed(texts):
    """Per text: bytes covered by a 200-byte string that starts anywhere else too."""
    data = [t.encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_a_passage_in_every_document(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK", 4000)
    draw = np.random.default_rng(1)
    noise = ["".join(map(chr, draw.integers(97, 123, 900))) for _ in range(41)]
    passage = noise[40][:450]
    rows = [(k, noise[k][: 300 + k] + passage[k % 7 :] + noise[k][300 + k :]) for k in range(40)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(plain_removed([t for _, t in rows])))


def test_long_rows_are_parsed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    draw = np.random.default_rng(2)
    long = "".join(map(chr, draw.integers(97, 123, 9000)))
    rows = [long, "x" * 77 + long[1500:4200] + "y", "a" * 2500, long[:250]]
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(plain_removed(rows)))


def test_parsing_and_hashing_hold_little_memory():
    """What numpy holds at most while 12 MB are parsed and 3 MB of words are hashed."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(5)
    texts = [bytes(draw.integers(97, 123, 12_000, np.uint8)).decode() for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["id", "text"])
    words = [t[:300].encode() for t in texts for _ in range(10)]
    n = len(words)
    sent = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(range(n)), pa.array([1] * n, pa.int8()), pa.array(words)], names=["block", "first", "weight", "bytes"])
    for run, rows in ((substring_dedup._parse(pa.int64()), batch), (substring_dedup._hash, sent)):
        tracemalloc.start()
        found = sum(x.num_rows for x in run(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found > n and peak < 80e6


def test_ranks_are_the_order_of_bytes():
    draw = np.random.default_rng(4)
    data = np.concatenate([draw.integers(0, 2, 900), np.full(700, 255), draw.integers(0, 256, 400)] * 2).astype(np.uint8)
    at = np.arange(len(data) - 199)
    strings = [data[a : a + 200].tobytes() for a in at]
    order = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert substring_dedup.ranks(data, at).tolist() == [order[x] for x in strings]


def test_near_duplicates(docs):
    rows = texts(docs)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, tuple(words(t.translate(LOWER))), sequence(t)) for i, t in rows]
    for k, (i, w, s) in enumerate(items):
        for j, x, u in items[:k]:
            shared = len(set(s) & set(u))
            alike = w == x
            if not alike and shared and shared >= 0.8 * (len(s) + len(u) - shared) - 1e-9:
                m = longest(s, u)
                alike = m >= 0.8 * (len(s) + len(u) - m) - 1e-9
            if alike:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = near_dup.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == sorted((i, root(i)) for i, _ in rows)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i, _ in rows})


def test_alignment_within_the_band():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a = draw.permutation(60).astype(np.uint32)
        b = np.delete(a, draw.integers(0, 60, draw.integers(0, 8)))
        if draw.random() < 0.5:
            i, j = draw.integers(0, len(b), 2)
            b[i], b[j] = b[j], b[i]
        m = longest(a.tolist(), b.tolist())
        assert near_dup.similar(a, b) == (m >= 0.8 * (len(a) + len(b) - m) - 1e-9)


def test_groups_of_copies_that_only_the_original_joins(spark):
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        copy = list(base)
        for e in range(1 + k % 3):
            copy[(k * 37 + e * 50) % 150] = f"new{k}x{e}"
        rows.append((k, " ".join(copy)))
    found = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0}


def test_unlike_texts_whose_polynomial_hashes_collide_both_stay(spark):
    """Two words in Thue-Morse order, and with the words exchanged: any polynomial hash modulo 2**64 is equal."""
    order = [bin(k).count("1") % 2 for k in range(1024)]
    rows = [(n, " ".join("ab"[bit ^ n] for bit in order)) for n in range(2)] + [(2, " ".join("ab"[bit] for bit in order).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dup.classes(docs).collect()} == {(0, 0), (1, 1), (2, 0)}
    assert {r.doc_id for r in near_dup.one_of_each(docs).collect()} == {0, 1}


def members(spark, count, components):
    """A bucket whose members could all be alike: vertices 0 to count - 1, dealt over components."""
    rows = [(7, v, 100, 100, v % components, [-1] * (near_dup.MASK_BITS // 64), 0) for v in range(count)]
    return spark.createDataFrame(rows, "bucket long, vertex long, n int, c int, component long, mask array<bigint>, over int")


@pytest.mark.parametrize(("count", "components", "most"), [(40, 40, 16), (60, 3, 50), (30, 30, 1), (25, 2, 1 << 20)])
def test_the_slots_of_a_bucket_hold_every_pair_once(spark, monkeypatch, count, components, most):
    monkeypatch.setattr(near_dup, "PAIRS", most)
    mixed = near_dup._mixed(members(spark, count, components))
    found = near_dup._across(mixed, 0.8).collect()
    assert len({frozenset((r.a, r.b)) for r in found}) == len(found) == sum(1 for a in range(count) for b in range(a) if a % components != b % components)


def test_a_bucket_of_single_components_is_copied_in_proportion_to_its_pairs(spark):
    count = 20_000
    part = spark.range(count).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("vertex"), F.col("id").alias("component"))
    mixed = near_dup._mixed(part)
    copies = mixed.agg(F.sum(F.when(~F.col("main"), F.col("wide"))) + F.sum("tall")).first()[0]
    assert copies <= 2 * count + count**2 / 400


def test_one_row_of_a_class_stays_where_ids_repeat(spark):
    near = PROSE.replace("gamma", "delta", 1)
    rows = [(3, PROSE), (5, near), (5, LONG), (5, LONG), (None, PROSE), (None, "other words of a text without id"), (7, LONG + " tail")]
    kept = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(3, PROSE), (5, LONG), (-1, "other words of a text without id")])


def test_roots(spark):
    parents = [(i, i + 1) for i in range(37)] + [(100, 101), (102, 101)]
    found = {r.vertex: r.root for r in graph.roots(spark.createDataFrame(parents, "vertex long, parent long")).collect()}
    assert found == {i: 37 for i in range(37)} | {100: 101, 102: 101}


def test_split_buckets_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(120):
        copy = list(base)
        for at in draw.integers(0, 200, k % 7):
            copy[at] = f"new{draw.integers(0, 40)}"
        rows.append((k, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.class_id) for r in near_dup.classes(table).collect()}
    monkeypatch.setattr(near_dup, "PAIRS", 10)
    assert {(r.doc_id, r.class_id) for r in near_dup.classes(table).collect()} == whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (105, 100), (7, 7)]
    found = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 105: 100}


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1>"
    "<p>First <b>bold</b>\n text.<br><p>Second&nbsp;one</p><div class='comments'><p>I think</p></div></article><script>var a='<p>no</p>'</script><footer>(c)</footer></body>"
)


def test_html(spark):
    plain_page = "<div id=menu>m</div><div><p>" + "Long text here. " * 20 + "</p><p>end</p></div><form>f</form><p>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", plain_page), (5, "u", "<article>x<div class=ad>never closed"), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = [(r.page_id, r.text) for r in html_text.extract(pages).collect()]
    assert sorted(found)[:2] == [(1, "Title & more\nFirst bold text.\nSecond one")] * 2
    assert dict(found)[2] == dict(found)[3] == ""
    assert dict(found)[4] == ("Long text here. " * 20).strip() + "\nend"
    assert dict(found)[5] == "x\nnever closed"
    assert all(r.n_chars == len(r.text) for r in html_text.extract(pages).collect())


BODY = "<p>" + "Long text of the page here. " * 20 + "</p><p>end</p>"


@pytest.mark.parametrize("page, expected", [
    ("<div class='content has-sidebar'>{}</div>", True), ("<div class='post no-comments'><article>{}</article></div>", True),
    ("<section id='related-article'><article>{}</article></section>", True), ("<div class='overflow-hidden' style='overflow:hidden'>{}</div>", True),
    ("<form action=x><div>{}</div></form>", True), ("<p>a<svg/>b</p><div>{}</div>", True), ("<iframe src=x /><div>{}</div>", True), ("<object><p>no end {}", True),
    ("<article><p>card one</p></article><div>{}</div><article><p>card two</p></article>", True), ("<div class='post-header'>{}</div>", True),
    ("<article><p>" + "words of the article " * 40 + "</p></article><div class='page-footer'>{}</div>", False), ("<article>text</article><div class='nav-main'>{}</div>", False),
    ("<article>text</article><div hidden>{}</div>", False), ("<article>text</article><div style='display: none'>{}</div>", False),
])
def test_html_containers(page, expected):
    assert (("Long text of the page here. " * 20).strip() + "\nend" in html_text.main_text(page.format(BODY))) == expected


def test_surges_by_definition():
    draw = np.random.default_rng(8)
    for _ in range(300):
        size = [int(x) for x in draw.choice([0, 0, 5, 30, 60, 200], draw.integers(0, 25))]
        block = [sum(size[i : i + html_text.WINDOW]) for i in range(len(size))]
        # a line is kept if some line at or before it surges and no block between them is empty
        expected = [any(block[s] >= html_text.SURGE and all(block[s : i + 1]) for s in range(i + 1)) for i in range(len(size))]
        assert html_text.surges(size) == expected


def test_html_of_a_very_long_page():
    page = "<div><article>" + "<p>some words</p>" * 60_000 + "</article></div><footer>x</footer>"
    assert html_text.main_text(page).count("\n") == 59_999


def test_html_on_awkward_tables(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<article>x</article>"), (1, "u", "<article>y</article>"), (1, "u", "<article>y</article>")]
    table = spark.createDataFrame([(*r, "kept", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract(table)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or -1, r.text, r.n_chars) for r in found.collect()) == [(-1, "x", 1), (1, "", 0), (1, "y", 1), (1, "y", 1), (2, "", 0)]
    assert html_text.extract(table.limit(0)).collect() == []


def test_chat(spark):
    nasty = ["plain", "", "a</turn>\nb", "### user: x</turn>\n", "\\", "\\n</turn>\n\\", "##\\#", "</turn>", "<\\/turn>\n", r"\### Assistant: </turn> ok", "日本\n###\\ x: y</turn>\n", None]
    roles = ["user", "assistant", "a: b", "x</turn>\n", None, ":", "role:"]
    rows = [(k % 5, k, r, t, "extra") for k, (r, t) in enumerate((r, t) for r in roles for t in nasty)] + [(9, 0, "assistant", "same", ""), (9, 0, "assistant", "same", ""), (None, 1, "user", "x", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    parsed = chat.read_back(chat.format_conversations(turns))
    source = defaultdict(list)
    for c, k, r, t, _ in rows:
        source[c].append((k, r or "", t or ""))
    for r in parsed.collect():
        # control strings stand at the turns' own ends and heads only
        assert r.formatted.count("</turn>") == len(r.turns) == len(re.findall("###", r.formatted))
        assert [(x.role, x.text) for x in r.turns] == [(a, b) for _, a, b in sorted(source[r.conv_id])]
        for m, (_, a, b) in zip(r.loss_mask, sorted(source[r.conv_id]), strict=True):
            assert (m is None) == (a != "assistant")
            if m:
                under, head = r.formatted[m.start : m.start + m.length], r.formatted[m.start - m.lead : m.start]
                assert under == b if head == "### assistant: " else (head == "###\\ assistant: " and re.sub(r"(?s)\\(.)", r"\1", under) == b)
    for r in chat.digest(parsed).collect():
        own = sorted(source[r.conv_id])
        loss = "".join(t for _, a, t in own if a == "assistant")
        assert r.round_trip and r.n_turns == len(own) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
    assert chat.digest(chat.read_back(chat.format_conversations(turns.where("false")))).count() == 0


def test_bands_are_those_of_labelled_texts(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    bands = {start: (low, high) for start, low, high in quality.BANDS}
    fitted = quality.fitted_bands(docs, labels)
    assert sum(n for *_, n in fitted) > 200
    for start, low, high, n in fitted:
        if n >= 40:  # the band holds what labelled texts need, and not much more
            assert bands[start][0] <= low <= bands[start][0] + 0.1 and bands[start][1] - 0.2 <= high <= bands[start][1]
    assert sum(n for *_, n in quality.fitted_bands(docs, labels, rows=50)) <= 50


@pytest.fixture(scope="module")
def very_long(spark):
    """A text of 2.4 MB, a near copy of it, and a short one."""
    draw = np.random.default_rng(12)
    long = "\n".join(" ".join(f"w{x}" for x in row) for row in draw.integers(0, 50_000, (26_000, 16)))
    return spark.createDataFrame([(1, long, "a"), (2, long + " tail", "b"), (3, "short text", "c")], "doc_id long, text string, source string").cache()


def test_very_long_texts(spark, very_long):
    own = {r.doc_id: r.text for r in very_long.collect()}
    words_of = {i: len(words(t)) for i, t in own.items()}
    assert {r.doc_id: r.n_tokens for r in ctw.scores(very_long).collect()} == {i: n + 1 for i, n in words_of.items()}
    prints = {r.doc_id: r for r in fingerprint.fingerprints(very_long).collect()}
    assert {i: r.n_chars for i, r in prints.items()} == {i: len(t) for i, t in own.items()} and len({r.fingerprint for r in prints.values()}) == 3
    half = len(own[1]) // 2
    edited = own[1][: len(own[1]) - half] + own[2][:half]
    assert prints[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_dedup(very_long, min_sites=2).select("row.doc_id", "n_lines", "n_removed").collect()} == {1: (26_000, 0), 2: (26_000, 25_999), 3: (1, 0)}
    judged = {r.doc_id: r for r in quality.quality(very_long).collect()}
    assert {i: r.n_words for i, r in judged.items()} == words_of and judged[1].chunks == -(-len(own[1]) // quality.CHUNK) - (0 < len(own[1]) % quality.CHUNK < quality.LEAST_CHUNK)
    assert {r.doc_id: r.class_id for r in near_dup.classes(very_long).collect()} == {1: 1, 2: 1, 3: 3}
    turns = very_long.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), F.concat("text", F.lit(" </turn> ###")).alias("text"))
    spoken = chat.digest(chat.read_back(chat.format_conversations(turns))).first()
    assert spoken.round_trip and spoken.loss_chars == sum(len(t) + len(" </turn> ###") for t in own.values())


def test_packing_of_very_long_texts(very_long, tokenizer):
    whole = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in very_long.collect()}
    found = packing.pack_documents(very_long).collect()
    assert {i: sum(r.length for r in found if r.doc_id == i) for i in whole} == whole
    assert sum(r.length < 2048 for r in found) <= 3 and len({r.sequence_id for r in found}) <= sum(whole.values()) // 2048 + 2


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(packing.vocabulary_path())


def test_packing(docs, tokenizer):
    expected, total = [], 0
    for i, t in texts(docs):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        head = len(ids) - 2048 * (-(-len(ids) // 2048) - 1)
        edges = [0, *range(head, len(ids) + 1, 2048)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    found = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.05 * total / 2048 + 1


def test_encoder_is_the_tokenizer(tokenizer):
    import random

    draw = random.Random(1)
    samples = ["".join(draw.choice("ab é\n\t .'s1 　漢<|") for _ in range(30)) for _ in range(1500)]
    samples += ["", " ", "a  b", "\n\nx", "<|endoftext|> hi", "a<|endoftext|>b \n", "x\r\ny", "\x1c a", "a\x85 b", "it's we'll  X"]
    ids, off = packing.Encoder(packing.vocabulary_path()).encode(samples)
    for s, a, b in zip(samples, off, off[1:], strict=False):
        assert ids[a:b].tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - x)
    return len(gaps)


def test_sweeps_are_best_fit():
    draw = np.random.default_rng(2)
    for _ in range(50):
        lengths = draw.integers(1, 101, draw.integers(1, 200)).tolist()
        runs, opened = packing.sweep(Counter(lengths), 100)
        assert opened == best_fit(lengths, 100)
        used = defaultdict(list)
        for length, _, n, first, offset in runs:
            for k in range(n):
                used[first + k].append((offset, length))
        assert sum(map(len, used.values())) == len(lengths)
        for s in used.values():
            end = 0
            for offset, length in sorted(s):
                assert offset == end
                end += length
            assert end <= 100


def test_parts_need_no_more_sequences_than_one_sweep(spark):
    draw = np.random.default_rng(6)
    lengths = np.minimum(2048, draw.lognormal(5.5, 1.2, 6000).astype(int) + 1).tolist()
    rows = [(k % 5000, 0, 0, n, k) for k, n in enumerate(lengths)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    found = packing.pack(packing.cut(table), part_rows=70).collect()
    assert sorted(r[:5] for r in found) == sorted(rows)
    used = defaultdict(list)
    for r in found:
        used[r.sequence_id].append((r.offset, r.length))
    for s in used.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(used) <= packing.sweep(Counter(lengths), 2048)[1] + 1


def test_quality(docs):
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    expected = []
    for i, t in texts(docs):
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and quality.verdict(t.encode(), compress)[0]
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, kept))
    found = quality.quality(docs).collect()
    assert sorted(tuple(r)[:8] for r in found) == sorted(expected)
    assert sorted(map(repr, quality.filter_kept(docs).collect())) == sorted(repr(r) for r in docs.collect() if (r.doc_id, True) in {(e[0], e[-1]) for e in expected})


def test_quality_where_hashes_agree(monkeypatch):
    """Counts hold when all hashes are equal, and for the texts on which sums of powers modulo 2**64 agree."""
    texts = ["a b c d e\nf g h\n\n x\ny", "a b c d\na b c\n a  b\tc\na b c", "p q r s t u v w", "", "k\nk\nk l m k l\nm"]
    even = "".join("ab"[k.bit_count() % 2] for k in range(1 << 12))
    swapped = even.translate(str.maketrans("ab", "ba"))
    texts.append(f"{even}\n{swapped}\n{even} x y\n{swapped} x y\n{even}")
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    expected = [quality._plain_repeats(t) for t in data]
    assert expected[1] == (1, 12) and expected[5][0] == 1

    def found():
        out = quality.base_counts(np.frombuffer(b"".join(data), np.uint8), off)
        return list(zip(out["n_dup_lines"].tolist(), out["n_repeat_words"].tolist(), strict=True))

    assert found() == expected
    monkeypatch.setattr(quality.B, "span_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    assert found() == expected


def test_quality_bands():
    import random

    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    draw = random.Random(4)
    parts = "an ba cor den el fi gor hu is jo ka lim mon ne or pul qui ros te um".split()
    prose = " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(900))
    assert quality.verdict(prose.encode(), compress)[0]
    assert not quality.verdict(("und " * 2000).encode(), compress)[0]
    assert not quality.verdict(bytes(draw.randrange(256) for _ in range(5000)), compress)[0]
    half = prose.encode() + b" the" * 4000
    assert not quality.verdict(half, compress)[0]


def test_pipeline(spark):
    import corpus_pipeline

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, FOLDER)
        assert after.columns == docs.columns, name
        step = spark.createDataFrame(after.collect(), docs.schema)
    good = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    left = {r.doc_id for r in step.collect()}
    assert left <= good and len(left) > 0.8 * len(good)
    found = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in found.collect()} == left


def plain_quality(rows):
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    kept = []
    for i, t, source in rows:
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for d in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and quality.verdict(t.encode(), compress)[0]:
            kept.append((i, t, source))
    return kept


def plain_lines(rows):
    sites, first = defaultdict(set), {}
    for i, t, source in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            if key := line.strip(" "):
                sites[key].add(source)
                first.setdefault(key, (i, k))
    wide = {key for key, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (key := x.strip(" ")) not in wide or first[key] == (i, k)), source) for i, t, source in rows]
    assert kept != rows
    return kept


def plain_leaders(rows):
    """The rows of lowest id of each class of near copies, over all pairs."""
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, tuple(words(t.translate(LOWER))), sequence(t)) for i, t, _ in rows]
    items = [(*item, set(item[2])) for item in items]
    for k, (i, w, s, x) in enumerate(items):
        for j, v, u, y in items[:k]:
            alike = w == v
            if not alike and x and 0.8 <= len(s) / max(len(u), 1) <= 1.25:
                shared = len(x & y)
                if shared >= 0.8 * (len(s) + len(u) - shared) - 1e-9:
                    m = longest(s, u)
                    alike = m >= 0.8 * (len(s) + len(u) - m) - 1e-9
            if alike:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [r for r in rows if root(r[0]) == r[0]]


def plain_ranges(rows, buckets):
    """The packing range of each row: blocks of a source in earliest-deadline order, numbered as they are placed."""
    import xxhash
    from fractions import Fraction

    def place(i):
        hashed = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
        return (hashed - (hashed >> 63 << 64)) % buckets, i

    own = defaultdict(list)
    for i, _, source in rows:
        own[source].append(i)
    share = {s: Fraction(repr(float(len(x)) ** mixing.FLATTEN)) for s, x in own.items()}
    total, size = sum(share.values()), mixing.BLOCK_DOCS
    left = {s: -(-len(x) // size) for s, x in own.items()}
    done, slot, order = Counter(), 0, []
    while any(done[s] < n for s, n in left.items()):
        free = [(math.ceil((done[s] + 1) * total / share[s]), s) for s, n in left.items() if done[s] < n and done[s] * total // share[s] <= slot]
        if free:
            s = min(free)[1]
            order.append((s, done[s]))
            done[s] += 1
        slot += 1
    turn = {b: k for k, b in enumerate(order)}
    return {i: turn[s, k // size] // packing.RANGE_BLOCKS for s, x in own.items() for k, i in enumerate(sorted(x, key=place))}


def test_pipeline_against_plain_stages(spark, tokenizer):
    """All five stages in plain Python, and the rows of run() beside them: the same pieces, in as many sequences."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = plain_leaders(plain_lines(plain_quality(rows)))
    ranges = plain_ranges(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    expected, lengths = [], defaultdict(list)
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        head = len(ids) - 2048 * (-(-len(ids) // 2048) - 1)
        edges = [0, *range(head, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            expected.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            lengths[ranges[i]].append(b - a)
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    first = 0
    for k in sorted(lengths):
        own = {r.sequence_id for r in found if ranges[r.doc_id] == k}
        assert own == set(range(first, first + best_fit(lengths[k], 2048)))
        first += len(own)
    for s in range(first):
        end = 0
        for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048


def test_pipeline_stages_on_awkward_rows(spark, docs):
    import corpus_pipeline

    for rows in (docs, docs.limit(0), docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, rows, FOLDER)
            if name != "best_fit_packing":
                assert found.columns == rows.columns and [f.dataType for f in found.schema] == [f.dataType for f in rows.schema]
            n, kept = rows.count(), found.count()
            assert {"quality_rules": kept <= n, "line_dedup": kept == n, "near_duplicates": (kept > 0) == (n > 0), "source_mixing": kept == n}.get(name, kept >= n)


def test_packed_sequences_follow_the_weights(spark):
    import corpus_pipeline

    sizes = {"a": (16_000, "one two three four five six seven"), "b": (4_000, "one two three"), "c": (1_000, "one")}
    rows = [(s, t) for s, (n, t) in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(k, t, "en", s, 0) for k, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(docs.limit(1))
    found = corpus_pipeline.best_fit_packing(spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.05 * sum(r.length for r in found) / 2048 + 21
    seen, total = Counter(), sum(math.sqrt(n) for n, _ in sizes.values())
    for k in range(len(sequences)):
        for own, r in enumerate(sorted(sequences[k], key=lambda r: r.offset)):
            assert r.offset == sum(x.length for x in sorted(sequences[k], key=lambda r: r.offset)[:own]) and r.offset + r.length <= 2048
            seen[rows[r.doc_id][0]] += 1
        if seen.total() < 6000:
            for s, (n, _) in sizes.items():
                assert abs(seen[s] - seen.total() * math.sqrt(n) / total) < packing.RANGE_BLOCKS * mixing.BLOCK_DOCS / 2


def test_packing_in_ranges_on_awkward_rows(docs):
    found = packing.pack_scheduled(docs, range_blocks=1).collect()
    plain = packing.pack_documents(docs).collect()
    assert sorted(r[:5] for r in found) == sorted(r[:5] for r in plain)
    assert packing.pack_scheduled(docs.limit(0)).count() == 0


def test_packing_takes_over_the_order_of_mixing(spark, tmp_path):
    """Weights and blocks of the stage before decide which sequences a source goes to; the same holds for a table in a reader's hands."""
    docs = spark.createDataFrame([(k, f"text {k}", "ab"[k % 2]) for k in range(4000)], "doc_id long, text string, source string")
    mixed = mixing.mixed(docs, {"a": 3, "b": 1}, block_docs=4)
    mixed.write.parquet(f"{tmp_path}/mixed")
    plan = {r.doc_id: (r.slot, r.place) for r in mixing.schedule(docs, {"a": 3, "b": 1}, block_docs=4).collect()}
    order = sorted(plan, key=plan.get)
    for table in (spark.read.parquet(f"{tmp_path}/mixed"), mixed):
        found = packing.pack_scheduled(table, range_blocks=50).collect()
        assert sorted(r.doc_id for r in found) == list(range(4000))
        sequences = defaultdict(set)
        for r in found:
            sequences[r.sequence_id].add(r.doc_id)
        at, k = 0, 0
        while at < 4000:  # ranges of 50 blocks of 4, one after the other
            own = set(order[at : at + 200])
            while own:
                assert sequences[k] <= own
                own, k = own - sequences[k], k + 1
            at += 200
        assert k == len(sequences)
    first = [d for k in range(len(sequences) // 4) for d in sequences[k]]
    assert abs(sum(d % 2 == 0 for d in first) / len(first) - 0.75) < 0.02


def test_turns_are_those_of_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 7)
    docs = spark.createDataFrame([(k, "", [None, "a", "b"][min(k % 5, 2)]) for k in range(333)], "doc_id long, text string, source string")
    rows = docs.select(F.col("doc_id").alias("id"), "source")
    expected = {r.id: r.turn for r in mixing.placed(rows).collect()}
    found, block_docs = mixing.located(docs)
    found = mixing.turns(found.withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1)))), block_docs).collect()
    assert Counter((r.doc_id, r.turn) for r in found) == Counter([*expected.items()] * 2)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_registered_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert registered.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = registered.QUERIES[name](spark, FOLDER)
    cursor = con.execute(registered.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, frame.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
