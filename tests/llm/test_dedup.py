from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import arrowtext as at
from strataweave.llm import exact_dedup, line_dedup, near_dedup
from strataweave.llm.components import components
from strataweave.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = {d: shingle_set(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(frame, corpus, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame, width=width).collect()}
    assert got == brute_components([(r[0], r[1]) for r in corpus], width, 80)


def test_near_duplicates_in_several_chunks(frame, corpus, monkeypatch):
    """Zones larger than a chunk lose no link: dealings, then the rest against all rows."""
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, width=2).collect()}
    assert got == {d: c for d, (_, c, _) in brute_components([(r[0], r[1]) for r in corpus], 2, 80).items()}


def test_prefixes_and_adaptive_depth():
    """Prefix lengths are those of the hash sequences; small regions meet in full, dense ones part deeper, and cuts keep neighbours."""
    rng = random.Random(9)
    n = near_dedup.DEEPEST
    rows = sorted([rng.randrange(4) for _ in range(3)] + [rng.randrange(2) for _ in range(n - 3)] for _ in range(400))
    region = np.array([at.mix64(np.array([r[0] * 16 + r[1] * 4 + r[2]], np.uint64))[0] for r in rows])
    order = np.argsort(region, kind="stable")
    rows, region = [rows[k] for k in order], region[order]
    rest = np.array([sum(np.uint64(x) << np.uint64(16 * (n - 4 - k)) for k, x in enumerate(r[3:])) for r in rows], np.uint64).view(np.int64)
    same = lambda a, b: next((k for k in range(n) if a[k] != b[k]), n)
    want = [k if k >= 3 else 0 for k in map(same, rows, rows[1:])]
    lcp = near_dedup.prefix_lengths(region, rest)
    assert lcp.tolist() == want and set(want) > {0, 3, 7}
    reach = near_dedup.reaches(lcp)
    for i, r in enumerate(rows):
        for depth in range(3, n + 1):
            mates = [j for j in range(len(rows)) if rows[j][:depth] == r[:depth]]
            if len(mates) <= near_dedup.REGION:
                assert reach[i] >= mates[-1] - i
                break
        if i + 1 < len(rows) and lcp[i]:
            assert reach[i] >= 1


@pytest.mark.parametrize("partitions", [1, 200])
def test_few_documents_over_many_partitions(spark, partitions):
    """Three documents find each other however many shuffle partitions there are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        text = " ".join(f"w{k}" for k in range(60))
        df = spark.createDataFrame([(3, text), (5, text + " more"), (9, text + " other"), (11, "something else")], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
        assert got == {3: 3, 5: 3, 9: 3, 11: 11}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_duplicates_of_nothing_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "a b c"), (9, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, schema), width=2).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (None, 5, True)], key=str)


def test_word_hashes_do_not_depend_on_the_slice():
    texts = ["a b", "x" * 9000 + " b", "", "B  a\n"]
    raw, off = at.utf8(pa.array(texts))
    whole, mark = at.words(raw, off)
    for i, t in enumerate(texts):
        own, _ = at.words(*at.utf8(pa.array([t])))
        assert (whole[mark[i] : mark[i + 1]] == own).all()
    assert whole[0] == whole[mark[3] + 1] and whole[1] == whole[mark[3]]
    assert list(at.slices(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("per_task", [10**6, 25])
def test_components(spark, per_task):
    rng = random.Random(2)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(80)] + [(100 + i, 101 + i) for i in range(30)]
    link = defaultdict(set)
    for a, b in pairs:
        link[a].add(b)
        link[b].add(a)
    want = {}
    for s in link:
        seen, todo = {s}, [s]
        while todo:
            for y in link[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if len(seen) > 1:
            want[s] = min(seen)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long"), Workspace(spark), "t", per_task).collect()}
    assert got == want


def brute_exact(rows):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    groups = defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    return {d: (min(groups[t]), len(groups[t]), min(groups[t]) == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_duplicates(frame, corpus, digest_hex):
    """One hex digit makes digests collide; bytes then decide."""
    out = exact_dedup.exact_duplicates(frame, digest_hex=digest_hex)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()} == brute_exact([(r[0], r[1]) for r in corpus])


def test_exact_duplicates_of_nothing_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, "a  b"), (3, "a b"), (None, "a b"), (4, "c"), (None, "d")]
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, schema)).collect()], key=str)
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (4, 4, 1, True), (None, None, 1, True)], key=str)


def test_exact_plan_is_native(frame):
    plan = exact_dedup.exact_duplicates(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line number {k} that is long enough" for k in range(12)] + ["short", "", "  LINE NUMBER 3 that is long enough\t", "é" * 19, "é" * 20, "z" * 9000]
    rows = [(k * 2, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(40)] + [(200, None), (201, ""), (202, "\n\n")]
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    want = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != d)]
        want[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"drop": F.lit(1), "n_lines": F.lit("clash"), "place": F.lit(2)}).repartition(6)
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "drop", "place", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text) for r in out.collect()} == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("fan", [2, 3])
def test_digest_index_levels(spark, fan):
    """Five memtables, two levels or more: least ids and counts survive merges, filters lose nothing, probes find what is held."""
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(40)}".encode(), rng.randrange(1000) if rng.random() < 0.9 else None) for _ in range(300)]
    index = exact_dedup.DigestIndex(Workspace(spark), buckets=3, fan=fan)
    for k in range(5):
        index.flush(spark.createDataFrame(rows[60 * k : 60 * k + 60], "digest binary, id long"))
    assert max(r.level for r in index.runs()) >= 1 and len(index.runs()) < 5
    want = {}
    for d, i in rows:
        old = want.get(d, (None, 0))
        want[d] = (min((x for x in (old[0], i) if x is not None), default=None), old[1] + 1)
    asked = spark.createDataFrame([(d,) for d in [*want, b"absent", b"d7"]], "digest binary")
    assert {bytes(r.digest): (r.id, r.n) for r in index.probe(asked).collect()} == want
    merged = index.compact()
    assert index.runs() == [merged] and {bytes(r.digest): (r.id, r.n) for r in merged.rows.collect()} == want
    assert index.screen(asked, merged).count() >= len(want)
    some = spark.createDataFrame([(f"other{k}".encode(),) for k in range(2000)], "digest binary")
    assert index.screen(some, merged).count() < 40
    for run_file in merged.rows.select("digest", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("digest").alias("d")).collect():
        assert [bytes(x) for x in run_file.d] == sorted(bytes(x) for x in run_file.d)
    index.drop()


def test_exact_duplicates_of_one_hot_text(spark):
    """Half of all rows are one text, some under the same id; a long text and its copy differ in one byte from a third."""
    long_ = "ab " * 200_000
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot  text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    df = df.unionByName(spark.createDataFrame([(900, long_), (901, long_.replace(" ", "\n")), (902, long_ + "c"), (2, "hot text")], "doc_id long, text string")).withColumns({"sha": F.lit(1), "body": F.lit(2), "n": F.lit(3)})
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()]
    got = {r[0]: r[1:] for r in rows}
    assert len(rows) == 404 and got[2] == (0, 201, False) and got[0] == (0, 201, True) and got[3] == (3, 1, True)
    assert got[901] == (900, 2, False) and got[902] == (902, 1, True)
