from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from strataweave.llm import mixing


def brute_targets(sizes):
    """Water filling by hand: cap, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * sizes[s] < level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("bucket_rows", [2048, 3])
def test_mix(frame, corpus, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in corpus}
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + words[r[0]]
    rows = mixing.mix(frame).collect()
    assert {r.doc_id: r["size"] for r in rows} == words
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    largest = max(words.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in sizes)
    assert sum(sizes.values()) - largest <= sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(frame.repartition(3)).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_mix_of_nothing_and_repeats(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, " ", "t")], schema)).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) <= 4


def test_mix_is_native(frame):
    plan = mixing.mix(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_source_is_spread(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 6 for r in rows)


def brute_taken(rows, repeats=3):
    """(doc_id, source, size, draw) in: the fair queue by hand, copy by copy."""
    sizes, target, out = {}, {}, []
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    for s in sizes:
        before = 0
        queue = sorted([r for r in rows if r[1] == s], key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2]))
        for turn in range(repeats):
            for k, (d, _, n, h) in enumerate(queue):
                if n and before < target[s] + n:
                    out.append(((before + n) / target[s], s is not None, (s or "").encode(), h, d is not None, d or 0, k, turn, s, n))
                before += n
    spent, taken = 0, {}
    for c in sorted(out):
        spent += c[-1]
        if spent <= sum(sizes.values()):
            key = (c[5] if c[4] else None, c[8], c[3])
            taken[key] = taken.get(key, 0) + c[-1]
    return taken


@pytest.mark.parametrize("bucket_rows", [16_384, 5])
def test_taken_is_the_fair_queue_by_hand(spark, frame, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    extra = spark.createDataFrame([(None, "a b c " * k, src, "x") for k, src in ((1, "a"), (2, None), (3, "solo"), (3, "solo"))] + [(4001, "long " * 30_000, "big", "x")], "doc_id long, text string, source string, lang string")
    df = frame.select("doc_id", "text", "source", "lang").unionByName(extra)
    keyed = [tuple(r) for r in df.select("doc_id", "source", mixing.word_count(F.col("text")), F.xxhash64(F.lit(17), "doc_id", "text")).collect()]
    want, got = brute_taken(keyed), {}
    # A key gathers rows that are equal in id and text.
    for r in mixing.mix(df, carry=True).select("doc_id", "source", "taken", F.xxhash64(F.lit(17), "doc_id", "input.text").alias("h")).collect():
        got[r.doc_id, r.source, r.h] = got.get((r.doc_id, r.source, r.h), 0) + r.taken
    assert {k: v for k, v in got.items() if v} == want


def test_many_small_sources_do_not_meet_in_one_range(spark):
    """20,000 sources of one document each finish in ties at a third, two thirds and one: no task gets more than its share."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    assert mixing.mix(df).agg(F.sum("taken")).first()[0] == 60_000
    work = mixing.Workspace(spark)
    tied = df.select(F.lit(1.0).alias("finish"), "source", F.lit(3).alias("size"))
    summed = mixing.running(tied, 20 * 16_384, ["finish", "source"], {"spent": "size"}, work, "t")
    assert summed.agg(F.max("spent")).first()[0] == 3 * 19_999
    held = [r["count"] for r in spark.read.parquet(f"{work.base}/t-ranges").groupBy("_range").count().collect()]
    assert len(held) >= 15 and max(held) < 4000
