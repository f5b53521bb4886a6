from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from strataweave.llm import suffix_dedup as sd
from strataweave.llm.queries import op12_suffix_dedup


def brute(rows, length):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += 1
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, [0, *gone], strict=False))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage = [text(n) for n in (39, 40, 41, 60, 150)]
    out = []
    for d in range(120):
        t = text(rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(passage) + t[k:]
        out.append((d, t))
    base = text(400)
    for d in range(200, 230):
        w = list(base)
        for _ in range(d % 5):
            w[rng.randrange(len(w))] = "#"
        out.append((d, "".join(w)))
    out += [(300, None), (301, ""), (None, base), (None, base), (302, "x" * 500), (303, "y " * 300), (304, passage[4] + passage[4]), (305, out[0][1]), (305, out[0][1]), (306, out[3][1]), (307, "ab" * 19), (308, "éa" * 30)]
    return out


@pytest.mark.parametrize("prefix,block,batch_bytes,chunk", [(13, 8, 1 << 20, 1 << 20), (5, 4, 200, 1 << 20), (30, 16, 700, 128), (39, 20, 100, 64)])
def test_against_brute_force(spark, rows, prefix, block, batch_bytes, chunk):
    """One batch and many, whole texts and overlapping parts, different samples: the same bytes go."""
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, at int").repartition(7)
    got = sd.remove_repeats(df, length=40, prefix=prefix, block=block, batch_bytes=batch_bytes, chunk=chunk)
    assert result(got) == brute(rows, 40)


def test_parts_of_a_long_text_sample_what_the_whole_samples(rows):
    import pyarrow as pa

    raw = "".join(t or "" for _, t in rows)
    batch = pa.RecordBatch.from_arrays([pa.array([raw, "short", raw[:500]])], names=["text"])

    def starts(chunk):
        out = {}
        for _, _, p in sd._chunks(batch, sd.Shape(40, 13, 8, chunk)):
            for row, base, a, b, place, key in zip(p.row, p.base, p.first, p.last, p.place, p.key, strict=True):
                for i in range(a, b + 1):
                    assert (row, i + base) not in out
                    out[row, i + base] = (place + base, key)
        return out

    whole = starts(1 << 20)
    assert len(whole) == len(raw.encode()) - 39 + 500 + len(raw[:500].encode()) - 500 - 39
    assert starts(100) == whole == starts(701)


def test_query_and_spans(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["stone", "river", "cloud", "é"]) + str(rng.randrange(99)) for _ in range(n))
    passage = text(90)
    rows = [(d, text(60) + (passage if d % 3 == 0 else "") + text(60)) for d in range(30)] + [(90, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = op12_suffix_dedup(spark, str(tmp_path))
    assert result(got) == brute(rows, 400)
    assert {t.name for t in spark.catalog.listTables()} == before
    full = {r.doc_id: r for r in sd.remove_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    for d, t in rows:
        raw, r = (t or "").encode(), full[d]
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert len(r.kept) == len(raw) - r.n_removed and (d % 3 or not raw or r.n_removed >= len(passage.encode()))


def test_levels_grow_like_binary_numbers(spark):
    from strataweave.llm.workspace import Workspace

    family = sd.ArrayFamily(Workspace(spark), 2)
    try:
        for k in range(5):
            rows = [(0, k * 10 + i, k, k, 1, 1, 0, 1) for i in range(10)] + [(0, 999, k // 4, 0, 1, 1, 0, 1), (0, 500 + k % 2, 7, 7, 1, 1, 0, 1)]
            family.add(spark.createDataFrame(rows, sd._REGIONS))
        assert sorted(family.levels) == [0, 2]
        assert {(r.key, r.mixed) for r in family.found().collect()} == {(999, True), (500, False), (501, False)}
    finally:
        family.drop()


def test_empty_table_and_text_ids(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(spark.createDataFrame([("a", "q" * 450), ("b", "short")], "doc_id string, text string")).collect()}
    assert got == {"a": 450, "b": 0}
