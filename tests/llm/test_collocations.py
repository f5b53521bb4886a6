from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strataweave.llm import collocations as co
from strataweave.llm.queries import op11_collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top, longest=3):
    count, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        rows_ = []
        big = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        for p, a in big.items():
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in big.items()):
                continue
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows_.sort()
        out += [(lang, i, p.decode(), -a, x, y, size[lang], -s) for i, (s, a, p, x, y) in enumerate(rows_[:top], 1)]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "x y", "#1"]
    rows = []
    for _ in range(300):
        n = rng.randrange(0, 60)
        words = [rng.choice(vocabulary[: rng.choice([3, 12, 43])]) for _ in range(n)]
        if rng.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = ["New", "york", "City"]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "!", " \x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", "fr"), ("...", "de"), ("one", None), ("a b. " * 3000, "de"), ("z " * 5000, "en"), ("q" * 9000, "en")]
    return rows


@pytest.mark.parametrize("least,top", [(10, 2000), (2, 7)])
def test_against_brute_force(spark, texts, least, top):
    df = spark.createDataFrame([(*r, 1, "p") for r in texts], "text string, lang string, n int, phrase string").repartition(5)
    got = [tuple(r) for r in co.collocations(df, least=least, top=top).collect()]
    assert sorted(got) == sorted(brute(texts, least, top)) and len(got) > 20


def test_query_takes_whole_tables(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, t struct<text:string,lang:string>").select("doc_id", "t.*").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_collocations(spark, str(tmp_path)).collect())) == sorted(brute(texts, 10, 2000))


def test_longer_phrases_and_held_counters_that_leave_early(spark, texts, monkeypatch):
    monkeypatch.setattr(co.at, "SLICE_BYTES", 700)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts]), pa.array([x or "und" for _, x in texts])], names=["text", "lang"])
    monkeypatch.setattr(co, "HELD", 50)
    monkeypatch.setattr(co, "BUCKETED", 500)
    out = pa.Table.from_batches(list(co._pass(1, False, 10, None, None)(iter([batch])))).to_pylist()
    want = Counter()
    for text, lang in texts:
        for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", (text or "").translate(UPPER)):
            want[lang or "und", w] += 1
    got = Counter()
    for r in out:
        if r["block"] is None:
            got[r["lang"], r["phrase"]] += r["n"]
    assert got == want
    df = spark.createDataFrame(texts, "text string, lang string")
    assert sorted(map(tuple, co.collocations(df, longest=4, least=3, top=500).collect())) == sorted(brute(texts, 3, 500, 4))


def test_bitmaps_admit_every_frequent_bucket(spark):
    rng = np.random.default_rng(1)
    places = rng.integers(0, 1 << 20, 40_000).astype(np.uint64)
    places[:30_000] = places[rng.integers(30_000, 40_000, 30_000)]
    parts = np.array_split(places, 7)
    rows = [r for p in parts for b in co._packed(p, 10) for r in b.to_pylist()]
    df = spark.createDataFrame([(r["block"], r["packed"]) for r in rows], "block int, packed binary")
    bits = co._broadcast_bits(df, 10).value
    value, count = np.unique(places, return_counts=True)
    assert (co._held(bits, value, high=False) == (count >= 10)).all() and (count >= 10).any()


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_counts_beyond_64_bits_are_exact(spark):
    row = spark.createDataFrame([(4_000_000_000_001, 5_000_000_000_003, 7_000_000_000_009)], "a long, l long, r long")
    from pyspark.sql import functions as F

    got = row.select(F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(30,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")).first()[0]
    assert got == 1000000 * 4_000_000_000_001**2 // (5_000_000_000_003 * 7_000_000_000_009)
