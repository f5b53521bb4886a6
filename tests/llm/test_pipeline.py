from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataweave.llm.queries import vocabulary_path
from strataweave.llm.workspace import Workspace


def representatives(rows):
    """Ids that stay, by comparing all pairs of texts."""
    sets = {}
    for d, text in rows:
        w = [x.lower() for x in (text or "").split()]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {d: d for d in sets}
    root = lambda d: d if low[d] == d else root(low[d])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {root(d) for d in sets}


def assert_mixed(before, after, weights=(5, 2, 1)):
    """Each source's words end within a document of the targets that filling by weight gives."""
    words = lambda r: len((r.text or "").split())
    size, taken, copies = defaultdict(int), defaultdict(int), Counter()
    for r in before:
        size[r.source] += words(r)
    for r in after:
        taken[r.source] += words(r)
        copies[r.doc_id] += 1
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, target, open_ = sum(size.values()), {}, set(size)
    while open_:
        left, every = total - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / every > 3 * size[s]}
        for s in full or open_:
            target[s] = 3 * size[s] if full else left * weight[s] / every
        open_ -= full or open_
    longest = max(map(words, before))
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in size) and max(copies.values()) <= 3
    assert set(map(tuple, after)) <= set(map(tuple, before))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    notice = "this passage stands in every third document of the corpus"
    for d in range(360):
        good = d % 5 != 0
        text = " ".join(rng.choice(words) for _ in range(60))
        if d % 3 == 0:
            text += "\n" + notice
        rows.append((d, text if good else text.upper().replace(" ", "!! "), "en", f"s{d % 3}", len(text)))
        labels.append((d, int(good), 0))
    for k in range(20):
        rows.append((1000 + k, rows[1 + 5 * k][1], "en", "s1", 10))
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, notice


def test_stages(spark, folder):
    at, rows, notice = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], at)
        out.write.parquet(f"{at}/stage-{k}")
        seen.append(spark.read.parquet(f"{at}/stage-{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    kept = {r.doc_id for r in seen[1].collect()}
    clean = {r[0] for r in rows if not r[1].isupper()}
    assert len(kept & clean) >= 0.97 * len(clean) and len(kept - clean) <= 3
    lines = [r.text for r in seen[2].collect()]
    assert sum(notice in t for t in lines) == 1 and len(lines) == len(kept)
    left = {r.doc_id for r in seen[3].collect()}
    assert left == representatives([(r.doc_id, r.text) for r in seen[2].collect()])
    before, after = seen[3].collect(), seen[4].collect()
    assert_mixed(before, after)
    library = Tokenizer.from_file(vocabulary_path())
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in seen[5].collect())
    want = Counter()
    for r in after:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_mixing_stage_keeps_rows_without_an_id_and_repeated_ids_apart(spark):
    """The budget is all words: null ids are not lost, and rows of one id do not take each other's copies."""
    rows = [(None if k % 4 == 0 else 7 if k % 4 == 1 else k, f"n{k} " + "w " * (k % 5), "en", f"s{k % 3}", 0) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixing_stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = out.collect()
    words = lambda found: sum(len(r[1].split()) for r in found)
    assert set(map(tuple, got)) <= set(rows)
    assert words(rows) - 10 <= words(got) <= words(rows)
    assert any(r.doc_id is None for r in got) and any(r.doc_id == 7 for r in got)


CLASHES = ["_gone", "gone", "kept", "_text", "_places", "places", "_gone_id", "_n_chars", "_source", "input", "turn", "n_dropped", "n_lines", "kept_text", "copies", "row", "size", "draw"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_with_clashing_columns_nulls_and_empty_texts(spark, folder, stage):
    at, rows, _ = folder
    odd = [(None, rows[1][1], "en", "s1", 3), (2000, None, None, None, None), (2001, "", "en", "s1", 0), (2001, "", "en", "s1", 0), (2002, " ", None, "s0", 1), (2003, "long " * 60_000, "en", "s2", 1)]
    docs = spark.createDataFrame(rows[:150] + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("int")).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    out = stage(spark, docs, at)
    assert [(c, t) for c, t in out.dtypes] == docs.dtypes
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in CLASHES)
    if stage is corpus_pipeline.near_dedup_stage:
        assert sum(r.doc_id in (2000, 2001, 2002) for r in got) == 4 and any(r.doc_id is None for r in got)
    if stage is corpus_pipeline.line_dedup_stage:
        assert len(got) == 156 and all(r.n_chars == len(r.text) for r in got)
    assert stage(spark, docs.limit(0), at).count() == 0


def test_stages_take_ids_that_are_texts(spark, folder):
    at, rows, _ = folder
    docs = spark.createDataFrame([(f"id-{r[0]:05}", *r[1:]) for r in rows if r[0] < 60 or r[0] >= 1000], "doc_id string, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_dedup_stage(spark, docs, at)
    assert lines.count() == docs.count()
    near = corpus_pipeline.near_dedup_stage(spark, lines, at)
    assert {r.doc_id for r in near.collect()} == representatives([(r.doc_id, r.text) for r in lines.collect()])
    mixed = corpus_pipeline.mixing_stage(spark, near, at)
    assert corpus_pipeline.bpe_stage(spark, mixed, at).count() == mixed.count()


def test_rows_that_repeat_an_id_are_told_apart_by_their_texts(spark, folder):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text), (5, text), (5, "another text of its own that nobody copies"), (7, text), (None, text), (None, "of no id and alone")], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, folder[0]).collect()), key=repr) == [(5, "another text of its own that nobody copies"), (None, "of no id and alone"), (None, text)]


LIGHT = {
    corpus_pipeline.mixing_stage: {"rank-ranges", "rank-offsets", "fill-ranges", "fill-offsets", "filled", "targets", "queue-ranges", "queue-offsets", "queued", "times-ranges", "times-offsets", "chosen"},
    corpus_pipeline.line_dedup_stage: {"common", "gone"},
    corpus_pipeline.near_dedup_stage: {"classes", "known"},
}


@pytest.mark.parametrize("stage", LIGHT)
def test_light_tables_take_a_file_for_65536_rows(spark, folder, stage, monkeypatch):
    """Many shuffle partitions make no small files, for which executors start processes on a local file system."""
    at, rows, _ = folder
    bases, begun = [], Workspace.__init__
    monkeypatch.setattr(Workspace, "__init__", lambda self, s: (begun(self, s), bases.append(self.base))[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    put = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        stage(spark, docs, at).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("part-*"))) for base in bases for p in Path(base.removeprefix("file:")).iterdir()}
    assert {k: files[k] for k in LIGHT[stage]} == dict.fromkeys(LIGHT[stage], 1)
