"""Every opN query as registered, over one small folder of tables."""

from __future__ import annotations

import random

import duckdb
import pytest

from strataweave.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("sto", "riv", "clo", "mar", "la") for b in ("ne", "er", "ud", "ble", "ntern", "s")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))
    notice = "\nThis line of notice stands in many documents of the table\n"
    passage = text(110)
    docs = []
    for d in range(260):
        t = text(rng.randrange(3, 260)) + (notice if d % 4 == 0 else "") + (passage if d % 9 == 0 else "")
        docs.append((d, t if d % 11 else t.upper() + " #", rng.choice(["en", "de", "fr"]), f"src{d % 5}", len(t)))
    docs += [(300 + k, docs[k % 9][1] + (" end" if k % 2 else ""), "en", "src0", 1) for k in range(40)]
    docs += [(400, None, None, None, None), (401, "", "en", "src1", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(d % 11 > 0), int(d % 13 == 0)) for d in range(0, 260, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(p, f"https://{rng.choice(['example.com', 'a.example.net', 'x.org', 'EXAMPLE.com'])}/{rng.choice(['en', 'de', 'es'])}/{p}.html?q=1", "<p>") for p in range(300)] + [(900, None, None), (901, "no url", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return at, docs, pages, con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, tables, name):
    at, _, _, con = tables
    df = queries.QUERIES[name](spark, at)
    columns = sorted(df.columns)
    want = con.execute(queries.SQL[name])
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(repr, ([r[i] for i in place] for r in want.fetchall()))) == sorted(repr([r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_queries_without_sql_return_every_row_once(spark, tables, name):
    at, docs, pages, _ = tables
    got = queries.QUERIES[name](spark, at).collect()
    if name == "op7_length_histogram":
        assert got
        return
    own, key = (pages, "page_id") if name == "op5_url_filter" else (docs, "doc_id")
    assert sorted(r[key] for r in got) == sorted(r[0] for r in own)
    if name == "op9_mixing":
        assert all(r.taken <= 3 * r.size for r in got)
    if name == "op10_language_id":
        assert all(r.lang_pred == "und" for r in got if r.doc_id in (400, 401)) and all(0 <= r.score <= 1 for r in got)
    if name == "op1_quality_cotraining":
        known = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 260 and r.doc_id % 13}
        assert sum(known[d] == (d % 11 > 0) for d in known) >= 0.9 * len(known)
