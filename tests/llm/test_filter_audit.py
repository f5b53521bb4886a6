from __future__ import annotations

import itertools
import random
import re

import pytest

from strataweave.llm import filter_audit
from strataweave.llm.queries import op13_filter_audit


def brute(rows, labels):
    """Apply every order to every document, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    fails = []
    for d, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t],
        })
    out = {}
    parts = {lang or "" for _, _, lang in rows}
    for part in parts:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                total[f] += len(gone)
                earlier = sum(fails[k][f] for k in mine) - len(gone)
                alone = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine)
                out[part, "".join(order), step] = [len(left), len(gone), earlier, alone, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    word = lambda k: f"w{rng.randrange(k)}"
    rows = []
    for d in range(120):
        n = rng.choice([5, 150, 260, 400])
        text = " ".join(word(rng.choice([30, 4000])) for _ in range(n))
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += " #tag | 5%"
        rows.append((d * 2, text, rng.choice(["en", "de", None, ""])))
    rows += [(900 + k, rows[k % 7][1], rng.choice(["en", "fr"])) for k in range(40)]
    rows += [(None, rows[0][1], "en"), (None, rows[0][1], "en"), (3, rows[1][1], "de"), (3, rows[1][1], "de"), (5, None, "en"), (7, "", None), (9, "\n \t", "en"), (11, "é" * 300 + " Ä", "de"), (13, "word " * 900_000, "de")]
    labels = [(d, d % 3 == 0, d % 5 == 0) for d in range(0, 1000, 2)]
    labels = [(d, int(q), int(t)) for d, q, t in labels] + [(None, 1, 1), (3, 1, None), (3, None, 1), (5, 1, 0), (5, 1, 0)]
    return rows, labels


def test_every_order_against_brute_force(spark, odd_rows, tmp_path):
    rows, labels = odd_rows
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, digest string, salt int").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in op13_filter_audit(spark, str(tmp_path)).collect()}
    assert got == brute(rows, labels)


def test_empty_table_has_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(docs, labels).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    r = filter_audit.audit_documents(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (r.removed, r.good_lost, r.kept) == (1, 1, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filter_audit.transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_words_of_a_very_long_text_are_met_one_by_one(monkeypatch):
    texts = ["a b a\x0bb \x1f c d", "", " x" * 500, "Ab " * 300]
    want = [filter_audit.text_mask(t) for t in texts]
    monkeypatch.setattr(filter_audit, "BLOCK", 0)
    assert [filter_audit.text_mask(t) for t in texts] == want


def test_letters_are_checked(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "AA")
