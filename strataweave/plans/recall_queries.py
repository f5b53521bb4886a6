"""Recall over the driver's tables: documents stand for sessions, benchmark passages for knowledge, conversations for transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import contract as C
from ..operators import joins as J
from ..operators import ranking as R
from ..operators.iterate import settle
from . import evaluation as EV
from .registry import query

ASK = "the nature of pour les enre rthe erti"
WORDS = T.keywords(ASK)
_LIST = ", ".join(f"'{w}'" for w in WORDS)


def _hits_sql(table: str, key: str, worth: float) -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS node, w AS keyword, {worth} AS score FROM {table}, (SELECT unnest([{_LIST}]) AS w) WHERE contains(lower(text), w)"


def _ranked_sql(hits: str) -> str:
    return f"""SELECT node, sum(score) AS score, count(DISTINCT keyword) AS matched, sha256('{ASK}' || chr(0) || node) AS tie
      FROM ({hits}) GROUP BY node HAVING count(DISTINCT keyword) >= least({R.MATCH_FLOOR}, {len(WORDS)})"""


@query(f"SELECT node, CAST(score AS DOUBLE) AS score, matched FROM ({_ranked_sql(_hits_sql('documents', 'doc_id', R.SUMMARY_HIT))}) ORDER BY score DESC, tie, node LIMIT 20")
def recall_ranked(t):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("node"), "text")
    hits = R.keyword_hits(docs, node="node", text="text", words=WORDS, worth=R.SUMMARY_HIT)
    return R.top(R.ranked(hits, query=ASK, n_words=len(WORDS)), 20).select("node", "score", "matched")


@query(f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie, node) AS rank FROM ({_ranked_sql(_hits_sql('documents', 'doc_id', R.SUMMARY_HIT))})),
     k AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie, node) AS rank FROM ({_ranked_sql(_hits_sql('benchmark', 'item_id', R.KNOWLEDGE_HIT))})),
     n AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM k) AS nk),
     r AS (SELECT ns, nk, CASE WHEN ns > 0 THEN least(nk, 5) ELSE nk END AS reserved FROM n),
     u AS (
       SELECT 'claim' AS kind, node, CASE WHEN rank <= reserved THEN rank ELSE rank + least(ns, 10 - reserved) END AS position FROM k, r
       UNION ALL
       SELECT 'session', node, reserved + rank FROM s, r WHERE rank <= 10 - reserved)
SELECT kind, node, position FROM u WHERE position <= 10
""")
def recall_mixed_window(t):
    docs = R.keyword_hits(t.documents.select(F.col("doc_id").cast("string").alias("node"), "text"), node="node", text="text", words=WORDS, worth=R.SUMMARY_HIT)
    passages = R.keyword_hits(t.benchmark.select(F.col("item_id").cast("string").alias("node"), "text"), node="node", text="text", words=WORDS, worth=R.KNOWLEDGE_HIT)
    ranked = [R.ranked(h, query=ASK, n_words=len(WORDS)) for h in (docs, passages)]
    return R.mixed_window(*ranked, 10)


@query("""
WITH m AS (SELECT conv_id, turn, text, contains(lower(text), 'the ') AS hit FROM conversations),
     p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, hit ORDER BY turn) AS rn FROM m),
     c AS (SELECT conv_id, count(*) FILTER (hit) AS m, count(*) FILTER (NOT hit) AS u FROM m GROUP BY conv_id)
SELECT conv_id, rn AS position, text AS detail FROM p WHERE hit AND rn <= 3
UNION ALL
SELECT conv_id, least(m, 3) + 1, CAST(greatest(m - 3, 0) + u AS VARCHAR) || ' more claim(s) in this session: ' || concat_ws('; ',
  CASE WHEN m > 3 THEN CAST(m - 3 AS VARCHAR) || ' matched but exceeded the 3-claim render cap' END,
  CASE WHEN u > 0 THEN CAST(u AS VARCHAR) || ' did not match the query' END) || ' — recall the session node to expand'
FROM c WHERE m > 3 OR u > 0
""")
def detail_cap_elision(t):
    return R.capped_details(t.conversations, parent="conv_id", text="text", order="turn", words=["the "], cap=3)


_OVER = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in WORDS)


@query(f"""
WITH w AS (SELECT doc_id, n_chars, {_OVER} AS overlap FROM documents ORDER BY n_chars DESC, doc_id LIMIT {R.THREAD_WINDOW})
SELECT doc_id, n_chars, CAST(overlap AS INT) AS overlap FROM w ORDER BY overlap DESC, n_chars DESC, doc_id LIMIT 15
""")
def topic_rerank(t):
    return R.rerank(t.documents.select("doc_id", "n_chars", "text"), base=[F.col("n_chars").desc(), F.col("doc_id")], relevance=T.overlap(F.col("text"), WORDS), window=R.THREAD_WINDOW, limit=15).select("doc_id", "n_chars", "overlap")


@query("""
WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders o WHERE o_orderstatus = 'P'
             AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
             AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))
SELECT o_custkey, count(*) AS times, epoch_us(max(o_orderdate)) AS last_seen FROM p GROUP BY o_custkey ORDER BY times DESC, last_seen DESC, o_custkey LIMIT 40
""")
def open_problems(t):
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    held = t.orders.where("o_orderstatus = 'P'").join(items.select("o_orderkey"), "o_orderkey", "left_semi").join(items.where("l_returnflag = 'R'").select("o_orderkey"), "o_orderkey", "left_anti")
    out = held.groupBy("o_custkey").agg(F.count("*").alias("times"), F.unix_micros(F.max(F.col("o_orderdate").cast("timestamp"))).alias("last_seen"))
    return out.orderBy(F.col("times").desc(), F.col("last_seen").desc(), "o_custkey").limit(40)


@query("""
SELECT p_brand, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_orderkey) AS orders, min(c_mktsegment) AS first_segment
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE p_name LIKE '%widget%' GROUP BY p_brand
""")
def artifact_history(t):
    parts = t.part.where(F.col("p_name").contains("widget")).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    hops = t.lineitem.select("l_partkey", "l_orderkey").join(parts, "l_partkey").select("p_brand", F.col("l_orderkey").alias("o_orderkey")).distinct()
    hops = hops.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return hops.groupBy("p_brand").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.min("c_mktsegment").alias("first_segment"))


@query("""
WITH k AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size = 7 AND p_brand <> '' ORDER BY p_brand, p_name LIMIT 25)
SELECT p_partkey, p_brand, p_name FROM part SEMI JOIN k USING (p_brand, p_name)
""")
def spellings_join(t):
    """Everything that shares a (repo, path)-like key with a match; unanchored rows are never joined."""
    part = t.part.select("p_partkey", "p_brand", "p_name", "p_size")
    keys = part.where("p_size = 7 AND p_brand <> ''").select("p_brand", "p_name").distinct().orderBy("p_brand", "p_name").limit(25)
    return part.join(keys, ["p_brand", "p_name"], "left_semi").select("p_partkey", "p_brand", "p_name")


@query("""
WITH s AS (SELECT sha256(text) AS h, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1)
SELECT d.doc_id, s.first_doc, s.n AS copies FROM documents d JOIN s ON sha256(d.text) = s.h WHERE s.n > 1
""")
def response_hash_join(t):
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    seen = hashed.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(seen, "h").select("doc_id", "first_doc", "copies")


@query("""
SELECT u.conv_id, u.turn, min(a.turn) AS answer_turn
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn
WHERE u.role = 'user' GROUP BY u.conv_id, u.turn
""")
def call_result_join(t):
    """Each user turn and the first assistant turn after it, by one backward window instead of a self-join."""
    after = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    turns = t.conversations.select("conv_id", "turn", "role")
    return turns.withColumn("answer_turn", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(after)).where("role = 'user'").select("conv_id", "turn", "answer_turn")


@query("""
WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_nationkey < 5)
SELECT coalesce(o.k, c.k) AS k, coalesce(o.n, c.n) AS n, concat_ws(',', CASE WHEN c.k IS NOT NULL THEN 'customer' END, CASE WHEN o.k IS NOT NULL THEN 'orders' END) AS found_by
FROM o FULL JOIN c ON o.k = c.k
""")
def full_outer_precedence(t):
    orders = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    people = t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    return J.merge_by_precedence([orders, people], key="k", columns=["n"], names=["orders", "customer"])


_PATH = r"regexp_extract(url, '://([^?#]*)', 1)"


@query(f"""
WITH p AS (SELECT page_id, url, string_split({_PATH}, '/') AS s FROM pages),
     k AS (SELECT DISTINCT array_to_string(s[1:2], '/') AS a FROM p WHERE starts_with(url, 'https')),
     e AS (SELECT page_id, array_to_string(s[1:i], '/') AS a, i FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM p))
SELECT page_id, arg_max(a, i) AS prefix FROM e SEMI JOIN k USING (a) WHERE a <> '' GROUP BY page_id
""")
def longest_prefix(t):
    paths = t.pages.select("page_id", "url", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    known = paths.where("startswith(url, 'https')").select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix"))
    return J.longest_affix(paths, known, path="path", affix="prefix", row_id="page_id").select("page_id", "prefix")


@query(f"""
WITH p AS (SELECT page_id, url, string_split({_PATH}, '/') AS s FROM pages),
     k AS (SELECT DISTINCT array_to_string(s[2:], '/') AS a FROM p WHERE starts_with(url, 'https')),
     e AS (SELECT page_id, array_to_string(s[i:], '/') AS a FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM p))
SELECT page_id, arg_max(a, length(a)) AS suffix FROM e SEMI JOIN k USING (a) WHERE a <> '' GROUP BY page_id
""")
def longest_suffix(t):
    paths = t.pages.select("page_id", "url", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    parts = F.split("path", "/")
    known = paths.where("startswith(url, 'https')").select(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("suffix"))
    return J.longest_affix(paths, known, path="path", affix="suffix", row_id="page_id", suffix=True).select("page_id", "suffix")


@query("""
WITH n AS (SELECT item_id, lower(substr(trim(text), 1, 60)) AS needle FROM benchmark WHERE length(trim(text)) >= 24)
SELECT item_id, min(doc_id) AS first_doc, count(*) AS documents FROM documents, n WHERE contains(lower(text), needle) GROUP BY item_id
""")
def contains_join(t):
    """Citations of 24 characters or more, found by their first 60 in the texts; the first place wins."""
    needles = t.benchmark.where(F.length(F.trim("text")) >= 24).select("item_id", F.lower(F.substring(F.trim("text"), 1, 60)).alias("needle"))
    hits = J.contains_join(t.documents.select("doc_id", "text"), needles, text="text", name="needle")
    return hits.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("documents"))


@query("SELECT doc_id, len(k) AS n, array_to_string(list_sort(list_distinct(k)), ' ') AS terms FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_./-]+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")) AS k FROM documents)")
def keyword_tokens(t):
    stop = F.array(*[F.lit(w) for w in T.STOP_WORDS])
    kept = F.filter(T.tokens(F.col("text")), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))
    return t.documents.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("k")), " ").alias("terms"))


_DROP = "html"
for _n in T.DROPPED_ELEMENTS:
    _DROP = f"regexp_replace({_DROP}, '(?is)<{_n}\\b.*?</{_n}>', ' ', 'g')"
_DROP = f"regexp_replace({_DROP}, '(?s)<[^>]+>', ' ', 'g')"
for _a, _b in T._ENTITIES:
    _DROP = "replace({}, '{}', '{}')".format(_DROP, _a.replace("'", "''"), _b.replace("'", "''"))


@query(f"SELECT page_id, trim(regexp_replace({_DROP}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS body FROM pages")
def html_to_text(t):
    return t.pages.select("page_id", T.html_text(F.col("html")).alias("body"))


@query("SELECT doc_id, len(regexp_extract_all(text, '" + T.ASSIGNED_SECRET + "')) AS assigned, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS \"{n}\"" for n, p in T.SECRET_PATTERNS.items()) + " FROM documents")
def secret_scan(t):
    found = T.secret_hits(F.col("text"), {"assigned": T.ASSIGNED_SECRET} | T.SECRET_PATTERNS)
    return t.documents.select("doc_id", *[c.alias(n) for n, c in found.items()])


_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9_./-]+')), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"


@query(f"""
WITH a AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
     b AS (SELECT conv_id, turn, {_TERMS.format('text')} AS terms, list_distinct(regexp_extract_all(lower(coalesce(reply, '')), '[a-z0-9_./-]+')) AS said FROM a),
     c AS (SELECT conv_id, turn, len(terms) AS n_terms, len(list_intersect(terms, said)) AS matched FROM b)
SELECT conv_id, turn, n_terms, matched, n_terms > 0 AND matched >= least(n_terms, 2) AND matched / nullif(n_terms, 0) >= 0.3 AS used FROM c
""")
def verdict_used(t):
    """Whether the next turn uses enough of a turn's terms, by the judge's own rule."""
    w = W.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.select("conv_id", "turn", "text", F.coalesce(F.lead("text").over(w), F.lit("")).alias("reply"))
    terms, said = T.terms(F.col("text")), T.tokens(F.col("reply"))
    # No text holds this id, so only the terms decide.
    used, _ = EV.verdict(F.lit("no such vertex\u0000"), F.col("text"), F.col("reply"))
    return turns.select("conv_id", "turn", F.size(terms).cast("long").alias("n_terms"), F.size(F.array_intersect(terms, said)).cast("long").alias("matched"), used.alias("used"))


_COMPOUND = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9_./-]+'), regexp_extract_all(lower({0}), '[a-z0-9]+')))"


@query(f"""
WITH x AS (SELECT DISTINCT unnest({_COMPOUND.format('text')}) AS tok FROM benchmark),
     d AS (SELECT doc_id, unnest({_COMPOUND.format('text')}) AS tok FROM documents),
     c AS (SELECT doc_id, count(*) AS n, count(x.tok) AS matched FROM d LEFT JOIN x USING (tok) WHERE length(d.tok) > 2 AND d.tok NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}) GROUP BY doc_id)
SELECT doc_id, n, matched, matched >= least(n, 2) AND matched / n >= 0.3 AS external, CASE WHEN matched >= least(n, 2) AND matched / n >= 0.3 THEN 2 ELSE 1 END AS tier FROM c
""")
def ingress_floor(t):
    """Texts that echo external passages are floored to tier 2, by the contract's own rule."""
    own = t.documents.select("doc_id", "text", F.lit(1).alias("tier"), F.lit(False).alias("external"), F.lit("").alias("source"))
    counts = settle(C.echoes(own, t.benchmark, key="doc_id", text="text", stop=T.STOP_WORDS))
    floored = C.ingress_floor(own, t.benchmark, text="text", group=None, key="doc_id", counts=counts).select("doc_id", "external", "tier")
    return counts.select("doc_id", "n", "matched").join(floored, "doc_id").select("doc_id", "n", "matched", "external", "tier")
