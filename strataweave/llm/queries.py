"""The queries of the thirteen operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, filter_audit, language_id, length_histogram, line_dedup, merkle, mixing, near_dedup, quality, suffix_dedup, url_filter
from .workspace import table

#: Fixed rules of the URL query.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, good): labelled of good quality and not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, good_labels(spark, sf_dir)))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n x ON p.u = x.doc_id JOIN n y ON p.v = y.doc_id WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), b AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r AS (
  SELECT u AS node, v AS other FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.other = b.u
), c AS (
  SELECT node, min(other) AS low FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(?:[.][a-z]+)?/?(?:[?#]|$)', 1) AS BIGINT)")
    labels = good_labels(spark, sf_dir).groupBy(F.col("doc_id").alias("_doc")).agg((F.min("good") == 0).alias("bad"))
    labelled = pages.withColumn("_doc", number).join(labels, "_doc", "left").drop("_doc")
    return url_filter.filter_urls(labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, threshold=3, least_chars=20).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.length_histogram(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, vocabulary_path())
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    learn = docs.where("lang is not null and doc_id is not null").where(~held_out).select("doc_id", "lang", "text")
    model = language_id.train(learn)
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")), model)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, cover=50)


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), v AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3
  FROM (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM p) WINDOW o AS (PARTITION BY piece ORDER BY i)
), f AS (
  SELECT lang, w1 AS phrase, 1 AS k, NULL AS l1, NULL AS r1, NULL AS l2, NULL AS r2, count(*) AS a FROM v GROUP BY lang, w1
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, w1, w2, NULL, NULL, count(*) FROM v WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, w1, w2 || ' ' || w3, w1 || ' ' || w2, w3, count(*) FROM v WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
), e AS MATERIALIZED (
  SELECT * FROM f WHERE a >= 10
), s AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), u AS (
  SELECT lang, phrase, k, a, 1 AS cut, l1 AS lp, r1 AS rp FROM e WHERE k >= 2 UNION ALL SELECT lang, phrase, k, a, 2, l2, r2 FROM e WHERE k = 3
), x AS (
  SELECT u.*, fl.a AS l, fr.a AS r, ((1000000::HUGEINT * u.a * u.a) // (fl.a::HUGEINT * fr.a))::BIGINT AS score
  FROM u JOIN e fl ON fl.lang = u.lang AND fl.phrase = u.lp JOIN e fr ON fr.lang = u.lang AND fr.phrase = u.rp
), b AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), h AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, l2 AS phrase, a FROM e WHERE k = 3 UNION ALL SELECT lang, r1, a FROM e WHERE k = 3) GROUP BY lang, phrase
), q AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.most IS NULL OR 100 * h.most < 50 * b.a
)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN s ON s.lang = q.lang WHERE rank <= 2000
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP12_SQL = r"""
WITH b AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(raw[i:i + 399]) AS h FROM (SELECT doc_id, raw, unnest(range(1, n - 398)) AS i FROM b)
), s AS (
  SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), e AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM s
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS z, run FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run
), k AS (
  SELECT doc_id, run, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS following FROM r
), p AS (
  SELECT b.doc_id, 0 AS run, hex(raw[1:coalesce(f.a, n + 1) - 1]) AS part FROM b LEFT JOIN k f ON f.doc_id = b.doc_id AND f.run = 1
  UNION ALL SELECT k.doc_id, k.run, hex(raw[z:coalesce(following, n + 1) - 1]) FROM k JOIN b ON b.doc_id = k.doc_id
), t AS (
  SELECT doc_id, string_agg(part, '' ORDER BY run) AS body FROM p GROUP BY doc_id
), c AS (
  SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS runs FROM r GROUP BY doc_id
)
SELECT b.doc_id, b.n AS n_bytes, coalesce(c.gone, 0) AS n_removed, coalesce(c.runs, 0) AS n_spans, sha256(unhex(t.body)) AS kept_sha256
FROM b JOIN t ON t.doc_id = b.doc_id LEFT JOIN c ON c.doc_id = b.doc_id
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, i::INT AS step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE contains(left(filter_order, i::INT - 1), g.letter))::INT AS prior
  FROM o, range(1, 6) AS r(i), f WHERE f.letter = filter_order[i::INT]
), r AS (
  SELECT c.part, filter_order, step, bit,
         sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & prior > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


QUERIES = {f.__name__: f for f in (op1_quality_cotraining, op2_near_dedup, op3_exact_dedup, op4_fingerprints, op5_url_filter, op6_line_dedup, op7_length_histogram, op8_bpe, op9_mixing, op10_language_id, op11_collocations, op12_suffix_dedup, op13_filter_audit)}
SQL = {"op2_near_dedup": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op6_line_dedup": OP6_SQL, "op11_collocations": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
