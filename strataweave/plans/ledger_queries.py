"""Event-ledger queries: ``events`` stands for the tap (user = session, event_type = tool or class, value = injected size)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats as S
from ..operators import joins as J
from ..operators import slopes as ML
from . import architecture as AR
from ..sources.transcripts import fork_delta
from .registry import Tables, query

NOISE = "(user_id * 7 + event_id) % 5"


def _events(t: Tables):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _k():
    return F.get_json_object("props", "$.k").cast("long")


_DUCK_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("""
WITH r AS (SELECT ts, event_id AS fp FROM events WHERE event_type = 'signup')
SELECT e.event_id, coalesce(CAST(r.fp AS VARCHAR), 'unknown') AS fingerprint FROM events e ASOF LEFT JOIN r ON e.ts >= r.ts WHERE e.event_type <> 'signup'
""")
def asof_ranker(t):
    """The ranker in force at each retrieval."""
    e = _events(t)
    changes = e.where("event_type = 'signup'").select("ts", F.col("event_id").cast("string").alias("fingerprint"))
    calls = e.where("event_type <> 'signup'").select("event_id", "ts")
    return J.as_of_join(calls, changes, left_ts="ts", right_ts="ts", value="fingerprint", default="unknown").select("event_id", "fingerprint")


@query("""
WITH r AS (SELECT user_id, ts, value AS price FROM events WHERE event_type = 'purchase')
SELECT e.event_id, r.price FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts WHERE e.event_type = 'view'
""")
def asof_by_key(t):
    e = _events(t)
    prices = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return J.as_of_join(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), prices, left_ts="ts", right_ts="ts", value="price", by=["user_id"]).select("event_id", "price")


@query(f"""
WITH o AS (SELECT user_id % 10 AS room, event_id AS occasion, ts AS s, CASE WHEN {_DUCK_K} % 7 = 0 THEN NULL ELSE ts + to_minutes(CAST({_DUCK_K} * 10 AS BIGINT)) END AS e FROM events WHERE event_type = 'signup'),
     c AS (SELECT event_id, user_id % 10 AS room, ts FROM events WHERE event_type = 'purchase'),
     j AS (SELECT c.event_id, o.occasion, row_number() OVER (PARTITION BY c.event_id ORDER BY o.s DESC NULLS LAST, o.occasion DESC) AS rn
           FROM c LEFT JOIN o ON o.room = c.room AND o.s <= c.ts AND (o.e IS NULL OR c.ts <= o.e))
SELECT event_id, occasion FROM j WHERE rn = 1
""")
def interval_innermost(t):
    """Calls counted once, in the most recently started occasion of their room that contains them."""
    e = _events(t).withColumn("room", F.col("user_id") % 10)
    end = F.when(_k() % 7 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (_k() * 10).cast("int")))
    spans = e.where("event_type = 'signup'").select("room", F.col("event_id").alias("occasion"), F.col("ts").alias("s"), end.alias("e"))
    calls = e.where("event_type = 'purchase'").select("event_id", "room", "ts")
    return J.interval_join(calls, spans, key="room", at="ts", start="s", end="e", span_id="occasion", call_id=["event_id"]).select("event_id", "occasion")


@query("""
SELECT event_type AS class, count(*) AS fired, count(*) FILTER (EXISTS (SELECT 1 FROM events l WHERE l.user_id = f.user_id AND l.ts > f.ts
   AND (f.event_type = 'signup' OR (f.event_type = 'error' AND l.event_type IN ('view', 'click'))))) AS followed
FROM events f WHERE event_type IN ('signup', 'error') GROUP BY 1
""")
def firing_followed(t):
    rows = J.followed_later(_events(t), key="user_id", at="ts", is_event=F.lit(True), class_col="event_type", expected={"error": ["view", "click"], "signup": None}, tool_col="event_type")
    return rows.groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("fired"), F.count_if("followed").alias("followed"))


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type, [{_DUCK_K} % 5, 5 + {_DUCK_K} % 3, 10 + event_id % 2] AS fp FROM events WHERE event_type IN ('error', 'purchase'))
SELECT b.event_id, EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = b.user_id AND p.event_id > b.event_id AND len(list_intersect(p.fp, b.fp)) >= 2) AS rescued,
       EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'error' AND p.user_id = b.user_id AND p.event_id > b.event_id AND p.fp = b.fp) AS repeated
FROM e b WHERE b.event_type = 'error'
""")
def block_rescue(t):
    """Blocks later followed by a pass with the same intent, and blocks repeated with an equal fingerprint."""
    fp = F.array(_k() % 5, 5 + _k() % 3, 10 + F.col("event_id") % 2)
    e = t.events.select("user_id", "event_id", "event_type", fp.alias("fp"))
    blocks, passes = e.where("event_type = 'error'"), e.where("event_type = 'purchase'")
    out = J.rescued(blocks.select("user_id", "event_id", "fp"), passes, key="user_id", pos="event_id", prints="fp")
    later = W.partitionBy("user_id", "fp").orderBy("event_id").rowsBetween(1, W.unboundedFollowing)
    return out.withColumn("repeated", F.count("*").over(later) > 0).select("event_id", "rescued", "repeated")


@query("""
WITH l AS (SELECT * FROM events WHERE event_type = 'view'), r AS (SELECT * FROM events WHERE event_type = 'click')
SELECT l.event_id, min(r.event_id) AS match_id FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 7200000000 GROUP BY l.event_id HAVING count(*) = 1
""")
def unique_in_window(t):
    e = _events(t)
    return J.unique_in_window(e.where("event_type = 'view'"), e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("match_id")), by=["user_id"], left_ts="ts", right_ts="ts", seconds=7200, left_id="event_id", right_id="match_id")


@query("""
WITH s AS (SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS shape FROM events WHERE event_id < 100000000 GROUP BY user_id),
     r AS (SELECT * FROM (VALUES (1, 'error|click|view'), (2, 'signup|purchase'), (3, 'view|view|view|view|view|view')) v(recipe, steps))
SELECT user_id, min(recipe) AS recipe FROM s JOIN r ON contains('|' || shape || '|', '|' || steps || '|') GROUP BY user_id
""")
def shape_reuse(t):
    """Sessions whose steps contain a stored recipe as a contiguous run; the first recipe in store order wins."""
    recipes = [(1, "error|click|view"), (2, "signup|purchase"), (3, "view|view|view|view|view|view")]
    steps = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    shape = t.events.groupBy("user_id").agg(F.concat(F.lit("|"), F.array_join(F.transform(steps, lambda x: x["event_type"]), "|"), F.lit("|")).alias("shape"))
    stored = t.events.sparkSession.createDataFrame([(n, f"|{s}|") for n, s in recipes], "recipe int, steps string")
    return J.contains_join(shape, stored, text="shape", name="steps").groupBy("user_id").agg(F.min("recipe").alias("recipe"))


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 5) USING (o_orderkey) UNION ALL SELECT CAST(NULL AS BIGINT), s_suppkey FROM supplier")
def uuid_antijoin(t):
    """Fork rows whose id the parent lacks, and rows without an id."""
    parent = t.lineitem.where("l_quantity > 5").select(F.col("l_orderkey").alias("o_orderkey"))
    fork = t.orders.select("o_orderkey", "o_custkey").unionByName(t.supplier.select(F.lit(None).cast("long").alias("o_orderkey"), F.col("s_suppkey").alias("o_custkey")))
    named = fork_delta(fork.withColumnRenamed("o_orderkey", "uuid"), parent.withColumnRenamed("o_orderkey", "uuid"))
    return named.withColumnRenamed("uuid", "o_orderkey")


_CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(f"""
WITH u AS (SELECT user_id, max(ts) AS last_ts, count(*) AS recalls, count(*) FILTER ({_DUCK_K} >= 50) AS used FROM events GROUP BY 1 ORDER BY last_ts DESC, user_id LIMIT 20)
SELECT u.user_id, u.recalls, u.used, string_agg(e.event_type, '|' ORDER BY e.event_id) AS calls FROM u JOIN events e USING (user_id) GROUP BY ALL
""")
def session_utilities(t):
    """The newest twenty sessions with their calls in order; only those sessions' calls are collected."""
    newest = t.events.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("recalls"), F.count_if(_k() >= 50).alias("used")).orderBy(F.col("last_ts").desc(), "user_id").limit(20)
    calls = t.events.select("user_id", "event_id", "event_type").join(F.broadcast(newest.select("user_id")), "user_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("c"))
    return newest.join(calls, "user_id").select("user_id", "recalls", "used", F.array_join(F.transform("c", lambda x: x["event_type"]), "|").alias("calls"))


@query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id, CASE WHEN event_type = 'error' AND value < 5 THEN 'rejected' WHEN event_type = 'error' THEN 'miss' WHEN event_type = 'signup' AND value < 20 THEN 'legacy' ELSE 'hit' END AS class, ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AS in_window FROM events")
def tap_classes(t):
    kind = F.when((F.col("event_type") == "error") & (F.col("value") < 5), "rejected").when(F.col("event_type") == "error", "miss").when((F.col("event_type") == "signup") & (F.col("value") < 20), "legacy").otherwise("hit")
    inside = (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return t.events.select("event_id", "user_id", kind.alias("class"), inside.alias("in_window"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total, day >= (SELECT max(day) FROM d) - 14 AS recent FROM d
""")
def growth_cumulative(t):
    """Daily counts, their running total, and which days lie in the last two weeks; windows see one row a day."""
    d = AR.series(t.events.select(F.col("ts").alias("ingested_at")))
    last = F.max("day").over(W.partitionBy(F.lit(1)))
    return d.select(F.col("day").cast("string").alias("day"), "n", "total", (F.col("day") >= F.date_sub(last, 14)).alias("recent"))


@query("""
WITH d AS (SELECT event_type, CAST(epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) / 86400000000 AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2)
SELECT a.event_type, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM d a JOIN d b ON a.event_type = b.event_type AND b.x > a.x GROUP BY 1
""")
def sens_slope(t):
    daily = t.events.groupBy("event_type", F.unix_date(F.to_date("ts")).alias("x")).agg(F.count("*").alias("y"))
    return S.sens_slope(daily, "x", "y", group=["event_type"])


@query("SELECT round(quantile_cont((b.p_retailprice - a.p_retailprice) / (b.p_size - a.p_size), 0.5), 6) + 0.0 AS slope FROM part a JOIN part b ON b.p_size > a.p_size")
def median_slope(t):
    """Middle slope of price over size between all pairs of parts, by counting inversions."""
    slope = ML.median_slope(t.part, "p_size", "p_retailprice")
    return t.spark.range(1).select((F.round(F.lit(slope), 6) + 0.0).alias("slope"))


@query("""
WITH r AS (SELECT quality, count(*) AS total, count(*) FILTER (toxic = 1) AS hits FROM labels GROUP BY 1), p AS (SELECT *, hits / total AS p, 1 + 3.8416 / total AS d FROM r)
SELECT quality, hits, total, round(greatest(0, (p + 3.8416 / (2 * total)) / d - 1.96 * sqrt(p * (1 - p) / total + 3.8416 / (4 * total * total)) / d), 9) AS low,
  round(least(1, (p + 3.8416 / (2 * total)) / d + 1.96 * sqrt(p * (1 - p) / total + 3.8416 / (4 * total * total)) / d), 9) AS high FROM p
""")
def wilson_rate(t):
    r = t.labels.groupBy("quality").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("total"))
    return r.select("quality", "hits", "total", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    e = _events(t)
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "event_type", "n")


@query("""
WITH s AS (SELECT unnest([0, 1]) AS i), e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(i AS INTEGER)) AS start FROM events, s)
SELECT epoch_us(start) AS start, count(*) AS n FROM e GROUP BY 1
""")
def sliding_windows(t):
    """Two-day windows every day."""
    return _events(t).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
     s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, sid
""")
def session_windows(t):
    """Sessions that end after six hours without an event."""
    return _events(t).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("""
SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS BIGINT) AS quarter, percent_rank() OVER w AS percent_rank,
  CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS ahead
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)
""")
def ranking_windows(t):
    w = W.partitionBy("user_id").orderBy("value")
    ahead = W.partitionBy("user_id").orderBy("event_id").rowsBetween(1, 3)
    return t.events.select("event_id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"), F.ntile(4).over(W.partitionBy("user_id").orderBy("value", "event_id")).cast("long").alias("quarter"), F.percent_rank().over(w).alias("percent_rank"), F.count("*").over(ahead).alias("ahead"))
