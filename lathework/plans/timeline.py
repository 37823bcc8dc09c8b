"""Interval, stream-shaped and statistics queries over ``events`` and friends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathework.functions import stats
from lathework.operators import compare, intervals
from lathework.sources.tables import table
from lathework.streaming import monitor

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _micros(column: str):
    """Microseconds of a time stamp without zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", _micros("ts").alias("us"))


#: Intervals: an event lasts its value in minutes.
_SPANS = """
    iv AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 60000000 AS e FROM events WHERE value IS NOT NULL)"""


def _spans(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("value IS NOT NULL")
    length = F.floor(F.abs("value")).cast("long") * 60_000_000
    return rows.select("user_id", "event_type", "event_id", F.col("us").alias("start"), (F.col("us") + length).alias("end"))


def _islands(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, min(s) AS s, max(e) AS e FROM (
        SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new
          FROM {source} WHERE e > s)) GROUP BY {keys}, island"""


@query(f"WITH {_SPANS}, i AS ({_islands('iv', 'user_id')}) SELECT user_id, s AS start, e AS \"end\" FROM i")
def busy_union(spark, sf_dir):
    return intervals.islands(_spans(spark, sf_dir), ["user_id"])


@query(f"WITH {_SPANS}, i AS ({_islands('iv', 'user_id')}) SELECT user_id, sum(e - s)::BIGINT AS busy, max(e) - min(s) AS span, (max(e) - min(s) - sum(e - s))::BIGINT AS idle, round(sum(e - s) / (max(e) - min(s)), 9) AS busy_share FROM i GROUP BY 1")
def busy_gap(spark, sf_dir):
    found = intervals.busy(_spans(spark, sf_dir), ["user_id"])
    return found.withColumn("busy_share", F.round(stats.ratio(F.col("busy"), F.col("span")), 9))


_LOW, _HIGH = 1704585600000000, 1705190400000000  # the second week of 2024


@query(f"""WITH {_SPANS}, c AS (SELECT user_id, greatest(s, {_LOW}) AS s, least(e, {_HIGH}) AS e FROM iv WHERE e > {_LOW} AND s < {_HIGH}), i AS ({_islands('c', 'user_id')})
    SELECT user_id, sum(e - s)::BIGINT AS busy FROM i GROUP BY 1""")
def clipped_busy(spark, sf_dir):
    window = intervals.clip(_spans(spark, sf_dir), F.lit(_LOW), F.lit(_HIGH))
    return intervals.busy(window, ["user_id"]).select("user_id", "busy")


@query(f"""WITH {_SPANS}, a AS (SELECT * FROM iv WHERE event_type = 'click'), b AS (SELECT * FROM iv WHERE event_type = 'purchase'),
    x AS ({_islands('a', 'user_id')}), y AS ({_islands('b', 'user_id')}), u AS (SELECT DISTINCT user_id FROM x UNION SELECT user_id FROM y),
    p AS (SELECT x.user_id, sum(least(x.e, y.e) - greatest(x.s, y.s)) AS n FROM x JOIN y ON x.user_id = y.user_id AND x.s < y.e AND y.s < x.e GROUP BY 1)
    SELECT u.user_id, coalesce(p.n, 0)::BIGINT AS both FROM u LEFT JOIN p ON p.user_id = u.user_id""".replace("AS both", 'AS "both"'))
def interval_intersection(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return intervals.intersection(spans.filter("event_type = 'click'"), spans.filter("event_type = 'purchase'"), ["user_id"])


@query("""
    SELECT event_type, hour, count(*) AS n, min(event_id) AS first_event FROM (
      SELECT event_type, event_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour FROM events) WHERE hour % 2 = 0 GROUP BY 1, 2""")
def frame_containment(spark, sf_dir):
    """Events inside frames, here every even hour by event type, by an as-of window rather than a range join."""
    events = _events(spark, sf_dir)
    frames = events.select("event_type", F.expr("us div 3600000000").alias("hour")).distinct().filter("hour % 2 = 0")
    frames = frames.select("event_type", (F.col("hour") * 3_600_000_000).alias("frame_start"), ((F.col("hour") + 1) * 3_600_000_000).alias("frame_end"), "hour")
    found = intervals.containing_frame(events, frames, ["event_type"], "us", "frame_start", "frame_end", ["hour"])
    return found.filter("frame IS NOT NULL").groupBy("event_type", F.col("frame.hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(quantile_cont(value, 0.95) FILTER (i <= greatest(1, n // 10)), 6) AS first_p95,
           round(quantile_cont(value, 0.95) FILTER (i > n - greatest(1, n // 10)), 6) AS last_p95 FROM r GROUP BY 1""")
def drift_first_last(spark, sf_dir):
    w = Window.partitionBy("event_type")
    rows = _events(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("us", "event_id")), "n": F.count(F.lit(1)).over(w)})
    size = F.greatest(F.lit(1), F.expr("n div 10"))
    value = lambda keep: F.round(stats.quantile(F.when(keep, F.col("value")), 0.95), 6)
    return rows.groupBy("event_type").agg(value(F.col("i") <= size).alias("first_p95"), value(F.col("i") > F.col("n") - size).alias("last_p95"))


@query("""
    SELECT user_id, round(coalesce(regr_slope(value, m), 0), 6) AS slope, round(max_by(value, (us, event_id)) - min_by(value, (us, event_id)), 6) AS growth, round(max(value) - min(value), 6) AS span
    FROM (SELECT user_id, event_id, value, epoch_us(ts) AS us, (epoch_us(ts) - 1704067200000000) / 6e10 AS m FROM events) GROUP BY 1""")
def slope_growth(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("m", (F.col("us") - 1704067200000000) / 6e10)
    last = F.struct("us", "event_id")
    return rows.groupBy("user_id").agg(
        F.round(stats.slope(F.col("value"), F.col("m")), 6).alias("slope"),
        F.round(F.max_by("value", last) - F.min_by("value", last), 6).alias("growth"),
        F.round(F.max("value") - F.min("value"), 6).alias("span"),
    )


@query("""
    SELECT event_type, round(stddev_pop(value) / avg(value) * 100, 6) AS cv_population,
           round(CASE WHEN count(value) < 2 OR avg(value) = 0 THEN 0 ELSE stddev_samp(value) / avg(value) * 100 END, 6) AS cv_sample,
           round((max(abs(value) + 1) - min(abs(value) + 1)) / min(abs(value) + 1), 6) AS relative_span FROM events GROUP BY 1""")
def cv_population_sample(spark, sf_dir):
    value, shifted = F.col("value"), F.abs("value") + 1
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(stats.cv_population(value), 6).alias("cv_population"),
        F.round(stats.cv_sample(value), 6).alias("cv_sample"),
        F.round(stats.relative_span(shifted), 6).alias("relative_span"),
    )


_SUMMARY_SQL = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {n}" for n, q in stats.SUMMARY.items())


@query(f"SELECT l_returnflag, count(l_extendedprice) AS count, round(min(l_extendedprice), 4) AS min, {_SUMMARY_SQL}, round(max(l_extendedprice), 4) AS max, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def percentile_summary(spark, sf_dir):
    found = stats.grouped_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return found.select("l_returnflag", "count", *[F.round(c, 4).alias(c) for c in ("min", *stats.SUMMARY, "max", "mean")])


_TIMING_SQL = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in stats.TIMING.items())


@query(f"""SELECT event_type, count(value) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, {_TIMING_SQL}, round(min(value), 6) AS min, round(max(value), 6) AS max,
    round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY 1""")
def timing_stats(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(*stats.timing(F.col("value")))
    share = 100 * F.col("total") / F.sum("total").over(Window.partitionBy())  # one row an event type
    return found.select("event_type", "count", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", *stats.TIMING, "min", "max")], F.round(share, 6).alias("share"))


@query("""
    WITH w AS (SELECT event_type, CAST((epoch_us(ts) - 1704067200000000) // 604800000000 AS BIGINT) AS week, avg(value) AS v FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2),
    p AS (SELECT a.week, a.v AS a, b.v AS b, (b.v - a.v) / a.v * 100 AS d FROM w a JOIN w b ON a.week = b.week AND a.event_type = 'click' AND b.event_type = 'purchase')
    SELECT count(*) AS pairs, round(median(d), 6) AS median_delta, count(*) FILTER (d > 0) AS favourable, median(d) >= 3 AND count(*) FILTER (d > 0) >= 2 AS accepted FROM p""")
def paired_delta_gate(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("week", F.expr("(us - 1704067200000000) div 604800000000"))
    means = rows.filter(F.col("event_type").isin("click", "purchase")).groupBy("week", "event_type").agg(F.avg("value").alias("v"))
    pairs = compare.paired(means, ["week"], "event_type", ("click", "purchase"), ["v"])
    delta = stats.improvement(F.col("b_v"), F.col("a_v"), True)
    found = pairs.select(delta.alias("d")).agg(F.count(F.lit(1)).alias("pairs"), F.median("d").alias("m"), F.count_if(F.col("d") > 0).alias("favourable"))
    return found.select("pairs", F.round("m", 6).alias("median_delta"), "favourable", ((F.col("m") >= 3) & (F.col("favourable") >= 2)).alias("accepted"))


@query("""
    WITH c AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm, sum(floor(abs(value))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS counter FROM events WHERE value IS NOT NULL),
    l AS (SELECT *, lag(counter) OVER w AS pc, lag(tm) OVER w AS pa, max(counter) OVER w AS peak FROM c WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id))
    SELECT user_id, event_id, round(CASE WHEN pa IS NULL OR tm = pa THEN 0 ELSE (counter - pc) / (tm - pa) END, 6) AS rate, peak FROM l""")
def counter_rate(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("value IS NOT NULL")
    running = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"counter": F.sum(F.floor(F.abs("value")).cast("double")).over(running), "at": F.col("us") / 1e6})
    found = monitor.counter_rates(rows, "user_id", "at", "counter", ["event_id"])
    return found.select("user_id", "event_id", F.round("rate", 6).alias("rate"), "peak")


@query("SELECT user_id, " + ", ".join(f"max_by(value, (ts, event_id)) FILTER (event_type = '{t}') AS \"{t}\"" for t in ("click", "purchase", "view")) + " FROM events GROUP BY 1")
def pivot_wide(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("order", F.struct("us", "event_id"))
    return compare.wide(rows, ["user_id"], "event_type", "value", "order", ["click", "purchase", "view"])


@query("""
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' WHEN a.s <> b.s OR a.p <> b.p THEN 'changed' ELSE 'same' END AS state
    FROM (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0) a
    FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 0) b
    ON a.o_orderkey = b.o_orderkey""")
def outer_diff(spark, sf_dir):
    """Two snapshots of orders: either lacks some keys (the snapshots' definition), and one has changed states."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    before = orders.filter("o_orderkey % 7 <> 0")
    after = orders.filter("o_orderkey % 5 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("s")))
    return compare.outer_diff(before, after, ["o_orderkey"], ["s", "p"]).select("o_orderkey", "state")


@query("""
    SELECT sn.n_name AS supplier_nation, coalesce(cn.n_name, 'unknown') AS customer_nation, count(*) AS n, round(sum(l.l_extendedprice), 2) AS price
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey
    LEFT JOIN nation sn ON sn.n_nationkey = s.s_nationkey LEFT JOIN nation cn ON cn.n_nationkey = c.c_nationkey AND cn.n_regionkey < 4
    WHERE sn.n_name IS NOT NULL GROUP BY ALL""")
def role_playing_lookup(spark, sf_dir):
    """Facts with the same small dimension in two roles, one with a default; the dimension is of countries, so it is broadcast."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nations = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))), "s_nationkey", "left")
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nations.filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))), "c_nationkey", "left")
    rows = (
        lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(supplier.select("s_suppkey", "supplier_nation"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(customer.select("c_custkey", "customer_nation"), F.col("c_custkey") == F.col("o_custkey"))
    )
    return rows.filter("supplier_nation IS NOT NULL").groupBy("supplier_nation", F.coalesce("customer_nation", F.lit("unknown")).alias("customer_nation")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query("""
    SELECT l_orderkey, score, row_number() OVER (ORDER BY score DESC, l_orderkey) AS rank FROM (
      SELECT l_orderkey, 5 * count(*) FILTER (l_returnflag = 'R') + 2 * count(*) FILTER (l_returnflag = 'A') + 3 * count(*) FILTER (l_quantity < 5) + count(*) FILTER (l_quantity < 10) AS score
      FROM lineitem GROUP BY 1) ORDER BY score DESC, l_orderkey LIMIT 25""")
def worst_k(spark, sf_dir):
    """The 25 orders of greatest error score, as a report of the worst."""
    count = F.count_if
    score = 5 * count(F.col("l_returnflag") == "R") + 2 * count(F.col("l_returnflag") == "A") + 3 * count(F.col("l_quantity") < 5) + count(F.col("l_quantity") < 10)
    top = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(score.alias("score")).orderBy(F.desc("score"), "l_orderkey").limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "l_orderkey")).cast("long"))


@query("""
    SELECT metric, count(value) AS count, round(avg(value), 4) AS mean, min(value) AS min, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS max
    FROM (UNPIVOT (SELECT c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_acctbal FROM customer) ON COLUMNS(*) INTO NAME metric VALUE value) GROUP BY 1""")
def numeric_profile(spark, sf_dir):
    found = compare.profile(table(spark, sf_dir, "customer"))
    return found.select("metric", "count", F.round("mean", 4).alias("mean"), "min", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")], "max")


@query("""
    SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'returned' ELSE 'kept' END AS bucket, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
           count(DISTINCT l_suppkey) = 1 AS all_equal, round(count(*) FILTER (l_quantity > 25) / count(*), 9) AS large_ratio FROM lineitem GROUP BY 1, 2""")
def combined_buckets(spark, sf_dir):
    bucket = F.when(F.col("l_returnflag").isin("A", "R"), "returned").otherwise("kept")
    return table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket"), "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("l_suppkey").alias("suppliers"),
        (F.countDistinct("l_suppkey") == 1).alias("all_equal"),
        F.round(F.count_if(F.col("l_quantity") > 25) / F.count(F.lit(1)), 9).alias("large_ratio"),
    )


@query("""
    WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), l AS (SELECT metric, value, CASE WHEN metric = 'click' THEN 'min' ELSE 'max' END AS direction, 50.0 AS "limit" FROM m)
    SELECT metric, direction, CASE WHEN direction = 'min' THEN value >= "limit" ELSE value <= "limit" END AS passed, bool_and(CASE WHEN direction = 'min' THEN value >= "limit" ELSE value <= "limit" END) OVER () AS accepted FROM l""")
def decision_gate(spark, sf_dir):
    """Each metric against its limit, and whether all hold."""
    means = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    limits = means.withColumns({"direction": F.when(F.col("metric") == "click", "min").otherwise("max"), "limit": F.lit(50.0)})
    passed = stats.gate(F.col("value"), F.col("limit"), F.col("direction"))
    return limits.select("metric", "direction", passed.alias("passed")).withColumn("accepted", F.every("passed").over(Window.partitionBy()))


@query()
def stream_rate_state(spark, sf_dir):
    """Rates and running peaks by a stateful stream over the events' files, run to the end of its source.

    Samples come as one file source; the state is one sample for each user.
    """
    from uuid import uuid4

    folder = (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_lathework").rstrip("/") + f"/stream-{uuid4().hex}"
    samples = _events(spark, sf_dir).filter("value IS NOT NULL").select(
        F.col("user_id").cast("string").alias("source"), (F.col("us") / 1e6).alias("at"), F.floor(F.abs("value")).cast("double").alias("counter")
    )
    samples.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(samples.schema).parquet(f"{folder}/in")
    run = (
        monitor.stream_rates(source).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(monitor.RATE_SCHEMA).parquet(f"{folder}/out")
