"""Queries over scalars, predicates, gates and documents of the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathework.functions import geometry, scalars, stats
from lathework.operators import compare, selection
from lathework.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity FROM lineitem
    WHERE l_quantity < 10 OR (l_orderkey % 4 IN (0, 3) AND l_returnflag IN ('R', 'N'))""")
def member_filter(spark, sf_dir):
    rows = selection.members(table(spark, sf_dir, "lineitem"), {"l_returnflag": ["R", "N"]}, F.col("l_orderkey") % 4, [0, 3], F.col("l_quantity") < 10)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")


@query("""
    SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%green%' THEN 'color' WHEN lower(p_type) LIKE 'promo%' THEN 'promo' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS tag,
      regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part""")
def tagged_parts(spark, sf_dir):
    rules = {"color": F.lower("p_name").like("%green%"), "promo": F.lower("p_type").like("promo%"), "large": F.col("p_size") > 40}
    return table(spark, sf_dir, "part").select("p_partkey", selection.first_tag(rules, "other").alias("tag"), scalars.normal_name(F.col("p_type")).alias("name"))


@query("""
    WITH s AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS size FROM events)
    SELECT event_type, count(*) AS kept, round(avg(value), 6) AS mean FROM s WHERE size <= 20 OR n > 10 AND n <= size - 10 GROUP BY 1""")
def steady_state(spark, sf_dir):
    rows = selection.trimmed(table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"], 10)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
    WITH c AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2)
    SELECT priority, count(*) AS groups, min(n) = max(n) AS all_equal, min(customers) = max(customers) AS customers_equal FROM c GROUP BY 1""")
def all_equal_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("groups"), stats.all_equal(F.col("n")).alias("all_equal"), stats.all_equal(F.col("customers")).alias("customers_equal"))


@query("""
    WITH g AS (SELECT l_returnflag, l_linestatus, l_shipmode, year(l_shipdate) AS y, sum(l_quantity) AS q, count(*) AS n FROM
      (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS l_shipmode FROM (SELECT l_returnflag, l_linestatus, l_shipdate, l_quantity, l_linenumber FROM lineitem)) GROUP BY 1, 2, 3, 4)
    SELECT l_returnflag, l_linestatus, l_shipmode, count(*) AS frames, round(sum(q), 4) AS total, round(sum(q) / 7.0, 6) AS per_frame, round(sum(n) / 7.0, 6) AS calls_per_frame FROM g GROUP BY 1, 2, 3""")
def per_frame_groups(spark, sf_dir):
    side = F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("l_shipmode")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", side, F.year("l_shipdate").alias("frame"), "l_quantity")
    found = stats.per_frame(rows, ["l_returnflag", "l_linestatus", "l_shipmode"], "frame", "l_quantity", 7)
    return found.select("l_returnflag", "l_linestatus", "l_shipmode", "frames", F.round("total", 4).alias("total"), F.round("per_frame", 6).alias("per_frame"), F.round("calls_per_frame", 6).alias("calls_per_frame"))


@query("""
    WITH m AS (SELECT c_mktsegment AS variant, c_nationkey AS metric, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1, 2)
    SELECT a.metric, a.variant, b.variant AS against, round(a.value - b.value, 4) AS difference, round(abs(a.value - b.value), 4) AS distance
    FROM m a JOIN m b ON b.metric = a.metric AND a.variant < b.variant""")
def variant_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("variant"), F.col("c_nationkey").alias("metric")).agg(F.round(F.avg("c_acctbal"), 4).alias("value"))
    found = compare.variant_pairs(rows, "variant", ["metric"], "value")
    return found.select("metric", "variant", "against", F.round("difference", 4).alias("difference"), F.round("distance", 4).alias("distance"))


@query("""
    SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation)""")
def key_union(spark, sf_dir):
    sides = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return compare.union_of_keys(sides)


@query("""
    WITH a AS (SELECT doc_id, floor(doc_id / 50)::BIGINT AS g, n_chars FROM documents)
    SELECT x.doc_id AS a, y.doc_id AS b, abs(x.n_chars - y.n_chars)::BIGINT AS apart FROM a x JOIN a y ON x.g = y.g AND x.doc_id < y.doc_id
    WHERE abs(x.n_chars - y.n_chars) <= 2 OR x.doc_id % 8 = y.doc_id % 8 AND abs(x.n_chars - y.n_chars) <= 20""")
def disjunctive_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).alias("g"), F.col("n_chars").cast("long").alias("n"))
    return compare.disjunctive_pairs(rows, "doc_id", "g", "n", 2, [((F.col("doc_id") % 8), 20)])


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) - 1 AS slot FROM s WHERE l_discount >= 0.05)
    SELECT l_orderkey, idx, slot::INT AS slot, slot < 3 AS stored FROM k""")
def stable_compaction(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("idx"), "l_discount")
    return selection.compacted(rows, ["l_orderkey"], "idx", F.col("l_discount") >= 0.05, 3).select("l_orderkey", F.col("idx").cast("long").alias("idx"), "slot", "stored")


@query("""
    WITH s AS (SELECT l_orderkey, l_discount, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM lineitem),
    n AS (SELECT unnest(range(8))::INT AS slot)
    SELECT o.l_orderkey, n.slot, s.idx, s.l_tax AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN n
    LEFT JOIN s ON s.l_orderkey = o.l_orderkey AND s.idx = n.slot + 1 AND s.l_discount >= 0.05""")
def fixed_slots(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).cast("long").alias("idx"), "l_discount", F.col("l_tax").alias("value"))
    return selection.slots(rows, ["l_orderkey"], "idx", F.col("l_discount") >= 0.05, "value", 8)


@query("""
    SELECT c_custkey, c_name, regexp_replace(c_name, '\\s*\\(\\d+\\)$', '') AS plain, replace(replace(c_name, '#', '_'), '/', '__') AS flat,
      try_cast(replace(regexp_extract(c_name, '([0-9,]+)$', 1), ',', '') AS DOUBLE) AS number FROM customer""")
def name_scalars(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", scalars.without_copy_number(name).alias("plain"), scalars.flat_path(F.replace(name, F.lit("#"), F.lit("_"))).alias("flat"),
        scalars.number_with_commas(F.regexp_extract(name, "([0-9,]+)$", 1)).alias("number"),
    )


@query("""
    SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_retailprice * 1024 WHEN 1 THEN p_retailprice * 1048576 WHEN 2 THEN p_retailprice * 1073741824 ELSE p_retailprice END, 2) AS bytes,
      round(CASE p_size % 3 WHEN 0 THEN p_retailprice / 1000 WHEN 1 THEN p_retailprice ELSE p_retailprice * 1000 END, 6) AS ms FROM part""")
def unit_conversions(spark, sf_dir):
    size = F.element_at(F.array(*map(F.lit, ("KB", "MB", "GB", "B"))), (F.col("p_size") % 4 + 1).cast("int"))
    span = F.element_at(F.array(*map(F.lit, ("us", "ms", "s"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(scalars.in_bytes(F.col("p_retailprice"), size), 2).alias("bytes"), F.round(scalars.in_milliseconds(F.col("p_retailprice"), span), 6).alias("ms")
    )


@query("""
    WITH d AS (SELECT n_nationkey, n_name, n_regionkey FROM nation)
    SELECT n_nationkey, 'name' AS path, n_name AS value FROM d UNION ALL SELECT n_nationkey, 'region.key', n_regionkey::VARCHAR FROM d
    UNION ALL SELECT n_nationkey, 'region.tags[0]', n_name FROM d UNION ALL SELECT n_nationkey, 'region.tags[1]', (n_regionkey + 1)::VARCHAR FROM d""")
def flattened_paths(spark, sf_dir):
    tags = F.array("n_name", (F.col("n_regionkey") + 1).cast("string"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key"), tags.alias("tags")).alias("region")).alias("doc"))
    return scalars.flattened(rows, "n_nationkey", "doc")


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax * 100 AS y, l_discount * 100 + 1 AS w, l_quantity / 2 + 1 AS h, l_partkey FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(x - w / 2, 6) AS x1, round(y - h / 2, 6) AS y1, round(x + w / 2, 6) AS x2, round(y + h / 2, 6) AS y2, round(w * h, 6) AS area FROM b""")
def corner_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_discount") * 100 + 1).alias("w"), (F.col("l_quantity") / 2 + 1).alias("h")
    )
    box = geometry.xyxy(*(F.col(c) for c in "xywh"))
    back = geometry.area(box)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(box[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round(back, 6).alias("area"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return compare.key_repeats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS before, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS after FROM orders GROUP BY 1)
    SELECT p AS priority, round(1 - after / before, 9) AS reduction, round((after - before) / before * 100, 6) AS improvement FROM m""")
def reductions(spark, sf_dir):
    price = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(price("F").alias("before"), price("O").alias("after"))
    return rows.select("priority", F.round(stats.reduction(F.col("after"), F.col("before")), 9).alias("reduction"), F.round(stats.improvement(F.col("after"), F.col("before"), True), 6).alias("improvement"))


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6, 6) AS elapsed FROM events""")
def elapsed_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return scalars.elapsed(rows, "ts").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.round("elapsed", 6).alias("elapsed"))


@query("""
    SELECT user_id, max_by(event_id, struct_pack(v := value, i := -event_id)) AS event_id FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY 1""")
def best_event(spark, sf_dir):
    return selection.best(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id")


@query("""
    WITH p AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50), event_id) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, event_id FROM p WHERE n = 1""")
def probe_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    return selection.nearest(rows, ["event_type"], F.col("value"), 50.0, "event_id").select("event_type", "event_id")


@query("""
    SELECT c_custkey, coalesce(o.n, 0) AS n, CASE WHEN coalesce(o.n, 0) = 0 THEN 'none' WHEN o.n = 1 THEN 'single' WHEN o.n < 10 THEN 'some' ELSE 'many' END AS mode, coalesce(o.kind, concat('copy_kind_', (c_custkey % 7)::VARCHAR)) AS kind
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS kind FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""")
def default_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("kind"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(found, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mode = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("n") < 10, "some").otherwise("many")
    return rows.select("c_custkey", "n", mode.alias("mode"), F.coalesce("kind", F.concat(F.lit("copy_kind_"), (F.col("c_custkey") % 7).cast("string"))).alias("kind"))
