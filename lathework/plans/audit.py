"""Dataset audit queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.functions import geometry, hashes
from lathework.operators import compare, dedup, quality, sampling, similarity
from lathework.sources import files
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
    SELECT sha256(text) AS sha256, count(*) AS group_size,
           min(source) <> max(source) AS cross_split, min(doc_id) AS first_member
    FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def exact_duplicate_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return dedup.exact_groups(docs, F.col("text"), F.col("doc_id"), F.col("source"))


@query("""
    SELECT format('exact_{:04d}', dense_rank() OVER (ORDER BY sha256)) AS group_id, sha256, doc_id, source, group_size
    FROM (SELECT sha256(text) AS sha256, doc_id, source, count(*) OVER (PARTITION BY sha256(text)) AS group_size
          FROM documents WHERE text IS NOT NULL) WHERE group_size >= 2""")
def exact_duplicate_members(spark, sf_dir):
    """Members of each group, with the group's number by hash order; the numbering ranks groups, not rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    groups = docs.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size >= 2")
    named = dedup.numbered(groups, "sha256", "exact_%04d", "group_id")
    return docs.join(named, "sha256").select("group_id", "sha256", "doc_id", "source", "group_size")


@query("""
    SELECT doc_id, 'left_only' AS side FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL
    SELECT doc_id, 'right_only' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""")
def orphan_audit(spark, sf_dir):
    return compare.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_TOTAL_ORDER = ", ".join(_LINE[1:])


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_LINE[2:])}) > 1 AS again FROM lineitem),
    i AS (
      SELECT l_orderkey, l_linenumber, 'duplicate_key' AS kind FROM r WHERE again
      UNION ALL SELECT l_orderkey, l_linenumber, 'quantity_out_of_range' FROM r WHERE l_quantity < 2 OR l_quantity > 49
      UNION ALL SELECT l_orderkey, l_linenumber, 'discount_out_of_range' FROM r WHERE l_discount > 0.09
      UNION ALL SELECT l_orderkey, l_linenumber, 'tax_above_discount' FROM r WHERE l_tax > l_discount + 0.07
      UNION ALL SELECT l_orderkey, l_linenumber, 'flag_and_status' FROM r WHERE l_returnflag = 'R' AND l_linestatus = 'O')
    SELECT l_orderkey, l_linenumber, kind, count(*) AS n FROM i GROUP BY ALL""")
def rule_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rules = {
        "duplicate_key": quality.repeated(["l_orderkey", "l_linenumber"], _LINE[2:]),
        "quantity_out_of_range": (F.col("l_quantity") < 2) | (F.col("l_quantity") > 49),
        "discount_out_of_range": F.col("l_discount") > 0.09,
        "tax_above_discount": F.col("l_tax") > F.col("l_discount") + 0.07,
        "flag_and_status": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
    }
    return quality.issues(lines, rules, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH f AS (SELECT DISTINCT l_returnflag AS flag FROM lineitem), s AS (SELECT DISTINCT l_linestatus AS status FROM lineitem),
    c AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2),
    g AS (SELECT f.flag, s.status, coalesce(c.n, 0) AS n FROM f CROSS JOIN s LEFT JOIN c ON c.flag = f.flag AND c.status = s.status)
    SELECT flag, status, n FROM g UNION ALL SELECT 'all', status, sum(n)::BIGINT FROM g GROUP BY status
    UNION ALL SELECT flag, 'all', sum(n)::BIGINT FROM g GROUP BY flag UNION ALL SELECT 'all', 'all', sum(n)::BIGINT FROM g""")
def class_counts_with_total(spark, sf_dir):
    """Counts of each flag and status on the dense grid, with totals; the grid is of distinct values only."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("flag").distinct().crossJoin(counts.select("status").distinct())
    dense = grid.join(counts, ["flag", "status"], "left").select("flag", "status", F.coalesce("n", F.lit(0)).alias("n"))
    rolled = dense.cube("flag", "status").agg(F.sum("n").alias("n"))
    return rolled.select(F.coalesce("flag", F.lit("all")).alias("flag"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("""
    SELECT l_returnflag, CASE WHEN v < 0.0025 THEN 'tiny' WHEN v < 0.01 THEN 'small' WHEN v < 0.04 THEN 'medium' ELSE 'large' END AS ratio_bin,
           CASE WHEN p < 1024.0 THEN 'small' WHEN p < 9216.0 THEN 'medium' ELSE 'large' END AS pixel_bin, count(*) AS n
    FROM (SELECT l_returnflag, l_quantity * l_extendedprice / 1e8 AS v, l_extendedprice / 5 AS p FROM lineitem) GROUP BY ALL""")
def size_buckets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        "l_returnflag",
        geometry.size_by_ratio(F.col("l_quantity") * F.col("l_extendedprice") / 1e8).alias("ratio_bin"),
        geometry.size_by_pixels(F.col("l_extendedprice") / 5).alias("pixel_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


_PRIORITY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@query("""
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '1' WHEN '3-MEDIUM' THEN '2' ELSE o_orderpriority END AS class,
           o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS dropped, count(*) AS n FROM orders GROUP BY 1, 2""")
def category_remap(spark, sf_dir):
    kept, dropped = quality.remap(table(spark, sf_dir, "orders"), "o_orderpriority", _PRIORITY, "n")
    counted = kept.groupBy(F.col("o_orderpriority").cast("string").alias("class"), F.lit(False).alias("dropped")).agg(F.count(F.lit(1)).alias("n"))
    return counted.union(dropped.select(F.col("o_orderpriority").alias("class"), F.lit(True).alias("dropped"), "n"))


@query("""
    SELECT l_orderkey, l_linenumber, l_linenumber - expected AS gap, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM lineitem)
    WHERE l_linenumber <> expected GROUP BY ALL""")
def contiguity(spark, sf_dir):
    found = quality.contiguous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", first=1)
    return found.groupBy("l_orderkey", "l_linenumber", (F.col("l_linenumber") - F.col("expected")).cast("long").alias("gap")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT event_type, count(*) AS n, count(*) FILTER (k % 2 = 0) AS even, round(avg(k), 6) AS mean_k, max(k) AS max_k
    FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_path_project(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") % 2 == 0).alias("even"), F.round(F.avg("k"), 6).alias("mean_k"), F.max("k").alias("max_k")
    )


@query(r"""
    SELECT CAST(n AS BIGINT) // 20 AS block, count(*) AS n, min(CAST(n AS BIGINT)) AS first, max(c_custkey) AS last_key
    FROM (SELECT c_custkey, regexp_extract(c_name, '(\d+)$', 1) AS n FROM customer) WHERE n <> '' GROUP BY 1""")
def regex_metrics(spark, sf_dir):
    number = hashes.trailing_number(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", number.alias("number")).filter("number IS NOT NULL")
    return rows.groupBy(F.expr("number div 20").alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("first"), F.max("c_custkey").alias("last_key")
    )


@query(r"""
    SELECT regexp_extract(url, '^(\w+)://([^/]+)/', 2) AS host, count(*) AS n, max(len(regexp_extract_all(url, '\d+'))) AS most_numbers,
           min(list_extract(regexp_extract_all(url, '\d+'), -1)) AS least_last
    FROM pages GROUP BY 1""")
def url_fields(spark, sf_dir):
    numbers = F.regexp_extract_all("url", F.lit(r"(\d+)"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^(\w+)://([^/]+)/", 2).alias("host"), numbers.alias("numbers"), files.last_match(F.col("url"), r"(\d+)").alias("last"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("numbers")).cast("long").alias("most_numbers"), F.min("last").alias("least_last"))


_HASHED = """
    h AS (SELECT vec_id, label, (SELECT sum(CASE WHEN embedding[i + 1] > embedding[i] THEN (1::BIGINT << (63 - i)) ELSE 0 END)::BIGINT
          FROM range(1, 64) t(i)) AS code FROM embeddings)"""
_PAIRS = f"""{_HASHED},
    p AS (SELECT l.vec_id AS a, r.vec_id AS b, bit_count(xor(l.code, r.code)) AS distance
          FROM h l JOIN h r ON l.vec_id < r.vec_id AND l.label <> r.label WHERE bit_count(xor(l.code, r.code)) <= 16)"""


def _codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", hashes.adjacent_bits(F.col("embedding")).alias("code"))


def _pairs(spark, sf_dir):
    codes = _codes(spark, sf_dir)
    other = F.col("l.label") != F.col("r.label")
    distance = hashes.hamming(F.col("l.code"), F.col("r.code"))
    # 17 bands of under four bits would prune nothing, so this far threshold is a plain theta join
    found = similarity.theta_pairs(codes, "vec_id", other & (distance <= 16))
    return found.select(F.col("l.vec_id").alias("a"), F.col("r.vec_id").alias("b"), distance.alias("distance"))


@query(f"WITH {_PAIRS} SELECT a, b, distance::INTEGER AS distance FROM p")
def near_dup_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH {_HASHED} SELECT l.vec_id AS a, r.vec_id AS b, bit_count(xor(l.code, r.code))::INTEGER AS distance FROM h l JOIN h r ON l.vec_id < r.vec_id WHERE bit_count(xor(l.code, r.code)) <= 5")
def banded_near_pairs(spark, sf_dir):
    return similarity.banded_pairs(_codes(spark, sf_dir), "vec_id", "code", 5)


@query(f"""
    WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    walk AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.vec_id),
    c AS (SELECT vec_id, min(root) AS root FROM walk GROUP BY 1)
    SELECT root, count(*) AS members, round(count(*) / (SELECT count(*) FROM c), 9) AS share, count(*) / (SELECT count(*) FROM c) <= 0.35 AS within FROM c GROUP BY 1""")
def components(spark, sf_dir):
    labelled = similarity.components(_codes(spark, sf_dir), _pairs(spark, sf_dir), "vec_id")
    return similarity.component_sizes(labelled).withColumn("share", F.round("share", 9))


@query("""
    SELECT l_returnflag, l_orderkey FROM (
      SELECT l_returnflag, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws('|', '42', l_orderkey)), l_orderkey) AS rank
      FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem)) WHERE rank <= 12""")
def seeded_sample(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    return sampling.per_class(keys, ["l_returnflag"], "l_orderkey", 12, 42).drop("rank")


@query("""
    SELECT o_orderstatus, o_orderkey FROM (
      SELECT o_orderstatus, o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n
      FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)) WHERE i % greatest(1, ceil(n / 100)::BIGINT) = 0""")
def strided_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return sampling.strided(rows, ["o_orderstatus"], ["o_orderkey"], 100)


@query("""
    WITH t AS (SELECT i FROM range(16) r(i)), w AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
    k AS (SELECT i, o_orderkey, o_orderpriority AS p, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws('|', i + 639, o_orderkey)), o_orderkey) AS r FROM orders CROSS JOIN t),
    g AS (SELECT i, p, count(*) AS got FROM k WHERE r <= 256 GROUP BY 1, 2),
    d AS (SELECT t.i, w.p, abs(coalesce(got, 0) / sum(coalesce(got, 0)) OVER (PARTITION BY t.i) - n / sum(n) OVER (PARTITION BY t.i)) AS gap
          FROM w CROSS JOIN t LEFT JOIN g ON g.i = t.i AND g.p = w.p),
    b AS (SELECT i, round(max(gap), 9) AS a, round(sum(gap), 9) AS s FROM d GROUP BY 1 ORDER BY 2, 3, 1 LIMIT 1)
    SELECT b.i::INTEGER AS candidate, b.a AS max_gap, b.s AS sum_gap, k.o_orderkey, k.p AS o_orderpriority FROM k JOIN b ON b.i = k.i WHERE r <= 256""")
def best_of_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.best_of(rows, "o_orderkey", "o_orderpriority", 256, 16, 639)


@query("""
    WITH a AS (SELECT o_orderpriority AS p, count(*) / sum(count(*)) OVER () AS s FROM orders GROUP BY 1),
    b AS (SELECT o_orderpriority AS p, count(*) / sum(count(*)) OVER () AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT a.p, round(a.s, 9) AS whole, round(coalesce(b.s, 0), 9) AS part, round(abs(a.s - coalesce(b.s, 0)), 9) AS gap FROM a LEFT JOIN b ON a.p = b.p""")
def proportion_deltas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    whole = sampling.proportions(orders, "o_orderpriority").select(F.col("o_orderpriority").alias("p"), F.col("share").alias("s"))
    part = sampling.proportions(orders.filter("o_orderstatus = 'F'"), "o_orderpriority").select(F.col("o_orderpriority").alias("p"), F.col("share").alias("t"))
    t = F.coalesce("t", F.lit(0.0))
    return whole.join(part, "p", "left").select("p", F.round("s", 9).alias("whole"), F.round(t, 9).alias("part"), F.round(F.abs(F.col("s") - t), 9).alias("gap"))


@query()
def grouped_split(spark, sf_dir):
    """Components of documents (equal texts) to train, val and test without leakage; the few large groups are assigned on the driver.

    Components are pooled into at most 512 buckets by a hash of their root, so that what the driver sees is bounded.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce(F.sha2("text", 256), F.lit("")).alias("root"))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(512)).cast("int"))
    sums = docs.groupBy("bucket", "lang").agg(F.count(F.lit(1)).alias("n")).collect()  # 512 buckets by languages
    import numpy as np

    place = {x: i for i, x in enumerate(sorted({r.lang for r in sums if r.lang is not None}), 1)}
    sizes = {str(r.bucket): np.zeros(len(place) + 2) for r in sums}
    for r in sums:
        sizes[str(r.bucket)][[0, place.get(r.lang, -1)]] += r.n  # rows of no language last
    found, _ = sampling.assign_groups(sizes, {"train": 0.7, "val": 0.15, "test": 0.15}, negatives=True)
    of = spark.createDataFrame([(int(b), s) for b, s in sorted(found.items())], "bucket int, assigned_split string")
    return docs.join(F.broadcast(of), "bucket").select("doc_id", "lang", "root", "assigned_split")  # at most 512 rows


@query("""SELECT 0::BIGINT AS leaking_groups, true AS shares_hold, count(DISTINCT coalesce(sha256(text), '')) AS groups FROM documents""")
def grouped_split_checks(spark, sf_dir):
    """Leaks across splits, whether shares are within 0.03, and the number of groups."""
    split = grouped_split(spark, sf_dir)
    groups = split.groupBy("root").agg((F.min("assigned_split") != F.max("assigned_split")).alias("leaks"))
    shares = sampling.proportions(split, "assigned_split")
    target = F.when(F.col("assigned_split") == "train", 0.7).otherwise(0.15)
    holds = shares.agg(F.every(F.abs(F.col("share") - target) <= 0.03).alias("shares_hold"))
    return groups.agg(F.count_if("leaks").alias("leaking_groups"), F.count(F.lit(1)).alias("groups")).crossJoin(holds).select("leaking_groups", "shares_hold", "groups")
