"""Document fingerprints by Order MinHash, in DataFrame functions alone (operator 5).

A text's k-mers are its runs of ``k`` words (a shorter text is one k-mer); the n-th
occurrence of a k-mer in the text is an element of its own. Under each of
``2 x tuples`` hash orders the least element is selected, with its place in the text;
each two of them, in text order, are hashed to one tuple. Likeness is the share of equal tuples,
which falls both as words differ and as they change places, so it follows edit
distance rather than set overlap. Equal texts have equal fingerprints.

Scale: texts are shuffled once, by ranges of ``doc_id`` (from approximate quantiles, a
fixed number of them), so that each document and its successor meet; k-mers are
exploded within a task and folded there into one row of minima for each text. No
k-mer is shuffled and no group is collected.

Defined cases: a null text is empty; an empty text has no k-mers and a fingerprint of
its own, equal to that of other empty texts (likeness 1); documents stand by descending
``doc_id``, null ids last, ties by text; a lone document is its own successor; texts of
more than 16,777,215 words keep their order up to that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm import common

_PLACE = (1 << 24) - 1  # low bits: place in the text; high 40 bits: hash


def _with_place(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)


def _rotated(x: Column, bits: int) -> Column:
    return x if not bits else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def elements(df: DataFrame, text: str, k: int) -> DataFrame:
    """``df`` with ``elements``: occurrence-numbered k-mers as hash and place, by hash."""
    white = " \t\n\x0b\x0c\r"
    words = F.split(F.btrim(text, F.lit(white)), "[\\x20\\x09-\\x0D]+")
    codes = F.when(F.btrim(text, F.lit(white)) == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(words, lambda w: F.xxhash64(w))
    )
    df = df.withColumn("_codes", codes)
    n = F.size("_codes")
    grams = F.transform(
        F.slice("_codes", F.lit(1), F.greatest(n - (k - 1), F.least(n, F.lit(1)))),
        lambda x, i: _with_place(
            F.xxhash64(x, *[F.get("_codes", i + j) for j in range(1, k)]),
            F.least(i, F.lit(_PLACE)).cast("long"),
        ),
    )
    df = df.withColumn("_sorted", F.sort_array(grams)).drop("_codes")
    starts = F.filter(
        F.transform(
            "_sorted",
            lambda x, i: F.when(
                (i == 0) | (F.shiftright(x, 24) != F.shiftright(F.get("_sorted", i - 1), 24)), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("_starts", starts)
    numbered = F.transform(
        "_starts",
        lambda s, r: F.transform(
            F.slice("_sorted", s + 1, F.coalesce(F.get("_starts", r + 1), F.size("_sorted")) - s),
            lambda x, occurrence: _with_place(
                F.xxhash64(F.shiftright(x, 24), occurrence), x.bitwiseAND(F.lit(_PLACE))
            ),
        ),
    )
    return df.withColumn("elements", F.flatten(numbered)).drop("_sorted", "_starts")


def tuples_of(df: DataFrame, keys: list[str], n_tuples: int) -> DataFrame:
    """One row for each ``keys`` (from ``elements``): ``tuples``, an array of ``n_tuples`` hashes."""
    rows = df.select(*keys, F.explode_outer("elements").alias("_x"))
    hashes = [F.xxhash64(F.shiftright("_x", 24), F.lit(seed)).alias(f"_h{seed}") for seed in range((2 * n_tuples + 3) // 4)]
    rows = rows.select(*keys, F.col("_x").bitwiseAND(F.lit(_PLACE)).alias("_p"), *hashes)
    minima = [
        F.min(_with_place(_rotated(F.col(f"_h{i // 4}"), 16 * (i % 4)), F.col("_p"))).alias(f"_m{i}")
        for i in range(2 * n_tuples)
    ]
    least = rows.groupBy(*keys).agg(*minima)

    def pair(i: int) -> Column:
        a, b = F.col(f"_m{2 * i}"), F.col(f"_m{2 * i + 1}")
        first, second = F.shiftright(a, 24), F.shiftright(b, 24)
        in_order = a.bitwiseAND(F.lit(_PLACE)) <= b.bitwiseAND(F.lit(_PLACE))
        return F.when(in_order, F.xxhash64(first, second, F.lit(i))).otherwise(F.xxhash64(second, first, F.lit(-1 - i)))

    return least.select(*keys, F.array(*[pair(i) for i in range(n_tuples)]).alias("tuples"))


def signature_text(tuples: Column) -> Column:
    """Eight hex digits for each tuple."""
    return F.concat_ws("", F.transform(tuples, lambda x: F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8)))))


def likeness(a: Column, b: Column, n_tuples: int) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(n_tuples))


def fingerprints(docs: DataFrame, k: int = 3, n_tuples: int = 32) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is the document's, with its last floor(n_chars/2) code points
    replaced by the first as many (or all) of the next document's, by descending id.
    """
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    texts = common.texts_of(docs)
    cuts = texts.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    ranged = texts.withColumn(
        "part", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    )
    by_id = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "text")

    # the first row of each range; as many rows as ranges
    tops = ranged.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    heads = (
        ranged.alias("r")
        .join(F.broadcast(tops).alias("t"), F.expr("r.part = t.part AND r.doc_id <=> t.doc_id"))
        .groupBy("r.part")
        .agg(F.min("text").alias("head"))
    )
    around = Window.partitionBy(F.lit(1)).orderBy(F.col("part").desc())
    nexts = heads.select(
        F.col("part").alias("head_part"),
        F.coalesce(F.lead("head").over(around), F.first("head").over(around)).alias("head"),
    )
    ordered = ranged.select(
        "part", "doc_id", "text", F.row_number().over(by_id).alias("place"), F.lead("text").over(by_id).alias("follower")
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = (
        ordered.join(nexts, (F.col("part") == F.col("head_part")) & F.col("follower").isNull(), "left")
        .withColumn("n_chars", n.cast("long"))
        .withColumn(
            "edited",
            F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("follower", "head"), F.lit(1), half)),
        )
        .select(
            "part",
            "place",
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            F.posexplode(F.array("text", "edited")).alias("side", "own"),
        )
    )
    keys = ["part", "place", "doc_id", "n_chars", "edited_sha256", "side"]
    signed = tuples_of(elements(both, "own", k).select(*keys, "elements"), keys, n_tuples)
    rows = signed.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("side") == 0, F.col("tuples"))).alias("own"),
        F.max(F.when(F.col("side") == 1, F.col("tuples"))).alias("changed"),
    )
    in_place = Window.partitionBy("part").orderBy("place")
    rows = common.materialize(rows.withColumn("following", F.lead("own").over(in_place)), "fingerprints")
    tops = rows.filter("place = 1").select(F.col("part").alias("head_part"), F.col("own").alias("top"))
    after = tops.select("head_part", F.coalesce(F.lead("top").over(Window.partitionBy(F.lit(1)).orderBy(F.col("head_part").desc())), F.first("top").over(Window.partitionBy(F.lit(1)).orderBy(F.col("head_part").desc()))).alias("top"))
    return rows.join(
        F.broadcast(after), (F.col("part") == F.col("head_part")) & F.col("following").isNull(), "left"
    ).select(  # broadcast: one signature for each range
        "doc_id",
        "n_chars",
        "edited_sha256",
        signature_text(F.col("own")).alias("fingerprint"),
        signature_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), n_tuples).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("following", "top"), n_tuples).alias("near_next"),
    )


def op5_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
