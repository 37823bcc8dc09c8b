"""Substring dedup by seed and extend over winnowed anchors (operator 7).

A window is ``length`` consecutive words (runs without ASCII white space) of one
document. A word is removed if a window covers it whose word sequence also starts
in a document with a smaller ``doc_id``.

Seed: the anchor of a window is the least hash among its 4-word grams (winnowing).
It depends on the window's words alone, so equal windows have equal anchors, and a
window whose anchor stands in one document only cannot repeat. Neighbouring windows
mostly share an anchor: such a run is one row. Extend: the runs of an anchor that
documents share are extended to the left and right to every window that the anchor
holds; windows are joined on (anchor, 64-bit hash of all their words), 128 bits
together, with the least document that has them. Keep: runs of covered words are the
maximal repeats, none shorter than ``length``.

Scale: the scan is run twice, for the anchors alone (aggregated before the shuffle) and
for the runs with their windows' hashes, so the joins move hashes and places, never
texts; texts are shuffled once, to meet the places to remove. The joins on anchors and
windows are plain equi-joins, which Spark splits where a key is hot. What is collected
is one document's places, a set.

Defined cases: a null or empty text has no words; a null ``doc_id`` is not smaller
than any and none is smaller than it (nothing is removed from it); rows that share
a ``doc_id`` do not remove each other's words; texts below ``length`` words lose none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import common
from lathework.llm.kernels import SpanHash, Words, gram_hashes, scan_words, sliding_min

GRAM = 4
#: Runs in one Arrow batch.
SLICE = 20_000


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` words within one text, and the hash of each one's anchor."""
    if len(words.codes) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    anchors = sliding_min(gram_hashes(words.codes, GRAM), length - GRAM + 1)
    at = np.flatnonzero(words.of[: len(anchors)] == words.of[length - 1 :])
    return at, anchors[at]


def _runs(owner: np.ndarray, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a new run begins: another anchor, another text, a gap, or after some 1,024 windows."""
    new = at % 1024 == 0
    new[:1] = True
    new[1:] |= (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def _seeds(length: int):
    def scan(batches):
        hasher = SpanHash()
        for batch in batches:
            for words in scan_words(batch.column(1), hasher):
                at, anchors = _anchors(words, length)
                new = _runs(words.of[at], anchors, at)
                if len(new):
                    rows = pa.array(words.first + words.of[at[new]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors[new].view(np.int64)), batch.column(0).take(rows)], ["anchor", "doc_id"]
                    )

    return scan


def _extended(length: int):
    def scan(batches):
        hasher = SpanHash()
        for batch in batches:
            for words in scan_words(batch.column(2), hasher):
                at, anchors = _anchors(words, length)
                new = _runs(words.of[at], anchors, at)
                if not len(new):
                    continue
                windows = gram_hashes(words.codes, length, 1)[at].view(np.int64)
                owner = words.of[at[new]]
                rows = pa.array(words.first + owner)
                for lo in range(0, len(new), SLICE):
                    some = slice(lo, lo + SLICE)
                    own, ends = new[some], np.append(new, len(at))[lo : lo + SLICE + 1][-1]
                    offsets = np.append(own, ends).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors[own].view(np.int64)),
                            batch.column(0).take(rows[some]),
                            batch.column(1).take(rows[some]),
                            pa.array((at[own] - words.bounds[owner[some]]).astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(windows[offsets[0] : ends])),
                        ],
                        ["anchor", "doc_id", "row_key", "at", "windows"],
                    )

    return scan


def _sliced(batches):
    """The batches in slices of some 200 rows, so that a slice's words and kept texts are all that is held."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            yield batch.slice(lo, 200)


def _kept(length: int):
    def scan(batches):
        for batch in _sliced(batches):
            n_words, n_removed, digest, kept_texts = [], [], [], []
            for text, starts in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                words = text.as_py().split()
                n_words.append(len(words))
                if starts.is_valid and len(starts.values):
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.asarray(starts.values.to_numpy(zero_copy_only=False))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    n_removed.append(int(len(words) - keep.sum()))
                    words = [words[j] for j in np.flatnonzero(keep)]
                else:
                    n_removed.append(0)
                kept = b" ".join(words)
                kept_texts.append(kept)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(kept_texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return scan


def substring_dedup(docs: DataFrame, length: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for each document."""
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    rows = common.texts_of(docs).withColumn("row_key", F.xxhash64("text"))
    several = common.materialize(
        rows.groupBy("doc_id").agg((F.min("row_key") != F.max("row_key")).alias("several")).filter("several"), "several"
    )
    if several.take(1):
        key = F.when(F.col("several"), F.col("row_key")).otherwise(0)
        rows = rows.join(several, "doc_id", "left").select("doc_id", "text", key.alias("row_key"))
    else:  # each id has one text: a key of zero costs next to nothing in a shuffle
        rows = rows.withColumn("row_key", F.lit(0).cast("long"))
    known = rows.filter("doc_id IS NOT NULL").select("doc_id", "row_key", "text")
    shared = common.materialize(
        known.select("doc_id", "text")
        .mapInArrow(_seeds(length), "anchor long, doc_id long")
        .groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("anchor"),
        "anchors",
    )
    runs = known.mapInArrow(_extended(length), "anchor long, doc_id long, row_key long, at int, windows array<long>")
    windows = common.materialize(
        runs.join(shared, "anchor")
        .select("anchor", "doc_id", "row_key", "at", F.posexplode("windows").alias("step", "window"))
        .select("anchor", "window", "doc_id", "row_key", (F.col("at") + F.col("step")).alias("at")),
        "windows",
    )
    first = common.materialize(
        windows.groupBy("anchor", "window")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("anchor", "window", "first"),
        "first",
    )
    covered = common.materialize(
        windows.join(first, ["anchor", "window"])
        .filter("first < doc_id")
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set("at").alias("starts")),
        "covered",
    )
    return (
        rows.join(covered, ["doc_id", "row_key"], "left")
        .select("doc_id", "text", "starts")
        .mapInArrow(
            _kept(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
        )
    )


def op7_substring_dedup(spark, sf_dir):
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same rows by windows joined as strings.
ORACLE = r"""
    WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
    first AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
    hit AS (SELECT DISTINCT r, i + o AS p FROM win JOIN first USING (k) CROSS JOIN range(13) t(o) WHERE first < win.doc_id),
    words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    kept AS (SELECT words.r, count(hit.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (hit.p IS NULL) AS kept
             FROM words LEFT JOIN hit ON hit.r = words.r AND hit.p = words.p GROUP BY 1)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.r = w.r"""
