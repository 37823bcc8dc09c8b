"""Vector best-fit packing of token sequences (operator 4).

Each document becomes its token ids and a final id 0; only longer ones are cut, into
pieces of ``max_tokens``. A bin (sequence) has three capacities: tokens, documents and
attention cost (the sum of squared piece lengths). Pieces come by decreasing length;
each goes to the open bin that fits it under every capacity and leaves the least
weighted norm of residuals (``rule="norm"``) or has the largest weighted dot product
of demand and residual (``rule="dot"``); else a new bin opens. With the defaults only
tokens bind, so sequences are as few as best fit makes them.

Scale: pieces are dealt at random to groups of about ``group_pieces``, packed apart;
each group wastes less than about one bin, a fixed share of some 10,000 bins. Nothing
but piece lengths is shuffled; a document's text stays in its scan.

Defined cases: a null or empty text is the one piece of id 0; repeated rows and null
ids are pieces of their own; an empty table has no pieces.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import common
from lathework.llm.bpe import VectorBPE


def _pieces(path: str, max_tokens: int):
    def scan(batches):
        engine = VectorBPE(path)
        for batch in batches:
            owner, piece, length, crc = [], [], [], []
            for i, ids in engine.ids(batch.column(1).to_pylist()):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k in range(0, len(ids), max_tokens):
                    part = ids[k : k + max_tokens]
                    owner.append(i)
                    piece.append(k // max_tokens)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece),
                    pa.array(piece.astype(np.int64) * max_tokens),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return scan


def vector_best_fit(lengths, max_tokens, max_docs, max_cost, weights=(1.0, 0.05, 0.05), rule="norm"):
    """Bin number and offset of each piece; pieces must fit an empty bin."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 1
    caps = np.array([max_tokens, max_docs, max_cost], float)
    scale = np.asarray(weights, float) / caps**2
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, 1024))  # residuals of open bins
    names = np.empty(1024, np.int64)
    n_open = n_bins = 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > caps).any():
            raise ValueError("a piece exceeds an empty bin's capacities")
        best = -1
        if n_open:
            left = room[:, :n_open] - need[:, None]
            fits = (left >= 0).all(axis=0)
            if fits.any():
                if rule == "norm":
                    score = np.where(fits, scale @ (left * left), np.inf)
                else:
                    score = np.where(fits, -((scale * need) @ room[:, :n_open]), np.inf)
                best = int(score.argmin())
        if best < 0:
            if n_open == len(names):
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                names = np.concatenate([names, np.empty_like(names)])
            best, n_open = n_open, n_open + 1
            room[:, best], names[best] = caps, n_bins
            n_bins += 1
        bins[i], offsets[i] = names[best], max_tokens - int(room[0, best])
        room[:, best] -= need
        if room[0, best] < least or room[1, best] < 1 or room[2, best] < least * least:
            n_open -= 1  # nothing fits any more: the last open bin takes its place
            room[:, best], names[best] = room[:, n_open], names[n_open]
    return bins, offsets


def best_fit_packing(
    docs: DataFrame,
    path: str,
    max_tokens: int = 2048,
    max_docs: int = 2048,
    max_cost: int = 2048 * 2048,
    rule: str = "norm",
    group_pieces: int = 20_000,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece."""
    pieces = common.materialize(
        common.texts_of(docs).mapInArrow(
            _pieces(path, max_tokens), "doc_id long, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, kind="stable")
        bins, pdf["offset"] = vector_best_fit(pdf["length"], max_tokens, max_docs, max_cost, rule=rule)
        pdf["sequence_id"] = bins + pdf["pack_group"].astype(np.int64) * (1 << 32)
        return pdf.drop(columns="pack_group")

    dealt = pieces.withColumn(
        "pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    )
    return dealt.groupBy("pack_group").applyInPandas(
        pack,
        "doc_id long, piece int, start long, length long, ids_crc32 long, offset long, sequence_id long",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark, sf_dir):
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
