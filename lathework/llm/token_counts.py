"""Token counts by a whole-token shortcut (operator 8).

Offline, on the driver, every vocabulary string that ends a word is put through the
library; those that come back as one token are the proven shortcuts. In the scan a
pre-token among them counts one without any merge; only the rest are merged, each
distinct pre-token of a batch once (see ``bpe``). Special strings inside texts, and
scripts whose character tables the fast splitter does not know, go to the library whole.

Nothing is shuffled; the shortcuts, at most the vocabulary, are broadcast.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); lone white space
has no tokens; whole texts are counted, however long; rows repeat as they stand.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import common
from lathework.llm.bpe import VectorBPE

#: Byte-level vocabulary strings: printable bytes stand for themselves, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


def _unmapped(name: str) -> str | None:
    try:
        return bytes(_BYTE_OF[c] for c in name).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def proven_shortcuts(path: str) -> dict[str, int]:
    """Texts that the library encodes as one token, with its id."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    model = json.load(open(path, encoding="utf-8"))["model"]
    end = model["end_of_word_suffix"]
    names = (s[: -len(end)] for s in model["vocab"] if s.endswith(end))
    candidates = sorted({t for t in map(_unmapped, names) if t and not any(c.isspace() for c in t)})
    encoded = library.encode_batch(candidates, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(candidates, encoded) if len(e.ids) == 1}


def _counter(path: str, shortcuts, limit: int):
    def scan(batches):
        engine = VectorBPE(path, shortcuts.value)
        for batch in batches:
            total = pa.array(engine.counts(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), total, pc.greater(total, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return scan


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each document."""
    spark = docs.sparkSession
    shortcuts = spark.sparkContext.broadcast(proven_shortcuts(path))  # at most the vocabulary, 49,406 strings
    rows = common.texts_of(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.mapInArrow(_counter(path, shortcuts, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
