"""Benchmark decontamination by template canonicalisation (operator 1).

Each word becomes a template token: numbers ``<NUM>``, units after numbers ``<UNIT>``,
names (capitalised inside a sentence) ``<NAME>``, else the lower-cased word without
outer marks. Windows of ``WINDOW`` tokens (the whole item, if it is shorter) are hash-joined between benchmark and documents. A joined window counts
where its slots are consistent: equal values in the item's placeholders correspond to
equal values in the document's (unlike ones may become equal by chance), so a question with
other numbers or names matches while prose that merely has numbers there does not. Templates
with fewer than ``LITERALS`` literal tokens prove nothing: such windows, and items shorter than
``LEAST``, are joined by their very words, numbers and names (lower-cased, without outer marks). Since a
passage's first word may be a name in one place and a sentence start in the other,
windows are keyed both with and without name placeholders, and once more with the capitalised
words that begin sentences as names too.

Scale: benchmark windows are few; while there are at most ``FILTER_ROWS`` (checked) their
hashes are broadcast and document windows are filtered in the scan. Beyond, documents'
windows go to the same hash join unfiltered. Documents' texts are never shuffled.

Defined cases: null or empty texts and items, and those of marks alone, have no windows; an item or a document
with a null id still matches under that null id; repeated rows are counted once for
each (doc_id, item_id); an empty benchmark gives no row.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import common
from lathework.llm.kernels import gram_hashes

WINDOW, LEAST, LITERALS, FILTER_ROWS = 13, 6, 5, 4_000_000
#: Unit words that become <UNIT> after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec seconds min minutes h hours days weeks months years hz khz mhz"
    " ghz kb mb gb tb w kw v a n j pa c f k % percent dollars euros cents usd eur meters metres miles inches feet"
    " grams liters litres degrees".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?(%|[a-z]{1,3})?", re.I)
_OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_NUM, _UNIT, _NAME = 1, 2, 3  # codes below 4 are placeholders


_BARE = np.uint64(int.from_bytes(hashlib.blake2b(b"", digest_size=7).digest(), "little") + 8)  # the value of a word of marks alone


class Tokens(dict):
    """For each word: (lower-cased code, is a number, may be a unit, is capitalised, ends a sentence) in one integer."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        core = _OUTER.sub("", word)
        code = int.from_bytes(hashlib.blake2b(core.lower().encode(), digest_size=7).digest(), "little") << 4
        if _NUMBER.fullmatch(core):
            code |= 1
        if core.lower() in UNITS:
            code |= 2
        if core[:1].isupper():
            code |= 4
        if not core or word[-1] in ".!?:" or (len(word) > 1 and word[-1] in "\"')" and word[-2] in ".!?"):
            code |= 8
        self[word] = code
        return code


class Templates:
    """Template codes of the words of some texts, end to end.

    ``full`` has all placeholders, ``plain`` all but names, ``wide`` those of ``full`` and names that begin sentences; ``of`` is each word's text, ``bounds`` where texts begin.
    """

    def __init__(self, texts: list[list[str]], tokens: Tokens):
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        raw = np.fromiter(map(tokens.__getitem__, chain.from_iterable(texts)), np.uint64, int(self.bounds[-1]))
        flags, self.values = (raw & np.uint64(15)).astype(np.uint8), (raw >> np.uint64(4)) + np.uint64(8)
        before = np.concatenate([np.full(1, 8, np.uint8), flags[:-1]]) if len(flags) else flags
        before[self.bounds[:-1][self.bounds[:-1] < len(before)]] = 8
        number = (flags & 1) > 0
        #: Words that are literals in every template whatever stands before them.
        self.literal = (flags & 3) == 0
        unit = ((flags & 2) > 0) & ((before & 1) > 0)
        capital = ((flags & 4) > 0) & ~number & ~unit
        name = capital & ((before & 8) == 0)
        self.plain = self.values.copy()
        self.plain[number], self.plain[unit] = _NUM, _UNIT
        self.full = self.plain.copy()
        self.full[name] = _NAME
        self.wide = self.plain.copy()
        self.wide[capital] = _NAME

    def windows(self, length: int, keep: np.ndarray | None = None):
        """(text, hash, start in it, slot pattern) of each usable window; ``keep`` filters hashes."""
        out = []
        if len(self.of) < length:
            return out
        inside = self.of[: len(self.of) - length + 1] == self.of[length - 1 :]
        for codes in (self.full, self.plain, self.wide) if length >= LEAST else ():
            hashes = gram_hashes(codes, length, length).view(np.int64)
            good = inside.copy()
            if codes is not self.full:  # a window without such names is there already
                names = np.concatenate([[0], np.cumsum(self.full != codes)])
                good &= names[length:] - names[:-length] > 0
            if keep is not None:
                good &= keep[np.minimum(np.searchsorted(keep, hashes), len(keep) - 1)] == hashes if len(keep) else False
            for i in np.flatnonzero(good):
                own = codes[i : i + length]
                if (own >= 4).sum() >= min(LITERALS, length):
                    text = int(self.of[i])
                    out.append((text, int(hashes[i]), int(i - self.bounds[text]), slot_pattern(own, self.values[i : i + length])))
        return out + self._exact(length, inside, keep)

    def _exact(self, length: int, inside: np.ndarray, keep: np.ndarray | None):
        """Like ``windows``, by the words themselves, where templates may have too few literals."""
        some = np.concatenate([[0], np.cumsum(self.values != _BARE)])
        good = inside & (some[length:] - some[:-length] > 0)
        if length >= LEAST:
            literals = np.concatenate([[0], np.cumsum(self.literal)])
            good &= literals[length:] - literals[:-length] < LITERALS
        at = np.flatnonzero(good)
        runs = np.lib.stride_tricks.sliding_window_view(self.values, length)
        hashes = np.concatenate([np.empty(0, np.uint64), *(gram_hashes(runs[at[s : s + 8192]].T, length, length + 1000)[0] for s in range(0, len(at), 8192))])
        hashes = hashes.view(np.int64)
        if keep is not None:
            held = keep[np.minimum(np.searchsorted(keep, hashes), len(keep) - 1)] == hashes if len(keep) else np.zeros(len(at), bool)
            at, hashes = at[held], hashes[held]
        return [(int(self.of[i]), int(h), int(i - self.bounds[self.of[i]]), "") for i, h in zip(at, hashes)]


def slot_pattern(codes: np.ndarray, values: np.ndarray) -> str:
    """Which placeholders of a window hold the same value, as first-seen numbers."""
    seen: dict[int, int] = {}
    return ",".join(str(seen.setdefault(int(v), len(seen))) for c, v in zip(codes, values) if c < 4)


def windows(words: list[str], tokens: Tokens, length: int):
    """(hash, start, slot pattern) of one text's usable windows."""
    return [w[1:] for w in Templates([words], tokens).windows(length)] if length else []


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, length, hash, slots`` of the benchmark's windows."""

    def scan(batches):
        tokens = Tokens()
        for batch in batches:
            owner, length, hashes, slots = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.split()
                n = min(window, len(words))
                for h, _, pattern in windows(words, tokens, n):
                    owner.append(i)
                    length.append(n)
                    hashes.append(h)
                    slots.append(pattern)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(length, pa.int32()), pa.array(hashes, pa.int64()), pa.array(slots, pa.string())],
                ["item_id", "length", "hash", "slots"],
            )

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(scan, "item_id long, length int, hash long, slots string").distinct()


def _some(column: pa.Array, words: int = 200_000):
    """(number of the first, words of each) of consecutive texts with about ``words`` words together."""
    first, texts, n = 0, [], 0
    for i, text in enumerate(column):
        own = text.as_py().split()
        texts.append(own)
        n += len(own)
        if n >= words:
            yield first, texts
            first, texts, n = i + 1, [], 0
    if texts:
        yield first, texts


def _document_windows(lengths, keep):
    def scan(batches):
        tokens = Tokens()
        kept = keep.value if keep is not None else None
        for batch in batches:
            owner, length, hashes, starts, slots = [], [], [], [], []
            for lo, texts in _some(batch.column(1)):
                found = Templates(texts, tokens)
                for n in lengths:
                    for i, h, s, pattern in found.windows(n, None if kept is None else kept[n]):
                        owner.append(lo + i)
                        length.append(n)
                        hashes.append(h)
                        starts.append(s)
                        slots.append(pattern)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(length, pa.int32()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(slots, pa.string())],
                ["doc_id", "length", "hash", "start", "slots"],
            )

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """``doc_id, item_id, n_windows, first_word, exact_slots`` for each document that holds part of an item."""
    spark = docs.sparkSession
    items = common.materialize(item_windows(benchmark, window), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most ``window`` values
    keep = None
    if items.count() <= filter_rows:
        by_length = {n: [] for n in lengths}
        for r in items.select("length", "hash").distinct().collect():  # at most filter_rows pairs of numbers
            by_length[r.length].append(r.hash)
        keep = spark.sparkContext.broadcast({n: np.sort(np.array(v, np.int64)) for n, v in by_length.items()})
    found = common.texts_of(docs).mapInArrow(
        _document_windows(lengths, keep), "doc_id long, length int, hash long, start int, slots string"
    )
    own, other = F.split("item_slots", ","), F.split("slots", ",")
    # an item's value has one value in the document: that of its first place
    mapped = F.zip_with(own, other, lambda i, d: F.element_at(other, F.array_position(own, i).cast("int")) == d)
    return (
        found.join(items.withColumnRenamed("slots", "item_slots"), ["length", "hash"])
        .filter(F.forall(mapped, lambda x: x))
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("start").alias("n_windows"), F.min("start").alias("first_word"))
    )


def op1_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
