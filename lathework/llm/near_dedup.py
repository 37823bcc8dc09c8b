"""Near-dedup by Order MinHash with banded alignment (operator 9).

Equal texts are one node. A node's elements are its 5-word shingles, each numbered by
its occurrence in the text. Under ``MINIMA`` hash orders the least element is sampled,
with its place; each key takes a sample and the next order's one, in text order. Nodes that share a key are candidates; a candidate pair is a link if
a banded alignment of the two texts' words (unit costs, band = the most edits that the threshold
allows) leaves an edit similarity ``1 - edits / longer`` of at least ``SIMILARITY``. Classes are the
connected components of links. The number of keys follows the links' own similarity: with a tenth of
the words changed, evenly, two texts share about 0.41 of their shingles and practically all pairs
share a key; with 15 % all but a few in a thousand; with 20 % (edit similarity 0.8, the least)
97 to 98 of 100 at 100 words and more, 93 at 40 words, 82 at 20 words.

Scale: the texts are scanned once for keys; equal texts are folded by a pre-aggregated
group-by, so thousands of copies cost no pair. Keys travel with a 64-bit number of the node only
(two nodes of one number are both compared). Within a key, pairs are never listed. First each
node meets one text: the least by hash in any of its keys, so a large group becomes a star in one
step. Then, in rounds, each node outside the largest class of a key that is still of several classes
meets a text of each such class, in the ``HUBS`` smallest of its keys. What is left in keys still open after ``ROUNDS``
is compared exactly: two texts that may be linked share one of the rarest word pairs of each (prefix
filter), so no pair of a key is left out. There the texts outside a word pair's largest class meet
the others in an equi-join on it, whose condition drops texts that differ in too many words
by a parity of their words in 1,024 buckets, and those that share one of the word pairs just before this
one in both orders, where they have met; what passes is listed about once, so the number of rows
follows how many alike texts of different classes there are. Classes are contracted: each round joins
classes, not all links from the start.

Defined cases: null and empty texts are equal to each other; a text below five words
has one shingle of all of them; null ids are ordered last and take part; equal rows are
members of the same class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm import common
from lathework.llm.kernels import SpanHash, gram_hashes, mix, scan_words

SHINGLE, MINIMA, SIMILARITY, ROUNDS, HUBS = 5, 128, 0.8, 1, 4
_BLOCK = 1 << 12
#: Of a text's rare word pairs, how many that come before each travel with it.
_BEFORE = 8
#: What stands before a text's first and after its last word.
_EDGES = np.array([0x6A09E667F3BCC908, 0xBB67AE8584CAA73B], np.uint64)
#: Rows of links or labels up to which they are broadcast (5 MB); beyond, they are shuffled.
_SMALL = 50_000
#: Bytes of the texts of all candidate pairs up to which they are broadcast; beyond, they are shuffled.
_SMALL_TEXTS = 8 << 20
#: Pairs that a task aligns, and words of the texts that it remembers (both bound it; neither drops a pair).
_ALIGNED, _REMEMBERED = 1000, 300_000
#: Bits of a text's parity, in longs; in the exact rest texts of more than ``_WIDE // 16`` words have one of ``_WIDE`` bits behind it.
_BITS, _WIDE = 1024, 4096


def occurrence_numbered(grams: np.ndarray) -> np.ndarray:
    """Each hash mixed with how often it occurred before it."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return mix(grams)
    start = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    number = np.empty(len(grams), np.uint64)
    number[order] = (np.arange(len(grams)) - start).astype(np.uint64)
    return mix(grams + number * np.uint64(0xA0761D6478BD642F))


def band_keys(codes: np.ndarray, minima: int = MINIMA, shingle: int = SHINGLE) -> np.ndarray:
    """The keys of a text's word codes; none for a text without words."""
    if not len(codes):
        return np.empty(0, np.uint64)
    items = occurrence_numbered(gram_hashes(codes, min(shingle, len(codes))))
    seeds = (mix(np.arange(minima, dtype=np.uint64), 5) | np.uint64(1))[:, None]
    best = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    place = np.zeros(minima, np.int64)
    for s in range(0, len(items), _BLOCK):
        hashed = items[None, s : s + _BLOCK] * seeds  # the items are mixed already
        at = hashed.argmin(axis=1)
        value = hashed[np.arange(minima), at]
        better = value < best
        best[better], place[better] = value[better], at[better] + s
    after, after_place = np.roll(best, -1), np.roll(place, -1)
    swap = place > after_place
    left, right = np.where(swap, after, best), np.where(swap, best, after)
    return mix(mix(left) * np.uint64(3) + right + np.arange(minima, dtype=np.uint64))


def parity(codes: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Of each of ``bits`` buckets of words, numbered by occurrence, whether the text has an odd number; differs in no more bits than texts in words."""
    tokens = occurrence_numbered(codes) if len(codes) else codes
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(codes: np.ndarray) -> np.ndarray:
    """The parity, and for a text of many words, whose differences would fill it, a wider one."""
    return np.concatenate([parity(codes), parity(codes, _WIDE)]) if len(codes) > _WIDE // 16 else parity(codes)


def edits_within(a: list, b: list, band: int) -> int | None:
    """Unit-cost edits between two word lists, or None if more than ``band``.

    Common ends are cut; the rest is aligned column by column with bit vectors (Myers),
    where words may match only within ``band`` places of the diagonal.
    """
    if abs(len(a) - len(b)) > band:
        return None
    s, n = 0, min(len(a), len(b))
    while s < n and a[s] == b[s]:
        s += 1
    e = 0
    while e < n - s and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    if not a or not b:
        return max(len(a), len(b)) if max(len(a), len(b)) <= band else None
    m = len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    window = (1 << (2 * band + 1)) - 1
    pv, mv, score = full, 0, m
    for j, w in enumerate(b):
        near = window << (j - band) if j >= band else window >> (band - j)
        eq = at.get(w, 0) & near
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - (len(b) - j - 1) > band:
            return None
        ph = (ph << 1) | 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return score if score <= band else None


class Text:
    """A text's words and how often each occurs."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.counts = Counter(self.words)


def alike(x: Text, y: Text, threshold: float = SIMILARITY) -> bool:
    longer = max(len(x.words), len(y.words))
    edits = int((1 - threshold) * longer + 1e-9)
    few, many = (x.counts, y.counts) if len(x.counts) < len(y.counts) else (y.counts, x.counts)
    if sum(min(n, many.get(w, 0)) for w, n in few.items()) < longer - edits:
        return False  # every word that is kept is common to both
    return not longer or edits_within(x.words, y.words, edits) is not None


def similar(a: bytes, b: bytes, threshold: float = SIMILARITY) -> bool:
    return alike(Text(a), Text(b), threshold)


def _sketches(batches):
    hasher = SpanHash()
    for batch in batches:
        n_words, keys, bits = [], [], []
        for words in scan_words(batch.column(2), hasher):
            n_words.append(np.diff(words.bounds))
            keys += [band_keys(words.text(i)).view(np.int64) for i in range(words.n)]
            bits += [parity(words.text(i)) for i in range(words.n)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(bits, pa.list_(pa.int64())),
            ],
            ["doc_id", "node", "n_words", "keys", "bits"],
        )


def _widened(batches):
    """``node, text, lab, n_words, bits`` with wide parities."""
    hasher = SpanHash()
    for batch in batches:
        bits = [wide_parity(words.text(i)) for words in scan_words(batch.column(1), hasher) for i in range(words.n)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(bits, pa.list_(pa.int64()))], ["node", "text", "lab", "n_words", "bits"])


def _verified(threshold: float):
    def scan(batches):
        seen, held = {}, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some, good = batch.slice(lo, 500), []
                for pair in zip(*(some.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))):
                    if held > _REMEMBERED:
                        seen, held = {}, 0
                    for text in pair:
                        if text not in seen:
                            seen[text] = Text(text)
                            held += len(seen[text].words)
                    good.append(alike(seen[pair[0]], seen[pair[1]], threshold))
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column(0).filter(mask), some.column(1).filter(mask)], ["a", "b"])

    return scan


def _sent(table: DataFrame):
    """A hint for joins with parts of ``table``, which is written: to broadcast them if it has at most ``_SMALL`` rows."""
    return F.broadcast if table.limit(_SMALL + 1).count() <= _SMALL else lambda part: part


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component of ``a, b``.

    In each round a node takes the least label around it, then its label's label, so
    rounds are logarithmic in a component's length where it is long. Each round is one
    written table; minima are aggregated before the shuffle. Labels are broadcast if the links are few.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).filter("node <> other")
    edges = common.materialize(both.distinct(), "edges")
    sent = _sent(edges)  # a label a node: no more than edges
    labels = common.materialize(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    written = labels
    while True:
        told = labels.select(F.col("node").alias("other"), F.col("label").alias("heard"))
        heard = edges.join(sent(told), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        stepped = heard.join(sent(labels), "node").select("node", "label", F.least("label", "heard").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jumped"))
        after = stepped.join(sent(jump), "low", "left").select(
            "node", F.coalesce(F.least("jumped", "low"), "low").alias("label"), (F.coalesce(F.least("jumped", "low"), "low") < F.col("label")).alias("moved")
        )
        after = common.materialize(after, "labels")
        common.release(written)
        written, labels = after, after.select("node", "label")
        if not after.filter("moved").take(1):
            common.release(edges)
            return labels


def _edits(left: str, right: str, threshold: float) -> tuple[F.Column, F.Column]:
    """The most edits of a link, and the lengths' difference."""
    n, m = F.col(f"n_{left}"), F.col(f"n_{right}")
    return F.floor(F.greatest(n, m) * F.lit(1 - threshold) + F.lit(1e-6)), F.abs(n - m)


def _may_link(left: str, right: str, threshold: float) -> F.Column:
    """Whether lengths and parities of two texts allow a link: ``e`` edits change at most ``2 e`` less the lengths' difference words."""
    edits, between = _edits(left, right, threshold)
    one = lambda i: F.bit_count(F.col(f"bits_{left}")[i].bitwiseXOR(F.col(f"bits_{right}")[i]))
    apart = sum((one(i) for i in range(1, _BITS // 64)), one(0))
    return (between <= edits) & (apart <= 2 * edits - between)


def _may_link_wide(left: str, right: str, threshold: float) -> F.Column:
    """The same by wide parities; true where one of the texts has none."""
    (edits, between), first = _edits(left, right, threshold), _BITS // 64 + 1
    wide = lambda side: F.slice(f"bits_{side}", first, _WIDE // 64)
    apart = F.aggregate(F.zip_with(wide(left), wide(right), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    either = (F.size(f"bits_{left}") < first) | (F.size(f"bits_{right}") < first)
    return either | (apart <= 2 * edits - between)


class _Classes:
    """Links found so far, and the class of each node that has any; classes are joined, never found anew."""

    def __init__(self, texts: DataFrame, threshold: float):
        self.texts, self.threshold, self.links, self.labels, self.sent = texts, threshold, None, None, None

    def compare(self, met: DataFrame) -> None:
        """Links among the pairs ``turn, hub`` of nodes' numbers."""
        end = lambda turn, side: self.texts.select(F.col("turn").alias(turn), F.col("node").alias(side), F.col("n_words").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = met.join(end("turn", "a"), "turn").join(end("hub", "b"), "hub").filter("a <> b").filter(_may_link("a", "b", self.threshold))
        self.add(pairs)

    def add(self, pairs: DataFrame) -> None:
        """Aligns the pairs ``a, b`` of nodes, each once; those that are links join classes."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = common.materialize(pairs, "pairs")
        spent, used, sent = [pairs], self.texts, lambda side: side
        ends = common.materialize(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct(), "ends")
        spent.append(ends)
        if ends.limit(_SMALL + 1).count() <= _SMALL:
            # the texts of few nodes are looked up once, without a shuffle of all texts
            used = common.materialize(self.texts.join(F.broadcast(ends), "node").select("node", "text"), "used")
            spent.append(used)
            if (used.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= _SMALL_TEXTS:
                pairs = pairs.repartition(-(-pairs.count() // _ALIGNED) or 1, "a", "b")
                sent = F.broadcast
        x = sent(used.select(F.col("node").alias("a"), F.col("text").alias("x")))
        y = sent(used.select(F.col("node").alias("b"), F.col("text").alias("y")))
        found = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        found = common.materialize(found.mapInArrow(_verified(self.threshold), "a binary, b binary"), "found")
        common.release(*spent)
        if not found.take(1):
            return
        self.links = found if self.links is None else self.links.union(found)
        if self.labels is None:
            self.labels = components(found)
            self.sent = _sent(self.labels)
            return
        ends = found
        for side in "ab":
            own = self.labels.select(F.col("node").alias(side), F.col("label").alias("_l"))
            ends = ends.join(self.sent(own), side, "left").withColumn(side, F.coalesce("_l", side)).drop("_l")
        joined = components(ends.filter("a <> b").distinct())
        after = joined.select(F.col("node").alias("label"), F.col("label").alias("after"))
        old = self.labels.join(after, "label", "left").select("node", F.coalesce("after", "label").alias("label"))
        new = joined.join(self.labels.select("node"), "node", "left_anti")  # had no link before
        self.labels = common.materialize(old.unionByName(new), "labels")
        self.sent = _sent(self.labels)

    def of(self, members: DataFrame) -> DataFrame:
        """``members`` (with ``node``) and ``lab``, a 64-bit number of the class."""
        if self.labels is None:
            return members.withColumn("lab", F.xxhash64("node"))
        return members.join(self.sent(self.labels), "node", "left").withColumn("lab", F.xxhash64(F.coalesce("label", "node"))).drop("label")


def _of_several(rows: DataFrame, column: str) -> DataFrame:
    """The rows of keys that have several values of ``column``; rows are shuffled once, with nothing beside them."""
    by_key = Window.partitionBy("key")
    several = F.min(column).over(by_key) != F.max(column).over(by_key)
    return rows.withColumn("_several", several).filter("_several").drop("_several")


def _with_major(rows: DataFrame) -> DataFrame:
    """``rows`` with ``major``, the number of rows, least ``turn`` and number of their key's largest class, and ``size``, the key's rows."""
    by_class, by_key = Window.partitionBy("key", "lab"), Window.partitionBy("key")
    rows = rows.repartition("key").withColumn("_of", F.struct(F.count(F.lit(1)).over(by_class).alias("n"), F.min("turn").over(by_class).alias("turn"), "lab"))
    return rows.withColumns({"major": F.max("_of").over(by_key), "size": F.count(F.lit(1)).over(by_key)}).drop("_of")


def _rounds(members: DataFrame, classes: _Classes, rounds: int) -> DataFrame:
    """Compares each node with one other a round; returns ``key, turn, node, lab`` of those in keys still open."""
    least = members.select("turn", F.min("turn").over(Window.partitionBy("key")).alias("hub"))
    classes.compare(least.groupBy("turn").agg(F.min("hub").alias("hub")).filter("hub <> turn"))
    written = members
    members = members.join(classes.texts.select("turn", "node"), "turn")
    for last in [False] * rounds + [True]:
        rows = classes.of(members.select("key", "turn", "node"))
        rows = common.materialize(_of_several(rows, "lab"), "open")
        common.release(written)
        written = rows
        if last or not rows.take(1):
            return rows
        # of the texts that its keys (at most MINIMA) offer a node meets those of its smallest keys
        met = _with_major(rows).filter("lab <> major.lab").groupBy("turn").agg(F.collect_set(F.struct("size", F.col("major.turn").alias("hub"))).alias("met"))
        hubs = F.slice(F.array_distinct(F.transform(F.sort_array("met"), lambda m: m["hub"])), 1, HUBS)
        met = met.select("turn", F.explode(hubs).alias("hub"))
        classes.compare(met)
        members = rows


def _tokens(batch, hasher):
    """(row, its word pairs numbered by occurrence) of the texts in column 1; ``n`` words make ``n + 1`` pairs with the edges."""
    for words in scan_words(batch.column(1), hasher):
        for i in range(words.n):
            yield words.first + i, occurrence_numbered(gram_hashes(np.concatenate([_EDGES[:1], words.text(i), _EDGES[1:]]), 2))


def _word_pairs(batches):
    hasher = SpanHash()
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):  # some texts at a time, so that a worker's memory stays small
            some = batch.slice(lo, 200)
            owner, out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, tokens in _tokens(some, hasher):
                owner.append(np.full(len(tokens), i))
                out.append(tokens.view(np.int64))
            at = pa.array(np.concatenate(owner), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64()), some.column(0).take(at), some.column(2).take(at)], ["key", "node", "lab"])


def rarest(own: DataFrame, threshold: float) -> DataFrame:
    """``key, node, lab, n_words, bits, before``: the word pairs at which a text meets those of other classes.

    Of ``n + 1`` word pairs a text linked to this one lacks at most ``k = 2 (1 - threshold) n``. Those of one class
    only come first in the order, then the others by how many rows hold them: of a text with ``s`` others the first
    ``s + k - n`` stay, none where it shares too few with other classes for any link. ``before`` are the
    ``_BEFORE`` that come before a pair in that order.
    """
    pairs = own.select("node", "text", "lab").mapInArrow(_word_pairs, "key long, node binary, lab long")  # shuffled at once, read once
    shared = _of_several(pairs, "lab").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    ordered = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("ordered"))
    texts = ordered.join(own.select("node", "lab", "n_words", "bits"), "node")
    many = F.size("ordered") + F.floor(F.col("n_words") * F.lit(2 * (1 - threshold)) + F.lit(1e-9)) - F.col("n_words")
    texts = texts.withColumn("many", many.cast("int")).filter("many > 0").withColumn("ordered", F.expr("slice(transform(ordered, x -> x.key), 1, many)"))
    each = F.expr(f"explode(transform(ordered, (x, i) -> struct(x AS key, slice(ordered, greatest(i - {_BEFORE}, 0) + 1, least(i, {_BEFORE})) AS before)))")
    rows = texts.select("node", "lab", "n_words", "bits", each.alias("_")).select("_.key", "node", "lab", "n_words", "bits", "_.before")
    return common.materialize(rows, "rare")


def _rest(left: DataFrame, classes: _Classes) -> None:
    """Finds all links between texts of different classes among those that a key of ``left`` holds.

    An edit takes two of a text's word pairs at most, so of two linked texts one of ``n`` words shares all but
    ``k = 2 (1 - threshold) n`` of its ``n + 1``; by any one order of the word pairs a shared one is among the first
    ``k + 1`` of each. The order is by how rare they are here. Texts meet at the first that they share; at a later one
    they are left out where one of those just before it is shared too.
    """
    threshold, nodes = classes.threshold, left.select("node", "lab").distinct()
    own = classes.texts.join(nodes, "node").select("node", "text", "lab", "n_words", "bits")
    own = common.materialize(own.mapInArrow(_widened, own.schema), "left_texts")
    common.release(classes.texts, left)
    classes.texts = own
    rows = rarest(own, threshold)
    # word pairs of several classes, and the largest of these, which is not compared with itself
    rows = _with_major(_of_several(rows.withColumn("turn", F.xxhash64("node")), "lab")).withColumn("minor", F.col("lab") != F.col("major.lab")).drop("turn", "major", "size")
    rows = common.materialize(rows, "rare_open")
    a, b = (rows.select("key", F.col("node").alias(x), F.col("lab").alias(f"lab_{x}"), F.col("minor").alias(f"minor_{x}"), F.col("n_words").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"), F.col("before").alias(f"before_{x}")) for x in "ab")
    other = (F.col("lab_a") != F.col("lab_b")) & (~F.col("minor_b") | (F.col("a") < F.col("b")))
    a = a.filter("minor_a").withColumnRenamed("key", "key_a").hint("merge")
    met = F.arrays_overlap("before_a", "before_b")
    pairs = a.join(b, (F.col("key_a") == F.col("key")) & other & _may_link("a", "b", threshold) & ~met & _may_link_wide("a", "b", threshold))
    classes.add(pairs)


def text_node(text: str) -> F.Column:
    """The node of a text: its MD5, 16 bytes; equal for equal texts."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def row_key(doc_id: str, node: str) -> F.Column:
    """One string for an id, null or not, and a node."""
    return F.concat(F.hex(node), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, class_id, links_used, kept, node`` for each document.

    ``class_id`` is the least id of its class, ``links_used`` counts the links of its text that were
    found on the way to its class (members of one class are not compared, so not all links),
    ``kept`` marks the rows of the class's first (id, text).
    """
    if threshold < 0.5:
        raise ValueError("the exact rest holds from a similarity of 0.5 on")
    spark = docs.sparkSession
    texts = common.texts_of(docs).withColumn("node", text_node("text"))
    scanned = texts.select("doc_id", "node", "text").mapInArrow(
        _sketches, "doc_id long, node binary, n_words long, keys array<long>, bits array<long>"
    )
    # equal texts are folded before anything is written, so keys lie on disk once beside their shuffle
    who = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("who")
    folded = scanned.groupBy("node").agg(who, *(F.first(c).alias(c) for c in ("n_words", "keys", "bits")))
    folded = common.materialize(folded.withColumn("turn", F.xxhash64("node")), "sketches")
    every = folded.select("turn", F.explode("keys").alias("key"))
    members = common.materialize(_of_several(every, "turn"), "members")
    held = members.select("turn").distinct()
    by_node = held.join(folded.select("turn", "node", "who", "n_words", "bits"), "turn")
    by_node = common.materialize(by_node.select(row_key("who.doc_id", "node").alias("row_key"), "turn", "n_words", "bits"), "by_node")
    common.release(folded)
    own = texts.select("node", "text", row_key("doc_id", "node").alias("row_key")).join(by_node, "row_key")
    classes = _Classes(common.materialize(own.dropDuplicates(["row_key"]).drop("row_key"), "node_texts"), threshold)  # a node has one row_key: texts are shuffled once
    common.release(by_node)
    left = _rounds(members, classes, rounds)
    if left.take(1):
        # keys that many unlike texts share
        _rest(left, classes)
    links, labels = classes.links, classes.labels
    if links is None:
        links = spark.createDataFrame([], "a binary, b binary")
        labels = spark.createDataFrame([], "node binary, label binary")
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links_used"))
    rows = texts.select("doc_id", "node").join(labels, "node", "left").join(degree, "node", "left")
    rows = rows.select("doc_id", "node", F.coalesce("label", "node").alias("label"), F.coalesce("links_used", F.lit(0)).alias("links_used"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    return rows.join(first, "label").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "links_used",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))).alias("kept"),
        "node",
    )


def op9_near_dedup(spark, sf_dir):
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "links_used")
