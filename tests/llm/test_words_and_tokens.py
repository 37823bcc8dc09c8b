"""Substring dedup, token counts and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lathework.llm import packing, substring_dedup, token_counts
from lathework.llm.bpe import VectorBPE
from tests.llm.helpers import SCHEMA, docs_of, odd_pairs

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_substrings(pairs, length=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first.get(tuple(w[k : k + length]), i) < i:
                gone.update(range(k, k + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(40)]
    pairs = odd_pairs()
    for i in range(20, 60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            a = rng.randint(0, 20)
            w[10:10] = passage[a : a + rng.randint(10, 20)]
        pairs.append((i, " ".join(w)))
    found = substring_dedup.substring_dedup(docs_of(spark, pairs)).drop("kept_text").collect()
    assert sorted(map(tuple, found), key=str) == brute_substrings(pairs)


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    pairs = odd_pairs() + [(9, "don't we'll THE's 'tis 12345 a_b--c ΑΣ ẞ ǅ"), (10, "x" * 5000), (11, "é" * 300 + "   ok")]
    found = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs_of(spark, pairs), PATH).collect()}
    for i, t in pairs:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert found[(i, len((t or "").encode()))] == (n, n > 2048), (i, t)


def test_shortcuts_are_single_tokens():
    library = Tokenizer.from_file(PATH)
    shortcuts = sorted(token_counts.proven_shortcuts(PATH))
    assert len(shortcuts) > 30_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(shortcuts[::37], add_special_tokens=False))


def test_vector_bpe_equals_the_library():
    library, engine = Tokenizer.from_file(PATH), VectorBPE(PATH)
    rng = random.Random(1)
    marks = "ab'sdtmrevl \n\t0129.,!?-\u00e9\u00c9\u00df\u00f1\u00d7\u00b2\u00bd\u00b5\xa0\x85\x1c\x00\u2019\u20ac\u0130\u03a3e\u0301"
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["aaaa" * 50, "'s", "''s", "x's're'llo", ""]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for _, ids in sorted(engine.ids(texts), key=lambda x: x[0])] == expected
    small = VectorBPE(PATH, token_counts.proven_shortcuts(PATH), cache=40)
    assert small.counts(texts).tolist() == [len(e) for e in expected]


def check_packing(pairs, rows, cap=2048):
    library = Tokenizer.from_file(PATH)
    expected = {}
    for i, t in pairs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, k in enumerate(range(0, len(ids), cap)):
            key = (i, p, k, len(ids[k : k + cap]), zlib.crc32(ids[k : k + cap].tobytes()))
            expected[key] = expected.get(key, 0) + 1
    seen = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        seen[key] = seen.get(key, 0) + 1
    assert seen == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    return len(by_sequence)


def test_packing_round_trip(spark):
    pairs = odd_pairs() + [(100 + i, "word " * (i % 700)) for i in range(200)]
    rows = packing.best_fit_packing(docs_of(spark, pairs), PATH).collect()
    n = check_packing(pairs, rows)
    assert n <= 1 + 1.02 * sum(r.length for r in rows) / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 50, 500)
    bins, offsets = packing.vector_best_fit(lengths, 60, 4, 1500, rule=rule) if lengths.max() ** 2 <= 1500 else packing.vector_best_fit(np.minimum(lengths, 38), 60, 4, 1500, rule=rule)
    lengths = np.minimum(lengths, 38) if lengths.max() ** 2 > 1500 else lengths
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 60 and len(own) <= 4 and (own**2).sum() <= 1500
        assert sorted(offsets[bins == b]) == sorted(np.concatenate([[0], np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.best_fit_packing(empty, PATH).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert token_counts.token_counts(empty, PATH).count() == 0


def thue_morse(letters, n):
    """A word of ``n`` letters and its complement, which polynomials modulo 2^64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048, 8192])
def test_long_regular_words_stay_apart(spark, n):
    a, b = thue_morse("ab", n)
    library, engine = Tokenizer.from_file(PATH), VectorBPE(PATH)
    texts = [a, b, f"x {b} {a}"]
    for i, ids in engine.ids(texts):
        assert ids.tolist() == library.encode(texts[i], add_special_tokens=False).ids
    assert engine.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    head = " ".join(f"h{i}" for i in range(6))
    tail = " ".join(f"t{i}" for i in range(6))
    pairs = [(1, f"{head} {a} {tail}"), (2, f"{head} {b} {tail}"), (3, f"{head} {a} {tail} z")]
    found = substring_dedup.substring_dedup(docs_of(spark, pairs)).drop("kept_text").collect()
    assert sorted(map(tuple, found), key=str) == brute_substrings(pairs)


def test_a_shared_hash_sends_the_chunk_to_the_library():
    library, engine = Tokenizer.from_file(PATH), VectorBPE(PATH)
    engine.hasher.of_points = lambda points, starts, ends: (ends - starts).astype(np.uint64)
    texts = ["one two three", "six ten", ""]
    assert engine.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {i: ids.tolist() for i, ids in engine.ids(texts)} == {
        i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)
    }
