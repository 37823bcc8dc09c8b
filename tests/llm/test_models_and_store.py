"""Secret scan, classifiers, the shard store and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lathework.llm import compaction, decontamination, near_dedup, packing, quality, secret_scan, toxicity
from tests.llm.helpers import SCHEMA, docs_of, odd_pairs
from tests.llm.test_words_and_tokens import check_packing


def brute_spans(text):
    """The base patterns just as they are stated."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def secret_pairs():
    rng = random.Random(4)
    marks = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", " = ", '"', "'", "AKIA", "A" * 16, "ABCDEF0123456789", "deadbeef" * 3, "0123456789abcdef" * 2, " ", "é", "日本", "x", "abc", "word", "\n", "ſecret=abcdefgh"]
    return odd_pairs() + [(100 + i, "".join(rng.choices(marks, k=rng.randint(1, 25)))) for i in range(400)]


def test_base_spans_equal_brute_force(spark):
    pairs = secret_pairs()
    rows = secret_scan.secret_scan(docs_of(spark, pairs)).collect()
    found = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows), key=str)
    expected = []
    for i, t in pairs:
        spans = brute_spans(t or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        expected.append((i, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert all(set(r.base_sha256) <= set("0123456789abcdef") for r in rows)


def test_unseen_credentials_are_found_and_words_are_not(spark):
    fresh = secret_scan.labelled_credentials(20, seed=99)
    pairs = [(i, f"see {value} here") for i, (_, value) in enumerate(fresh)]
    words = ["internationalisation_of_words", "/usr/local/share/applications/readme.txt", "antidisestablishmentarianism", "THEHEADINGOFTHECHAPTERHERE", "-" * 40, "z" * 60, "2024-01-01T00:00:00", "www.example.org/some/long/path/to/page.html"]
    pairs += [(1000 + i, f"see {w} here") for i, w in enumerate(words)]
    rows = {r.doc_id: r for r in secret_scan.secret_scan(docs_of(spark, pairs)).collect()}
    assert sum(bool(rows[i].spans) for i in range(len(fresh))) >= 0.97 * len(fresh)
    assert [rows[1000 + i].spans for i in range(len(words))] == [""] * len(words)
    assert rows[0].clean_text == "see [SECRET] here"


def test_automaton_merges_and_ends():
    automaton = secret_scan.Automaton(["ab" * n for n in range(1, 30)])
    assert len(automaton.kept) < 10
    table = automaton.table()
    assert secret_scan.likelihood(table, "abab") > secret_scan.likelihood(table, "GGGG")


def test_redaction_keeps_other_columns(spark):
    docs = docs_of(spark, [(1, "token = abcdefgh and"), (2, None), (3, "plain")]).withColumn("clean", F.lit("mine")).withColumn("kept", F.lit(7))
    rows = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[1].clean, rows[1].kept) == ("[SECRET] and", 12, "mine", 7)
    assert rows[2].text is None and rows[3].text == "plain" and rows[3].n_chars == 5


INSULTS = ["blorgish", "snarfwit", "grumplet"]


def labelled_docs(n=400, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if not good:
            w = [x + "$$$" if rng.random() < 0.8 else x for x in w]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        docs.append((i, " ".join(w)))
        if i % 2 == 0 or i < 200:
            labels.append((i, good, toxic))
    return docs, labels


def auc(rows, truth):
    good = [r.score for r in rows if truth[r.doc_id]]
    bad = [r.score for r in rows if not truth[r.doc_id]]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled_docs(900)
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs_of(spark, docs + [(9000, "a snarfwitt and a blorgissh walk in"), (9001, None), (None, "no id")]), table).collect()
    by_id = {r.doc_id: r for r in rows}
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and auc(held, truth) > 0.85
    assert by_id[9000].predicted == 1 and 0 <= by_id[9001].score <= 1 and by_id[9001].predicted == 0
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_learning_uses_no_held_out_label(spark):
    docs, labels = labelled_docs(120)
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    for score in (toxicity.toxicity, quality.positive_unlabelled):
        a, b = (sorted(map(tuple, score(docs_of(spark, docs), spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
        assert a == b


def test_positive_unlabelled(spark):
    docs, labels = labelled_docs()
    truth = {i: q for i, q, _ in labels}
    rows = quality.positive_unlabelled(docs_of(spark, docs + [(9001, None), (None, "no id")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert auc(held, truth) > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, mixed = [t for i, t in docs if truth.get(i) == 1], [t for i, t in docs if i not in truth]
    _, _, prior = quality.train(good, mixed, 60)
    assert 0.4 < prior < 0.95
    assert quality.train([], mixed)[2] == 0.5


def test_long_words_count_as_a_whole():
    start = "ab1" * 67  # over 200 characters alike
    features = quality.Features()
    good, junk = features.of(start + "cde,Fgh." * 40), features.of(start + "%$#1" * 100)
    assert len(set(good) - set(junk)) > 5 and len(set(junk) - set(good)) > 5
    assert list(features.of("plain")) == list(np.append(features.of_shape("aaa"), zlib.crc32(b"plain") % quality.BUCKETS))


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, odd_pairs())
    assert {r.predicted for r in toxicity.toxicity(docs, empty).collect()} == {0}
    assert {r.score for r in quality.positive_unlabelled(docs, empty).collect()} == {0.5}
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.toxicity(none, empty).count() == quality.positive_unlabelled(none, empty).count() == 0
    assert secret_scan.secret_scan(none).count() == 0


def test_glued_and_partly_covered_credentials():
    tables, words = secret_scan.learn(secret_scan.labelled_credentials()), secret_scan.word_model()

    def spans(text):
        base = secret_scan.base_spans(text)
        return secret_scan.format_spans(text, base, tables, words, secret_scan.THRESHOLD, {})

    fresh = [c for name, c in secret_scan.labelled_credentials(20, seed=5) if name == "map_api"]
    for lead in ("maps.browser.production.key=", "/v1/projects/main/settings/browser/"):
        held = [any(s <= len(lead) and e >= len(lead + c) for s, _, e in spans(f"see {lead}{c} there"[4:])) for c in fresh]
        assert sum(held) >= 19
    # a hex run inside is a base span; the whole credential is a span all the same
    payment = "sk_live_" + "0a1b2c3d4e5f6a7b8c9d0e1f"
    assert secret_scan.base_spans(payment) and (0, 3, len(payment)) in spans(payment)
    assert spans("0a1b2c3d4e5f6a7b8c9d0e1f0a1b2c3d") == []  # inside a base span
    assert spans("/usr/share/documents/settings/browser/index.html and some-long-slug-of-plain-words-2024") == []


def contents(store, version=None):
    return sorted((tuple(r.row) for r in store.read(version).collect()), key=str)


def test_shard_store(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "store"), target_bytes=20_000, keep_versions=3)
    rows = sorted(((i, t, "en", "s", None if t is None else len(t)) for i, t in odd_pairs()), key=str)
    arrival = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("level", F.lit(1)).coalesce(1)
    expected = [r + ("mine", 1) for r in rows]
    assert store.read().count() == 0 and store.versions() == []
    for n in range(1, 6):
        store.append(arrival, 1)
        assert store.manifest()["version"] == n and contents(store) == sorted(expected * n, key=str)
    before = store.manifest()
    while store.compact():
        pass
    after = store.manifest()
    assert after["version"] > before["version"] and len(after["shards"]) < len(before["shards"]) / 3
    assert contents(store) == sorted(expected * 5, key=str)
    assert sum(s["rows"] for s in after["shards"]) == len(expected) * 5
    assert contents(store, before["version"]) == contents(store)  # still named by a kept version
    assert max(r.level for r in store.read().collect()) >= 1
    with pytest.raises(compaction.Conflict):
        store.commit(before, [], before["schema"])  # another version stands there
    assert store.manifest() == after
    store.append(arrival.limit(0), 1)
    assert contents(store) == sorted(expected * 5, key=str)


def test_tiers_merge_alike_sizes():
    store = compaction.ShardStore.__new__(compaction.ShardStore)
    store.target_bytes, store.fanout = 1000, 4
    shard = lambda n, i: {"file": f"f{i}", "bytes": n, "level": 0, "rows": 1}
    shards = [shard(20, i) for i in range(5)] + [shard(300, i) for i in range(10, 13)] + [shard(900, 20)]
    runs = [[s["bytes"] for s in run] for run in store.plan(shards)]
    assert runs == [[20] * 5, [300] * 3]
    assert store.plan([shard(20, 1), shard(20, 2)]) == []


def test_compacted_documents(spark):
    found = compaction.compacted(docs_of(spark, odd_pairs() * 3), rows_per_shard=2, target_bytes=1 << 20).read()
    assert sorted((tuple(r.row) for r in found.collect()), key=str) == sorted((tuple(r) for r in docs_of(spark, odd_pairs() * 3).collect()), key=str)


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = labelled_docs(160, 5)
    item = " ".join(rng.choices([t for _, d in docs for t in d.split() if t.isalpha()][:400], k=25))
    base = docs[0][1].split()
    docs += [(500, docs[10][1]), (501, " ".join([*docs[12][1].split(), "tail"])), (502, f"Before. {item} after it."), (503, f"new text with token = abcdefgh12 in {rng.random()}"), (504, None), (505, "")]
    folder = str(tmp_path / "sf")
    docs_of(spark, docs).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"] and base
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [now]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(str(tmp_path / f"stage{i}"))
        kept.append(spark.read.parquet(str(tmp_path / f"stage{i}")))
        if name != "packing":
            assert kept[-1].columns == now.columns
    rows = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(now, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(rows[1]) == {i for i, p in scores.items() if not p}
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(kept[1]).collect()}
    assert set(rows[2]) == set(classes.values()) and len(kept[2].collect()) == len(rows[2])
    assert classes.get(505) == 504 if 504 in classes else True
    bad = {r.doc_id for r in decontamination.contaminated(kept[2], spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert set(rows[3]) == set(rows[2]) - bad
    assert 502 not in rows[3] and set(rows[4]) == set(rows[3])
    if 503 in rows[4]:
        assert rows[4][503].text.startswith("new text with [SECRET] in")
    check_packing([(i, r.text) for i, r in rows[4].items()], kept[5].collect())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[5].collect())
    assert packing.tokenizer_path().endswith(".json")


def test_two_writers_and_a_reader(spark, tmp_path):
    one, two = (compaction.ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20, fanout=2) for _ in range(2))
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(8)]
    arrival = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    one.append(arrival, 2)
    reader, held = one.read(), contents(one)
    # while a merge is under way another writer has written an arrival, and commits it before the merge
    merged, state = one._merged, {}

    def interrupted(folder, merges):
        foreign = f"{one.path}/data/awriting"
        arrival.select(F.struct("*").alias("row")).write.parquet(foreign)
        two.append(arrival, 2)
        state["foreign"] = foreign
        return merged(folder, merges)

    one._merged = interrupted
    assert one.compact()
    assert contents(one) == sorted(held * 2, key=str)  # neither writer's rows are lost
    assert sorted((tuple(r.row) for r in reader.collect()), key=str) == held  # the version before is still whole
    assert spark.read.parquet(state["foreign"]).count() == len(rows)  # no file of a writer under way is removed
    one._merged = merged
    # two merges of the same shards: the second is refused and leaves nothing behind
    plan, folders = two.plan, lambda: sorted(p for p, _, _ in one._list(f"{one.path}/data"))
    two.plan = lambda shards: (runs := plan(shards), one.compact())[0]
    with pytest.raises(compaction.Conflict):
        two.compact()
    assert contents(two) == sorted(held * 2, key=str)
    assert {s["file"].rsplit("/", 2)[0] for s in two.manifest()["shards"]} and len(folders()) >= 2


def test_vacuum_keeps_versions_and_waits(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20, fanout=2, keep_versions=1, grace_ms=10**9)
    arrival = docs_of(spark, [(i, "t") for i in range(4)]).coalesce(1)
    store.append(arrival, 1)
    store.compact()
    assert store.versions() == [1, 2] and contents(store, 1) == contents(store)
    store.grace_ms = -(10**6)
    store.vacuum()
    assert store.versions() == [2] and len(contents(store)) == 4
