"""Near-dedup, fingerprints and decontamination against brute force and planted cases."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lathework.llm import decontamination, near_dedup, order_minhash
from tests.llm.helpers import SCHEMA, docs_of, odd_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 12))
def test_banded_alignment_equals_the_full_table(a, b, band):
    d = distance(a, b)
    assert near_dedup.edits_within(a, b, band) == (d if d <= band else None)


def shingles(text):
    w = text.split()
    seen, out = {}, set()
    for i in range(max(1, len(w) - 4) if w else 0):
        g = tuple(w[i : i + 5])
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(500)]
    common_line = " ".join(rng.choice(vocab) for _ in range(12))
    pairs = odd_pairs()
    number = 100
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 120))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            pairs.append((number, " ".join(w)))
            number += 1
    for _ in range(30):  # unlike texts that share a line
        pairs.append((number, common_line + " " + " ".join(rng.choice(vocab) for _ in range(40))))
        number += 1
    found = near_dedup.near_classes(docs_of(spark, pairs)).collect()
    # brute force: pairs with shingle similarity 0.8 share a class; classes hang together by edit similarity 0.8
    texts = sorted({t or "" for _, t in pairs})
    sets = {t: shingles(t) for t in texts}

    def partition(alike):
        parent = {t: t for t in texts}

        def top(t):
            while parent[t] != t:
                t = parent[t]
            return t

        for i, a in enumerate(texts):
            for b in texts[i + 1 :]:
                if alike(a, b):
                    parent[top(a)] = top(b)
        return {t: top(t) for t in texts}

    near = lambda a, b: near_dedup.similar(a.encode(), b.encode())
    jaccard = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b]))
    fine, coarse = partition(lambda a, b: jaccard(a, b) and near(a, b)), partition(near)
    text_of = {}
    for i, t in pairs:
        text_of.setdefault(i, t or "")
    class_of = {r.doc_id: r.class_id for r in found}
    assert len(found) == len(pairs)
    for i in class_of:
        for k in class_of:
            if fine[text_of[i]] == fine[text_of[k]]:
                assert class_of[i] == class_of[k]
            if class_of[i] == class_of[k]:
                assert coarse[text_of[i]] == coarse[text_of[k]]
    for r in found:
        assert r.class_id == min((i for i, c in class_of.items() if c == r.class_id and i is not None), default=None)
    kept = [r for r in found if r.kept]
    assert len({r.class_id for r in kept}) == len({r.class_id for r in found})


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    pairs = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        pairs.append((i, " ".join(w)))
    found = near_dedup.near_classes(docs_of(spark, pairs)).collect()
    assert {r.class_id for r in found} == {0}


def test_links_used_are_named_so(spark):
    text = " ".join(f"w{i}" for i in range(50))
    found = near_dedup.near_classes(docs_of(spark, [(i, f"{text} x{i}") for i in range(4)] + [(9, "alone")])).collect()
    used = {r.doc_id: r.links_used for r in found}
    assert used[9] == 0 and all(1 <= used[i] <= 3 for i in range(4))


def keys_of(text):
    words = next(near_dedup.scan_words(pa.array([text]), near_dedup.SpanHash()))
    return set(near_dedup.band_keys(words.text(0)).tolist())


def test_recall_of_the_keys_at_the_edit_similarity_of_links():
    rng = random.Random(13)
    for n, changed, least in ((40, 4, 0.99), (40, 8, 0.9), (100, 10, 0.99), (100, 15, 0.99), (100, 20, 0.95), (400, 80, 0.95)):
        met = 0
        for _ in range(200):
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for k in rng.sample(range(n), changed):
                other[k] = f"x{rng.randrange(10**6)}"
            x, y = " ".join(words), " ".join(other)
            assert near_dedup.similar(x.encode(), y.encode())
            met += bool(keys_of(x) & keys_of(y))
        assert met >= least * 200, (n, changed, met)


def test_near_pairs_in_a_large_family_of_unlike_texts(spark):
    rng = random.Random(12)
    common = [f"l{i}" for i in range(70)]  # of 100 words
    pairs, planted = [], []
    for i in range(0, 4000, 2):
        own = [f"u{rng.randrange(3000)}" for _ in range(30)]
        pairs.append((i, " ".join(common + own)))
        if i % 80 == 0:  # a near copy that shares the family's keys alone
            for k in rng.sample(range(30), 14):
                own[k] = f"x{rng.randrange(10**6)}"
            pairs.append((i + 1, " ".join(common + own)))
            if keys_of(pairs[-1][1]) & keys_of(pairs[-2][1]):
                planted.append((i, i + 1))
    class_of = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs_of(spark, pairs)).collect()}
    assert len(planted) > 30
    assert [p for p in planted if class_of[p[0]] != class_of[p[1]]] == []
    assert len(set(class_of.values())) == len(pairs) - len(planted)


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(vocabulary)
        elif kind == 1:
            out.insert(at, rng.choice(vocabulary))
        elif len(out) > 1:
            del out[at]
    return out


def test_linked_texts_meet_at_one_of_their_rarest_word_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    texts, linked = [], []
    while len(linked) < 150:
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))] + ["again"] * rng.randrange(60)
        other = edited(rng, words, rng.randrange(len(words) // 4 + 1), vocabulary)
        a, b = " ".join(words), " ".join(other)
        if a != b and near_dedup.similar(a.encode(), b.encode()):
            linked.append((len(texts), len(texts) + 1))
            texts += [a, b]
    hasher = near_dedup.SpanHash()
    codes = [w.text(i) for w in near_dedup.scan_words(pa.array(texts), hasher) for i in range(w.n)]
    for i, j in linked:  # parities never part linked texts
        n, m = len(texts[i].split()), len(texts[j].split())
        x, y = (near_dedup.parity(codes[k]).view("uint8") for k in (i, j))
        assert sum(int(v).bit_count() for v in x ^ y) <= 2 * int(0.2 * max(n, m) + 1e-6) - abs(n - m)
    alone = len(texts)  # shares a few words only with any other text
    texts.append(" ".join(["v1", "v2"] + [f"own{i}" for i in range(50)]))
    own = [(i, str(i).encode(), t, i, len(t.split()), near_dedup.parity(c).tolist()) for i, (t, c) in enumerate(zip(texts, codes + [codes[0]]))]
    own = spark.createDataFrame(own, "id long, node binary, text string, lab long, n_words long, bits array<long>")
    rows = {i: {} for i in range(len(texts))}
    for r in near_dedup.rarest(own, 0.8).collect():
        assert r.lab == int(r.node) and r.n_words == len(texts[r.lab].split())
        rows[r.lab][r.key] = set(r.before)
    assert not rows[alone]
    for i, j in linked:
        shared = rows[i].keys() & rows[j].keys()
        assert any(not rows[i][t] & rows[j][t] for t in shared)


def test_key_members_are_shuffled_once_and_not_joined(spark):
    rows = [(1, 10, b"a", 7), (1, 11, b"b", 7), (1, 12, b"c", 8), (2, 10, b"a", 7), (2, 11, b"b", 7), (3, 12, b"c", 8), (4, 9, b"d", 5), (4, 13, b"e", 6)]
    rows = spark.createDataFrame(rows, "key long, turn long, node binary, lab long")
    several = near_dedup._of_several(rows, "lab")
    found = near_dedup._with_major(several)
    got = {(r.key, r.turn): (r.major.turn, r.major.n, r.major.lab, r["size"]) for r in found.collect()}
    assert got == {(1, t): (10, 2, 7, 3) for t in (10, 11, 12)} | {(4, t): (13, 1, 6, 2) for t in (9, 13)}
    for df in (several, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1 + (df is found)


def test_pairs_of_the_rest_are_joined_with_texts_alone(spark, monkeypatch):
    rng = random.Random(12)
    common_line = [f"l{i}" for i in range(70)]
    pairs = [(i, " ".join(common_line + [f"u{rng.randrange(3000)}" for _ in range(30)])) for i in range(300)]
    plans, written = [], near_dedup.common.materialize

    def seen(df, name):
        if name == "pairs":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(near_dedup.common, "materialize", seen)
    assert len(near_dedup.near_classes(docs_of(spark, pairs)).collect()) == len(pairs)
    assert plans[-1].count("Join") == 1  # the rest: its own equi-join, no second look at lengths and parities
    assert all(p.count("Join") <= 2 for p in plans)


def test_a_family_behind_one_long_passage_meets_few_times_in_the_rest(spark, monkeypatch):
    rng = random.Random(21)
    passage = [f"p{rng.randrange(3000)}" for _ in range(620)]
    texts = [passage + [f"o{rng.randrange(2500)}" for _ in range(230)] for _ in range(60)]
    texts += [edited(rng, t, 30, [f"n{i}" for i in range(300)]) for t in texts[:5]]
    counts, plans, written = [], [], near_dedup.common.materialize

    def seen(df, name):
        table = written(df, name)
        if name == "pairs":
            counts.append(table.count())
        if name == "found":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return table

    monkeypatch.setattr(near_dedup.common, "materialize", seen)
    found = near_dedup.near_classes(docs_of(spark, list(enumerate(" ".join(t) for t in texts)))).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i if i < 60 else i - 60 for i in range(65)}
    assert counts[-1] < 100  # of 2,080; a parity of 1,024 bits is too full to part texts of 850 words
    assert plans and not any("Generate" in p for p in plans)  # pairs are not doubled to find their texts


def test_wide_parities_never_part_linked_texts(spark):
    rng = random.Random(22)
    vocabulary, pairs = [f"v{i}" for i in range(900)], []
    while len(pairs) < 40:
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(200, 1500))]
        other = edited(rng, words, rng.randrange(len(words) // 4 + 1), vocabulary)
        if near_dedup.similar(" ".join(words).encode(), " ".join(other).encode()):
            pairs.append((words, other))
    rows = []
    for texts in pairs:
        codes = [next(near_dedup.scan_words(pa.array([" ".join(t)]), near_dedup.SpanHash())).text(0) for t in texts]
        rows.append(tuple(x for t, c in zip(texts, codes) for x in (len(t), near_dedup.wide_parity(c).tolist())))
    sizes = {len(r[1]) for r in rows}
    df = spark.createDataFrame(rows, "n_a long, bits_a array<long>, n_b long, bits_b array<long>")
    assert sizes == {16, 80} and df.filter(near_dedup._may_link_wide("a", "b", 0.8)).count() == len(rows)


def test_copies_are_folded_before_they_are_written_and_word_pairs_are_not_written(spark, monkeypatch):
    rng = random.Random(23)
    common_line = [f"l{i}" for i in range(70)]
    texts = [" ".join(common_line + [f"u{rng.randrange(3000)}" for _ in range(30)]) for _ in range(100)]
    pairs = list(enumerate(texts + texts[:20] + [texts[0]] * 30)) + [(None, texts[1])]
    counts, plans, written = {}, {}, near_dedup.common.materialize

    def seen(df, name):
        table = written(df, name)
        counts[name] = table.count()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return table

    monkeypatch.setattr(near_dedup.common, "materialize", seen)
    found = near_dedup.near_classes(docs_of(spark, pairs)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.class_id) for r in found if r.doc_id != None) == sorted((False, i, texts.index(t)) for i, t in pairs if i is not None)  # noqa: E711
    assert [r.class_id for r in found if r.doc_id is None] == [1]
    assert counts["sketches"] == len(texts) and "rare" in counts and "word_pairs" not in counts
    assert counts["used"] <= len(texts) and plans["used"].count("hashpartitioning") == 0  # texts of pairs are found without a shuffle of all texts


def test_classes_are_the_same_broadcast_or_shuffled(spark, monkeypatch):
    rng = random.Random(6)
    pairs = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(60)] + ["filler", "again"] * (20 * (family % 3))
        for copy in range(5):
            pairs.append((len(pairs), " ".join(edited(rng, base, copy * 4, [f"n{i}" for i in range(300)]))))
    docs = docs_of(spark, pairs)
    classes = lambda: {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    sent = classes()
    monkeypatch.setattr(near_dedup, "_SMALL", -1)
    monkeypatch.setattr(near_dedup, "_SMALL_TEXTS", -1)
    assert classes() == sent and len(set(sent.values())) < len(pairs)


def brute_edit(pairs):
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), p[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + nxt[:half]))
    return out


def test_fingerprints(spark):
    import hashlib

    rng = random.Random(8)
    pairs = odd_pairs() + [(50 + i, " ".join(f"q{rng.randrange(400)}" for _ in range(rng.randint(20, 200)))) for i in range(80)]
    found = order_minhash.fingerprints(docs_of(spark, pairs)).collect()
    expected = sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in brute_edit(pairs)), key=str)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == expected
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[5][0].fingerprint == by_id[5][1].fingerprint
    assert by_id[6][0].fingerprint == by_id[7][0].fingerprint != by_id[50][0].fingerprint
    assert by_id[7][0].near_next == 1.0  # 6 follows 7 and is equal
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint
    plain = [r for r in found if r.doc_id and r.doc_id >= 51]
    assert sum(r.near_edited for r in plain) > 5 * sum(r.near_next for r in plain)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_fingerprints_follow_order(spark):
    w = [f"o{i}" for i in range(400)]
    blocks = [w[i : i + 20] for i in range(0, 400, 20)]
    random.Random(2).shuffle(blocks)
    moved = [x for b in blocks for x in b]
    light = list(w)
    light[100] = "changed"
    texts = {1: " ".join(w), 2: " ".join(moved), 3: " ".join(light)}
    found = order_minhash.fingerprints(docs_of(spark, list(texts.items()))).collect()
    by_id = {r.doc_id: r.fingerprint for r in found}
    same = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8))
    assert same(by_id[1], by_id[3]) > same(by_id[1], by_id[2])


def brute_contaminated(pairs, items):
    out = set()
    tokens = decontamination.Tokens()
    table = {}
    for item, text in items:
        w = (text or "").split()
        n = min(13, len(w))
        for h, _, slots in decontamination.windows(w, tokens, n) if n >= 6 else []:
            table.setdefault((n, h, slots), set()).add(item)
    for i, text in pairs:
        w = (text or "").split()
        for n in {k[0] for k in table}:
            for h, _, slots in decontamination.windows(w, tokens, n):
                out |= {(i, item) for item in table.get((n, h, slots), ())}
    return out


def test_decontamination_catches_changed_numbers_and_names(spark):
    question = "A train leaves town at 40 km per hour and after 3 hours Alice meets Bob who walked 40 km that day."
    other = "A train leaves town at 55 km per hour and after 7 hours Carla meets Dora who walked 55 km that day."
    broken = "A train leaves town at 55 km per hour and after 7 hours Carla meets Carla who walked 21 km that day."
    items = [(1, question), (2, None), (3, "too short"), (4, "seven plain words stand in this item")]
    pairs = odd_pairs() + [
        (20, "Before it. " + question),
        (21, "Some text first. " + other + " And more follows."),
        (22, "We know that seven plain words stand in this item, indeed."),
        (23, "A train leaves town and nothing else happens here at all on this quiet day."),
        (24, broken),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(docs_of(spark, pairs), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found == brute_contaminated(pairs, items)
    assert {(20, 1), (21, 1), (22, 4)} <= found and 23 not in {i for i, _ in found}
    unfiltered = decontamination.contaminated(docs_of(spark, pairs), benchmark, filter_rows=0).collect()
    assert {(r.doc_id, r.item_id, r.n_windows) for r in unfiltered} == {(r.doc_id, r.item_id, r.n_windows) for r in rows}
    whole = decontamination.windows(broken.split(), decontamination.Tokens(), 13)
    assert len(whole) > 0


def test_decontamination_names_that_begin_sentences_and_values_equal_by_chance(spark):
    items = [
        (1, "Alice has 5 apples and buys 7 more apples at the shop today."),
        (2, "A red box holds 5 blue marbles and 3 green ones on the shelf."),
        (3, "A grey box holds 6 blue marbles and 6 green ones on the shelf."),
    ]
    pairs = [
        (30, "Carla has 9 apples and buys 4 more apples at the shop today."),
        (31, "A red box holds 4 blue marbles and 4 green ones on the shelf."),
        (32, "A grey box holds 4 blue marbles and 9 green ones on the shelf."),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for filter_rows in (decontamination.FILTER_ROWS, 0):
        rows = decontamination.contaminated(docs_of(spark, pairs), benchmark, filter_rows=filter_rows).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(30, 1), (31, 2)}


def test_decontamination_of_short_and_number_heavy_items(spark):
    items = [
        (1, "What is photosynthesis exactly?"),
        (2, "Solve 12 14 18 20 22 24 26 28 30 32 34 36 38 40 42 now"),
        (3, "Add 7 and 9"),
        (4, "..."),
    ]
    pairs = [
        (40, "They asked: what is photosynthesis exactly? Nobody knew."),
        (41, "Again: solve 12 14 18 20 22 24 26 28 30 32 34 36 38 40 42 now please"),
        (42, "Again: solve 13 14 18 20 22 25 26 28 30 33 34 36 38 41 42 now please"),
        (43, "Please add 7 and 8 - or 9 ..."),
        (44, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for filter_rows in (decontamination.FILTER_ROWS, 0):
        rows = decontamination.contaminated(docs_of(spark, pairs), benchmark, filter_rows=filter_rows).collect()
        assert {(r.doc_id, r.item_id, r.n_windows) for r in rows} == {(40, 1, 1), (41, 2, 5)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_classes(empty).count() == 0
    assert order_minhash.fingerprints(empty).count() == 0
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs_of(spark, odd_pairs()), benchmark).count() == 0
