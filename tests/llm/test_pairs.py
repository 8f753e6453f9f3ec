"""Near duplicates, repeated substrings, contamination: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, near_duplicates, substrings
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.fm_index import FmIndex, LeastInRange, matching_intervals, suffix_array
from tests.llm.conftest import AWKWARD


def edited(text, draw, share):
    words = text.split()
    for i in range(len(words)):
        if draw.random() < share:
            words[i] = f"new{draw.randint(0, 999)}"
    return " ".join(words)


@pytest.fixture
def corpus(prose):
    draw = random.Random(3)
    bases = [prose(draw.randint(20, 200)) for _ in range(12)]
    passage = prose(70)
    texts = bases + [b for b in bases[:4] for _ in range(3)] + [edited(b, draw, s) for b in bases for s in (0.005, 0.02, 0.04, 0.1)]
    texts += [f"{prose(30)} {passage} {prose(draw.randint(0, 40))}" for _ in range(10)] + [f"{passage} " * 3] + AWKWARD
    return texts


def brute_classes(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, label = [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * union:
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {i: (label[i], links[i]) for i in range(len(texts))}


def test_jaccard_join(spark, documents, corpus):
    found = near_duplicates.jaccard_join(documents(corpus, extra=("class_id", "island", "rep", "set_a", "signature")))
    assert {r.doc_id: (r.class_id, r.n_links) for r in found.collect()} == brute_classes(corpus)


def test_jaccard_join_cuts_large_groups(spark, documents, corpus, monkeypatch):
    """Blocks of few rows give the same links; functions are pickled by reference, so only the plan's side is patched."""
    monkeypatch.setattr(near_duplicates, "_BLOCK_ROWS", 3)
    found = near_duplicates.jaccard_join(documents(corpus))
    assert {r.doc_id: (r.class_id, r.n_links) for r in found.collect()} == brute_classes(corpus)


def test_jaccard_join_edges(spark, documents, prose):
    text = prose(40)
    rows = near_duplicates.jaccard_join(documents([(None, text), (5, text), (5, text), (3, text), (9, None)])).collect()
    assert sorted((r.doc_id or -1, r.class_id, r.n_links) for r in rows) == [(-1, None, 0), (3, 3, 2), (5, 3, 2), (5, 3, 2), (9, 9, 0)]
    assert near_duplicates.jaccard_join(documents([])).count() == 0


def test_pruning_keeps_similar_pairs():
    draw = np.random.default_rng(0)
    kept = dropped = 0
    for _ in range(100):
        base = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
        near, far = np.concatenate([base[:360], draw.integers(0, 1 << 63, 40, dtype=np.uint64)]), np.concatenate([base[:120], draw.integers(0, 1 << 63, 280, dtype=np.uint64)])
        sign = lambda s: (near_duplicates.mix(near_duplicates.minhash(s).astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
        found = near_duplicates.survivors(sign(base), np.stack([sign(near), sign(far)]), 0.8, 1e-6)
        kept, dropped = kept + (0 in found), dropped + (1 not in found)
    assert kept == 100 and dropped == 100


def test_jaccard_join_of_shared_ids(spark, documents, prose):
    """Rows that share a doc_id are judged each by its own text, even where both texts lead a class."""
    one, two = prose(60), prose(60)
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, two + " y"), (1, one)]
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.jaccard_join(documents(rows)).collect())
    assert found == [(1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]


def test_jaccard_join_finds_every_pair_of_planted_copies(spark, documents, prose):
    """Recall against brute force by the number of edited words: 1 wherever the similarity is 0.8 or more."""
    draw = random.Random(12)
    for edits in (1, 2, 4):
        texts = [t for _ in range(25) for t in [prose(150)] * 2]
        for i in range(1, len(texts), 2):
            words = texts[i].split()
            for at in draw.sample(range(len(words)), edits):
                words[at] = f"edit{at}"
            texts[i] = " ".join(words)
        got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.jaccard_join(documents(texts)).collect()}
        assert got == brute_classes(texts)


def test_components(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(draw.randint(100, 160), draw.randint(100, 160)) for _ in range(40)] + [(300, 200), (300, 200)]
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {n: low if x == high else x for n, x in label.items()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: c for n, c in label.items() if n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_in_range():
    draw = np.random.default_rng(3)
    for n in (1, 5, 32, 33, 64, 65, 700):
        values = draw.integers(0, 1000, n).astype(np.int32)
        least = LeastInRange(values)
        low = draw.integers(0, n, 400)
        high = np.array([draw.integers(a + 1, n + 1) for a in low])
        assert least(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high)]


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(50):
        text = [draw.randint(1, 3) for _ in range(draw.randint(1, 40))] + [0]
        order, shared = suffix_array(np.array(text))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: next(k for k in range(len(text)) if text[a + k] != text[b + k])
        assert shared.tolist() == [-1, *(common(a, b) for a, b in zip(order[:-1], order[1:])), -1]


def test_matching_intervals():
    draw = random.Random(2)
    for _ in range(60):
        length, symbols = draw.choice([1, 2, 4]), draw.choice([2, 4])
        texts = [[draw.randint(2, 1 + symbols) for _ in range(draw.randint(1, 20))] for _ in range(3)]
        owners = [draw.randint(0, 4) for _ in texts]
        index = FmIndex(np.concatenate([np.array([*t, 1]) for t in texts]), np.concatenate([np.full(len(t) + 1, o) for t, o in zip(texts, owners)]))
        query, below = [draw.choice([-1, *range(2, 2 + symbols)]) for _ in range(30)], draw.randint(0, 5)
        known = np.array([x if x <= index.most else -1 for x in query])
        _, starts, ends = matching_intervals(index, known, np.array([0, 30]), np.array([below]), length)
        got = {i for a, b in zip(starts, ends) for i in range(a, b - length + 1)}
        inside = lambda p: any(o < below and any(t[k : k + length] == p for k in range(len(t) - length + 1)) for t, o in zip(texts, owners))
        assert got == {i for i in range(30 - length + 1) if inside(query[i : i + length])}


def brute_substrings(rows, length):
    least = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and least[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 12, 4])
def test_substring_dedup(spark, documents, corpus, length):
    rows = [(7 * i % 101, t) for i, t in enumerate(corpus)] + [(None, corpus[0]), (7, corpus[1]), (500, "p q " * 200)]
    found = substrings.deduplicate_substrings(documents(rows, extra=("row_key", "intervals", "base")), length, carry=("lang",))
    got = [(r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in found.collect()]
    assert sorted(got, key=str) == brute_substrings(rows, length)
    assert found.columns == ["doc_id", "kept_text", "n_words", "n_removed", "lang"]


def test_substring_dedup_leaves_texts_alone(spark, documents):
    texts = ["  two  spaces\n", None, ""]
    assert [r.kept_text for r in substrings.deduplicate_substrings(documents(texts)).orderBy("doc_id").collect()] == ["  two  spaces\n", "", ""]
    assert substrings.deduplicate_substrings(documents([])).count() == 0


def test_substring_dedup_spreads_hot_anchors(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(substrings, "_COPY_ANCHORS", 3)
    monkeypatch.setattr(substrings, "_LOT_WORDS", 20)
    monkeypatch.setattr(substrings, "_SHARD_ANCHORS", 5)
    passage = prose(60)
    rows = [(i, f"{prose(15)} {passage} {prose(15)}") for i in range(25)]
    got = [(r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in substrings.deduplicate_substrings(documents(rows)).collect()]
    assert sorted(got, key=str) == brute_substrings(rows, 50)


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row), row.index(min(row))


def test_myers():
    draw = random.Random(0)
    for _ in range(500):
        pattern, text = (bytes(draw.choices(b"ab c", k=k)) for k in (draw.randint(1, 12), draw.randint(0, 25)))
        best = brute_distance(pattern, text)
        assert decontamination.myers(pattern, text, len(pattern) - 1) == (best if best[0] < len(pattern) else None)


def test_decontamination(spark, documents, prose):
    draw = random.Random(8)
    items = [(i, prose(25)) for i in range(8)] + [(8, None), (9, "…!"), (10, "Née À L'école!")]
    def damaged(text, n):
        chars = list(text)
        for _ in range(n):
            chars[draw.randrange(len(chars))] = draw.choice("xyz")
        return "".join(chars)
    rows = [f"{prose(20)} {t.upper()}!! {prose(9)}" for _, t in items[:3]] + [prose(60) for _ in range(5)]
    rows += [f"{prose(5)} {damaged(t, n)} {prose(5)}" for _, t in items[:8] for n in (1, 3, 6, 9, 14)] + [items[3][1], f"{items[4][1]} {items[5][1]}", "« née à l’école » née à l'école"] + AWKWARD
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = set()
    for d, text in enumerate(rows):
        for i, item in items:
            wanted = decontamination.normalised_text(item or "")
            budget = int(0.05 * len(wanted))
            if wanted and (best := brute_distance(wanted, decontamination.normalised_text(text or "") + b" "))[0] <= budget:
                expected.add((d, i, best[0]))
    for block_bytes in (1 << 20, 300):
        found = decontamination.find_contamination(documents(rows, extra=("item_id",)), benchmark, block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected
    shown = {(r.doc_id, r.item_id): rows[r.doc_id][r.start : r.end] for r in found}
    assert shown[0, 0] == items[0][1].upper() and shown[next(d for d, t in enumerate(rows) if t == items[3][1]), 3] == items[3][1]
    assert len(expected) > 25
    assert decontamination.find_contamination(documents([]), benchmark).count() == 0
    assert decontamination.find_contamination(documents(rows), benchmark.limit(0)).count() == 0


def test_edited_items_are_found(spark, documents, prose):
    """At the rate of the query: no item within its budget is missed, short ones included."""
    draw = random.Random(12)
    items = [(i, prose(n)) for i, n in enumerate((3, 4, 6, 14, 14, 25, 40))] + [(None, prose(14))]
    rows = []
    for _, text in items:
        for n in (1, 2, 3, 5, 8, 12):
            chars = list(text)
            for _ in range(n):
                at = draw.randrange(len(chars))
                chars[at] = draw.choice(["", "é", "q", chars[at] + "z"])
            rows.append(f"{prose(5)} {''.join(chars)} {prose(5)}")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, item in items:
        wanted = decontamination.normalised_text(item)
        budget = decontamination.edit_budget(len(wanted), decontamination.CONTAMINATED_RATE, decontamination.LEAST_EDITS)
        assert budget >= max(len(wanted) // 10, min(3, len(wanted) // 8))
        for d, text in enumerate(rows):
            if (best := brute_distance(wanted, decontamination.normalised_text(text) + b" "))[0] <= budget:
                expected.add((d, i, best[0]))
    found = decontamination.find_contamination(documents(rows), benchmark, decontamination.CONTAMINATED_RATE, least_edits=decontamination.LEAST_EDITS).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected and len(expected) > 25


def test_repeated_rows_are_searched_once(spark, documents, prose):
    shared, other = prose(70), prose(300)
    texts = [(1, f"{prose(10)} {shared}")] + [(2, f"{other} {shared}")] * 3000 + [(3, other), (4, prose(5))]
    df = substrings.deduplicate_substrings(documents(texts)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, df)) == [(1, 0, 1), (2, 70, 3000), (3, 300, 1), (4, 0, 1)]
