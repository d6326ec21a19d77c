"""Substring, suffix and near-duplicate removal against brute force."""

import random

import numpy as np
import pytest
from cases import SCHEMA, components, edge_rows, frame, ordered, prose, repeated_strings, repeated_windows, shared_ids, shingle_set

from casetrail.llm import exchange, neardup, suffixes
from casetrail.llm.components import connected_components, merge_components
from casetrail.llm.neardup import near_duplicates
from casetrail.llm.suffixes import merge_runs, remove_repeated_strings
from casetrail.llm.windows import remove_repeated_windows


def near_copies(n, seed):
    """Copies of one text, each with its own changed words, and others that share only a part of it."""
    rng = random.Random(seed)
    base = prose(rng, 150).split()
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(150), k % 9):
            own[at] = f"w{k}x{at}"
        rows.append((k, " ".join(own[: 150 - k % 4]), "en", "a"))
    half = base[:75]
    rows += [(1000 + k, " ".join(half + prose(rng, 75).split()), "en", "a") for k in range(20)]
    return rows


def test_windows_match_brute_force(spark):
    rows = edge_rows()
    got = remove_repeated_windows(frame(spark, rows)).drop("kept_text").collect()
    assert ordered(got) == ordered(repeated_windows(rows, 20))


def test_windows_of_other_widths_and_kept_text(spark):
    rows = edge_rows(2)
    got = remove_repeated_windows(frame(spark, rows), width=5)
    assert ordered(got.drop("kept_text").collect()) == ordered(repeated_windows(rows, 5))
    assert got.where("sha2(kept_text, 256) <> kept_sha256").isEmpty()


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    from casetrail.llm import windows

    monkeypatch.setattr(windows.Cells, "sized", staticmethod(lambda *a: exchange.Cells(1 << 16, 2, 1 << 16)))
    rows = edge_rows(3)
    got = remove_repeated_windows(frame(spark, rows), texts=False).drop("kept_text").collect()
    assert ordered(got) == ordered(repeated_windows(rows, 20))


@pytest.mark.parametrize("length", [50, 30])
def test_strings_match_brute_force(spark, length):
    rows = edge_rows()
    got = remove_repeated_strings(frame(spark, rows), length).drop("kept").collect()
    assert ordered(got) == ordered(repeated_strings(rows, length))


def test_kept_bytes_are_returned(spark):
    got = remove_repeated_strings(frame(spark, edge_rows()))
    assert got.where("sha2(kept, 256) <> kept_sha256 OR length(kept) <> n_bytes - n_removed").isEmpty()


def test_strings_of_near_copies(spark):
    rows = near_copies(60, 5)
    got = remove_repeated_strings(frame(spark, rows), texts=False).drop("kept").collect()
    assert ordered(got) == ordered(repeated_strings(rows, 50))


def test_loser_tree_merges_and_gives_common_prefixes():
    rng = random.Random(4)
    runs = []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40)))
        common = [0] + [suffixes.common_prefix(a, b, 0) for a, b in zip(strings, strings[1:])]
        runs.append((strings, common[: len(strings)]))
    order, prefixes = merge_runs(runs)
    merged = [runs[r][0][k] for r, k in order]
    assert merged == sorted(s for strings, _ in runs for s in strings)
    assert prefixes[1:] == [suffixes.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:])]
    assert merge_runs([([], [])]) == ([], [])


def test_near_duplicates_match_brute_force(spark):
    rows = edge_rows()
    assert ordered(near_duplicates(frame(spark, rows)).drop("first", "text_hash").collect()) == ordered(components(rows))


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = near_copies(150, 6)
    assert ordered(near_duplicates(frame(spark, rows)).drop("first", "text_hash").collect()) == ordered(components(rows))


def test_members_of_a_bucket_are_linked_without_its_head(spark, monkeypatch):
    """Two chains that only whole buckets connect."""
    monkeypatch.setattr(neardup, "HEAD_ROUNDS", 0)
    rows = near_copies(80, 7)
    assert ordered(near_duplicates(frame(spark, rows)).drop("first", "text_hash").collect()) == ordered(components(rows))


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    for share in (0.6, 0.75, 0.9):
        a = rng.integers(1, 2**63, 2000).astype(np.uint64)
        common = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:common], rng.integers(1, 2**63, 2000 - common).astype(np.uint64)])
        samples = neardup.minhashes(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 2000]))
        x, y = neardup.odd_sketches(samples).view(np.uint64)
        assert abs(neardup.estimated_similarity(int(np.bitwise_count(x ^ y).sum())) - share) < 0.15


def test_shingle_sets():
    texts = ["a b c d e f A B C D E F", "", " ", "x", "x y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    _, first = neardup.shingles(data, np.cumsum([0] + [len(t) for t in texts]))
    assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts]


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_merge(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = connected_components(edges([(1, 2), (3, 4), (5, 6)]))
    got = dict(merge_components(labels, edges([(4, 2), (9, 6), (7, 8), (1, 2)])).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 7: 7, 8: 7}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_windows(empty).isEmpty()
    assert remove_repeated_strings(empty).isEmpty()
    assert near_duplicates(empty).isEmpty()


def test_rows_that_share_or_lack_an_id_are_judged_by_their_texts(spark):
    rows = shared_ids()
    found = remove_repeated_strings(frame(spark, rows)).drop("kept").collect()
    assert ordered(found) == ordered(repeated_strings(rows, 50))
    clean = [r for r in found if r["doc_id"] is None and r["n_removed"] == 0]
    assert len(clean) == 3 and all(r["n_removed"] in (0, r["n_bytes"]) for r in found if r["doc_id"] == 2)
    near = near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert ordered(near) == ordered(components(rows))


def test_one_row_of_each_group_stays_in_the_pipeline(spark):
    import corpus_pipeline

    rows = shared_ids()
    docs = frame(spark, rows)
    kept = ordered(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id", "text").collect())
    a, b, c, d, e = rows[0][1], rows[4][1], rows[2][1], rows[5][1], rows[9][1]
    assert kept == ordered([(1, a), (2, c), (None, b), (None, d), (5, e), (6, None), (6, rows[11][1])])
