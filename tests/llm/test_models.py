"""Whole results of sharding, learned limits and language-model scores against brute force."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casetrail.llm.language_model import score_texts
from casetrail.llm.quality import FENCES, REACH, quality_verdicts
from casetrail.llm.sharding import BUNDLES, SHARE, shard_by_size
from tests.llm.cases import WORD, edge_rows, frame, prose


def longest_first(sizes, n_shards):
    """Loads after each item has gone to the least-loaded shard, the longest first, by looking at all shards each time."""
    loads = [0] * n_shards
    for size in sorted(sizes, reverse=True):
        loads[min(range(n_shards), key=lambda s: loads[s])] += size
    return sorted(loads)


@pytest.mark.parametrize("n_shards", [1, 3, 16])
def test_shard_loads_are_those_of_longest_first(spark, n_shards):
    """Groups of very different sizes, repeated, tied and missing texts and ids among them."""
    rng = random.Random(31)
    rows = edge_rows(31) + [(1000 + k, prose(rng, int(1.3**rng.randint(0, 22)) + 1), "en", "a") for k in range(200)]
    rows += [(2000 + k, "tied " * (k // 3 + 1), "en", "a") for k in range(60)] + [(None, "no id", "en", "a"), (None, None, "en", "a")]
    groups = Counter()
    for _, text, *_ in rows:
        groups[text or ""] += len((text or "").encode()) + 1
    total = sum(groups.values())
    texts = spark.createDataFrame([(t,) for t in groups], "text string")
    bundle = {r[0]: r[1] for r in texts.select("text", F.pmod(F.xxhash64("text"), F.lit(BUNDLES))).collect()}
    items = Counter()
    for text, size in groups.items():
        items[text if size * n_shards * SHARE >= total else bundle[text]] += size
    assert n_shards == 1 or any(isinstance(i, int) for i in items) and any(isinstance(i, str) for i in items)
    got = shard_by_size(frame(spark, rows), n_shards).collect()
    loads = [0] * n_shards
    for r in got:
        loads[r["shard"]] += r["size"]
    assert len(got) == len(rows) and sorted(loads) == longest_first(items.values(), n_shards)


def test_texts_of_like_sizes_are_all_scheduled_alone(spark):
    """Where no group is small, the loads are those of the plain schedule of the groups."""
    rng = random.Random(34)
    sizes = [rng.randint(10, 200) for _ in range(90)]
    rows = [(k, f"{k:03}" + "x" * (n - 4), "en", "a") for k, n in enumerate(sizes)]
    for n_shards in (4, 16):
        loads = [r[1] for r in shard_by_size(frame(spark, rows), n_shards).groupBy("shard").agg(F.sum("size")).collect()]
        assert sorted(loads) == longest_first(sizes, n_shards)


def quantile(values, q):
    return sorted(values)[max(math.ceil(q * len(values)), 1) - 1]


def test_limits_are_those_of_the_sorted_values(spark):
    """Verdicts recomputed from exact quantiles of each (language, source), its language, or all rows."""
    rng = random.Random(32)
    rows = []
    for k in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "c"), (None, None), ("fr", "few")]) if k % 40 else ("en", "rare")
        words = [w + "#" * (rng.random() < 0.05) + "!" * (rng.random() < 0.1) for w in prose(rng, rng.randint(20, 60)).split()]
        if rng.random() < 0.05:
            words = [w.upper() + "$$" for w in words]
        rows.append((k, " ".join(words), lang, source))
    got = {r["doc_id"]: r for r in quality_verdicts(frame(spark, rows)).collect()}
    where = {k: (lang, source) for k, _, lang, source in rows}
    judged = [k for k in got if not got[k]["base_failed"]]
    for k, (lang, source) in where.items():
        own = [j for j in judged if where[j] == (lang, source)]
        of_lang = [j for j in judged if where[j][0] == lang]
        chosen = own if len(own) >= 100 else of_lang if len(of_lang) >= 100 else judged
        over = False
        for fence in FENCES:
            values = [got[j][fence.metric] for j in chosen]
            low, mid = quantile(values, 0.25), quantile(values, 0.5)
            limit = mid + max(fence.gap, REACH * (mid - low))
            assert math.isclose(got[k]["max_" + fence.metric], limit, rel_tol=1e-9, abs_tol=1e-12)
            over |= got[k][fence.metric] > limit
        assert got[k]["kept"] == (not got[k]["base_failed"] and not over)
    assert 0 < sum(not r["kept"] for r in got.values()) < 100


def bin_index(count):
    return count if count < 8 else min(8 + max(math.floor(2 * math.log2(count)) - 6, 0), 63)


def bin_value(index):
    return index if index < 8 else 2 ** ((index - 8 + 6.5) / 2)


def bucket_of(count):
    return min(1 + math.floor(math.log2(count)), 23) if count > 0 else 0


def scores(rows):
    """Base and model scores from dictionaries of counts, with one loop over all cells per round of learning."""
    tokens = {}
    for n, (doc_id, text, *_) in enumerate(rows):
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        tokens[n] = (doc_id, held, WORD.findall(lowered) + [None])
    words, pairs, n_texts = Counter(), Counter(), 0
    for _, held, own in tokens.values():
        if not held:
            n_texts += 1
            words.update(own)
            pairs.update(zip(["", *own[:-1]], own))
    n, v = sum(words.values()), len(words)
    context_count = lambda c: n_texts if c == "" else words[c]
    cells = Counter()
    for _, held, own in tokens.values():
        if not held:
            for c, w in zip(["", *own[:-1]], own):
                cells[bin_index(pairs[c, w] - 1), bin_index(context_count(c) - 1), bin_index(words[w] - 1)] += 1
    weights = {b: [0.2, 0.3, 0.5] if b else [0.5, 0.5, 0.0] for b in range(24)}
    for _ in range(60):
        sums = {b: [0.0, 0.0, 0.0] for b in range(24)}
        for (pair, context, word), times in cells.items():
            seen = bin_value(context)
            parts = [1 / (v + 1), bin_value(word) / max(n - 1, 1), min(bin_value(pair) / seen, 1.0) if context else 0.0]
            b = bucket_of(round(seen))
            total = sum(w * p for w, p in zip(weights[b], parts))
            for k in range(3):
                sums[b][k] += times * weights[b][k] * parts[k] / total
        for b, found in sums.items():
            if sum(found) > 0:
                raised = [max(found[0] / sum(found), 1e-6), found[1] / sum(found), found[2] / sum(found)]
                weights[b] = [x / sum(raised) for x in raised]
    out = []
    for doc_id, held, own in tokens.values():
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        score = 0.0
        for c, w in zip(["", *own[:-1]], own):
            k = weights[bucket_of(context_count(c))]
            bigram = pairs[c, w] / context_count(c) if context_count(c) else 0.0
            score += math.log10(k[0] / (v + 1) + k[1] * words[w] / max(n, 1) + k[2] * bigram)
        out.append((doc_id, held, len(own), base, score))
    return out


def test_scores_match_brute_force(spark):
    rng = random.Random(33)
    rows = edge_rows(33) + [(500 + k, prose(rng, rng.randint(0, 150)), "en", "a") for k in range(150)]
    rows += [(700 + k, "the same few words again and again " * 20, "en", "a") for k in range(3)] + [(None, "a row without an id", "en", "a")]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got = sorted((tuple(r) for r in score_texts(frame(spark, rows)).select("doc_id", "held_out", "n_tokens", "base_score", "score").collect()), key=key)
    want = sorted(scores(rows), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for ours, theirs in zip(got, want):
        assert math.isclose(ours[3], theirs[3], rel_tol=1e-9) and math.isclose(ours[4], theirs[4], rel_tol=1e-7)
