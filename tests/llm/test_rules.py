"""Quality rules, mixing and sharding."""

import math
import random
import re
import zlib

import pytest
from cases import SCHEMA, WORD, edge_rows, frame, ordered, prose
from pyspark.sql import functions as F

from casetrail.llm.mixing import hypergeometric, mix_sources, splitting_tree, targets
from casetrail.llm.quality import quality_verdicts
from casetrail.llm.sharding import shard_by_size

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_counts(rows):
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
        n = len(w)
        out.append(
            (doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)
        )
    return out


def quality_rows():
    rng = random.Random(11)
    rows = edge_rows(11)
    line = prose(rng, 9)
    rows += [
        (200, "\n".join([line, prose(rng, 30), line, prose(rng, 20), line]), "en", "a"),
        (201, " ".join(w + "$$$" for w in prose(rng, 60).split()), "en", "a"),
        (202, prose(rng, 60).upper(), "en", "a"),
        (203, "a b c d e f g h " * 9, "en", "a"),
    ]
    return rows + [(300 + k, prose(rng, 60), "en", "a") for k in range(150)]


def test_base_counts_match_brute_force(spark):
    rows = quality_rows()
    assert ordered(quality_verdicts(frame(spark, rows)).select(*BASE).collect()) == ordered(base_counts(rows))


def test_junk_goes_and_clean_text_stays(spark):
    kept = {r[0]: r[1] for r in quality_verdicts(frame(spark, quality_rows())).select("doc_id", "kept").collect()}
    assert not kept[201] and not kept[202] and not kept[203]
    assert all(kept[300 + k] for k in range(150)) and kept[17]


def test_limits_follow_each_source(spark):
    """What is usual in a source passes there and fails elsewhere."""
    rng = random.Random(12)
    marked = lambda: " ".join(w + "#" for w in prose(rng, 40).split())
    rows = [(k, marked(), "en", "code") for k in range(120)] + [(200 + k, prose(rng, 40), "en", "news") for k in range(120)]
    rows += [(999, marked(), "en", "news"), (998, marked(), "en", "rare")]
    kept = {r[0]: r[1] for r in quality_verdicts(frame(spark, rows)).select("doc_id", "kept").collect()}
    assert kept[5] and kept[205] and not kept[999]
    # Too few rows for sketches of its own: the language's decide, in which both kinds are common.
    assert kept[998]


def water_fill(sizes):
    """Targets by repeated resharing, as the definition says."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_match_resharing(spark):
    rng = random.Random(13)
    for n in (1, 2, 7, 20):
        sizes = {f"s{k:02}": rng.randint(0, 1000) for k in range(n - 1)} | {None: 500}
        got = targets(spark.createDataFrame([(s, w, 1) for s, w in sizes.items()], "source string, words long, rows long")).collect()
        want = water_fill(sizes)
        assert len(got) == n and all(math.isclose(r["target"], want[r["source"]], abs_tol=1e-6) for r in got)


def test_mix_meets_targets(spark):
    rows = edge_rows(14)
    got = mix_sources(frame(spark, rows), n_shards=4).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = water_fill(sizes)
    for source, target in want.items():
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - target) <= 0.5
        assert all(r["source_size"] == sizes[source] and math.isclose(r["target"], target, abs_tol=1e-6) for r in mine)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"]) for r in got)
    assert ordered(got) == ordered(mix_sources(frame(spark, rows).repartition(5), n_shards=4).collect())


def test_mix_of_many_blocks(spark, monkeypatch):
    from casetrail.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    rows = edge_rows(15)
    got = mix_sources(frame(spark, rows), n_shards=8).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    for source, target in water_fill(sizes).items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 0.5
    assert {d["shard"] for r in got for d in r["draws"]} <= set(range(8))


def test_blocks_that_are_not_taken_have_no_draws(spark, monkeypatch):
    """A source of many blocks, far above its target, fills exactly the places that the tree gives it."""
    from casetrail.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    monkeypatch.setattr(mixing, "TOTAL_SHARE", 0.3)
    asked = []
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, *a: asked.append((quotas, a)) or splitting_tree(quotas, *a))
    # Rows of one word, so every drawn block shows in the draws of its rows.
    docs = frame(spark, [(k, "word", "en", "hot" if k < 300 else "rare") for k in range(330)])
    n_blocks = F.when(F.col("source") == "hot", 300).otherwise(30)
    block_of = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), n_blocks)).collect()}
    got = mix_sources(docs, n_shards=4).collect()
    drawn = {(r["source"], block_of[r["doc_id"]], d["shard"]) for r in got for d in r["draws"]}
    assert {shard for _, _, shard in drawn} == set(range(4))
    plan = {(r["source"], r["shard"]): r["n"] for r in splitting_tree(asked[0][0], *asked[0][1]).collect()}
    assert sum(n for (source, _), n in plan.items() if source == "hot") < 100
    counts = {key: sum((source, shard) == key for source, _, shard in drawn) for key in plan}
    assert counts == plan


def test_splitting_tree_meets_quotas_exactly(spark):
    quotas = [("a", 500), ("b", 40), ("c", 3), ("d", 0), (None, 70)]
    row = spark.createDataFrame([(quotas,)], "quotas array<struct<source:string,n:long>>")
    leaves = splitting_tree(row, 8, 3).collect()
    per_source, per_shard = {}, {}
    for r in leaves:
        per_source[r["source"]] = per_source.get(r["source"], 0) + r["n"]
        per_shard[r["shard"]] = per_shard.get(r["shard"], 0) + r["n"]
    assert per_source == dict(quotas) and all(r["n"] >= 0 for r in leaves)
    assert max(per_shard.values()) - min(per_shard.values()) <= 3
    with pytest.raises(ValueError):
        splitting_tree(row, 6, 3)


def test_hypergeometric_draws_follow_the_distribution(spark):
    total, marked, drawn, n = 30, 11, 13, 4000
    u = (F.col("id") + 0.5) / n
    got = spark.range(n).select(hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u).alias("x")).groupBy("x").count().collect()
    for x, count in got:
        p = math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)
        assert abs(count / n - p) < 2 / n + 1e-9


def test_sharding(spark):
    rows = edge_rows(16)
    got = shard_by_size(frame(spark, rows), 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == ordered((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    shard_of = {}
    for r in got:
        shard_of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_are_near_equal(spark):
    rng = random.Random(17)
    rows = [(k, prose(rng, rng.randint(1, 120)), "en", "a") for k in range(2000)] + [(9000 + k, "the same text", "en", "a") for k in range(300)]
    loads = [r[1] for r in shard_by_size(frame(spark, rows), 16).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 0.01 * max(loads)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_verdicts(empty).isEmpty() and mix_sources(empty).isEmpty() and shard_by_size(empty).isEmpty()


def test_native_plans_have_no_python(spark):
    docs = frame(spark, edge_rows(18))
    for made in (mix_sources(docs), quality_verdicts(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
