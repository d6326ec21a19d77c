"""Packing, collocations and hard negatives against brute force."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import LOWER, SCHEMA, edge_rows, frame, ordered, prose
from pyspark.sql import functions as F

from casetrail.llm import negatives, packing, phrases
from casetrail.llm.negatives import hard_negatives
from casetrail.llm.packing import OpenBins, WordIds, pack_texts
from casetrail.llm.phrases import collocations

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def cut_ids(rows, size):
    pieces = []
    for doc_id, text, *_ in rows:
        ids = library_ids(text)
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            pieces.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return pieces


def sequences_are_whole(found, size):
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(bins)


@pytest.mark.parametrize("size, open_bins, stream_rows", [(4096, 1024, 1 << 16), (64, 8, 7), (1, 1, 3)])
def test_pieces_fill_sequences(spark, size, open_bins, stream_rows):
    rows = edge_rows() if size > 1 else edge_rows()[:6]
    found = pack_texts(frame(spark, rows), PATH, size=size, open_bins=open_bins, stream_rows=stream_rows).collect()
    assert ordered(tuple(r)[:5] for r in found) == ordered(cut_ids(rows, size))
    used = sequences_are_whole(found, size)
    total = sum(r["length"] for r in found)
    assert used <= math.ceil(total / size) * 1.2 + open_bins


def test_streams_share_their_last_sequences(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(1, 40)), "en", "a") for k in range(600)]
    found = pack_texts(spark.createDataFrame(rows, SCHEMA), PATH, size=512, open_bins=16, stream_rows=20).collect()
    used = sequences_are_whole(found, 512)
    # 31 streams that shared nothing would waste half a sequence each.
    assert used <= math.ceil(sum(r["length"] for r in found) / 512) * 1.08


def test_words_are_encoded_as_the_library_encodes_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 400)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    texts = ["It's <|endoftext|> I'll go é ́x ΣΑΣ İ ﬁ", "", None, " ", "don't\tSTOP\n\n12345 ,.;!? a\x1cb", "x" * 3000, "é€😀 " * 700, "<|startoftext|>" * 90, prose(random.Random(1), 900)]
    coder = WordIds(PATH)
    assert coder.by_piece
    for data, offsets in [packing.text_bytes(pa.array(texts))]:
        for begin, end, segments in packing._parts(data, offsets):
            found = [coder.encode(*s) for s in segments]
            if len(segments) > 1:
                own = [np.concatenate([x[:-1] for x, _ in found[:-1]] + [found[-1][0]]).tolist()]
            else:
                ids, first = found[0]
                own = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
            assert own == [library_ids(t) for t in texts[begin:end]]


def test_pieces_cut_inside_words():
    rng = random.Random(4)
    signs = ["'s", "'", ",", ".", "-", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "(", "A", "é", "É", "\u0301", "7", "_", "…", "ß", "Fox", "\u00a0", "&&", "'ll", "`", "\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    coder = WordIds(PATH)
    ids, first = coder.encode(*packing.text_bytes(pa.array(texts)))
    own = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert coder.by_piece
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [[*e.ids, 1] for e in own]


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = edge_rows()[:12]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    found = pack_texts(frame(spark, rows), path, size=100).collect()
    lengths = collections.Counter()
    for r in found:
        lengths[r["doc_id"]] += r["length"]
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        expected[doc_id] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    assert lengths == expected


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(4) == (0, 6)  # the fullest that has room is now full and closed
    assert bins.place(6) == (2, 0)
    assert bins.place(9) == (3, 0)  # both bins are open: the one with 4 left closes
    assert bins.place(4) == (1, 5)
    assert bins.remaining() == [(1, 9), (3, 9)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack_texts(empty, PATH).count() == 0
    assert collocations(empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(vectors, F.col("vec_id") % 50 == 0).count() == 0


def brute_collocations(rows, support, words, top, cover):
    counts = collections.defaultdict(collections.Counter)
    totals = collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            own = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(own)
            for n in range(1, words + 1):
                counts[lang].update(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in found.items():
            score, k = min(((10**6 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= cover * a and any(q[j : j + len(p)] == p for j in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows(seed=5):
    rng = random.Random(seed)
    parts = ["the red fox", "red fox", "new  york\tcity", "New York", "of the", "the the", "a b c d", "é€ 😀", "x"]
    rows = edge_rows()
    for k in range(400):
        body = "".join(rng.choice(parts) + rng.choice([" ", " ", ". ", ",", "\n", "\t", "! ", "  "]) for _ in range(rng.randint(0, 30)))
        rows.append((k if k % 9 else None, body, rng.choice(["en", "en", "fr", None, "und"]), "a"))
    return rows


@pytest.mark.parametrize("support, words, top, shards, part", [(10, 3, 2000, 4, 1 << 22), (3, 4, 5, 2, 200), (12, 2, 50, 9, 1 << 22), (1, 3, 2000, 1, 1 << 22)])
def test_collocations(spark, monkeypatch, support, words, top, shards, part):
    monkeypatch.setattr(phrases, "PART", part)
    rows = phrase_rows()
    if support == 1:
        rows = [r for r in rows if r[1] is None or len(r[1]) < 2000]
    found = collocations(frame(spark, rows), support=support, words=words, top=top, shards=shards).collect()
    assert sorted(map(tuple, found)) == sorted(brute_collocations(rows, support, words, top, 50))


def test_local_support_loses_no_phrase(spark):
    """A phrase spread evenly over the shards just reaches the support."""
    rows = [(k, "alpha beta", "en", "a") for k in range(10)]
    found = collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in found] == [("en", 1, "alpha beta", 10, 10, 10, 20, 1_000_000)]


def test_candidates_can_reach_the_support(spark, monkeypatch):
    """Three in one shard leave two at most in each of the other three: nine, which is not counted as text."""
    sizes, rows = [], []
    for k, (text, copies) in enumerate([("lone pair", 3), ("close call", 4), ("good deal", 10)]):
        # Equal rows are in one shard.
        rows += [(k, text, "en", "a")] * copies

    def filter_of(terms, make=phrases._filter_of):
        sizes.append(terms.count())
        return make(terms)

    monkeypatch.setattr(phrases, "_filter_of", filter_of)
    found = collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["phrase"] for r in found] == ["good deal"]
    # Words, phrases of two words, and both; nothing of the lone pair.
    assert sizes == [4, 2, 6]


def test_bound_of_candidates_loses_no_phrase(spark):
    """Whatever way the support is spread over the shards, the phrase is counted."""
    ids = {}
    for row in spark.range(1000).select("id", F.pmod(F.xxhash64("id", F.lit("alpha beta")), F.lit(4)).alias("shard")).collect():
        ids.setdefault(row["shard"], []).append(row["id"])
    for spread in ((10, 0, 0, 0), (4, 2, 2, 2), (2, 2, 2, 4), (3, 3, 2, 2), (3, 3, 3, 1), (5, 5, 0, 0)):
        rows = [(k, "alpha beta", "en", "a") for shard, n in enumerate(spread) for k in ids[shard][:n]]
        found = collocations(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [tuple(r) for r in found] == [("en", 1, "alpha beta", 10, 10, 10, 20, 1_000_000)], spread


def test_levels_release_their_shuffles(spark):
    """Once phrases are counted, no shuffle file of a level is left; the result can be read twice."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        files = disk.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffle_files()
    found = collocations(frame(spark, phrase_rows()))
    for _ in range(100):
        left = shuffle_files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert found.collect() == found.collect() != []


def given_out(spark, batch, count):
    """What a worker gives out for a batch of texts."""

    class Texts:
        def mapInArrow(self, run, schema):
            self.given = list(run(iter([batch])))
            return spark.createDataFrame([], schema)

    texts = Texts()
    count(texts)
    return texts.given


def all_passing(spark):
    return spark.sparkContext.broadcast(np.full(8, 255, np.uint8))


@pytest.mark.parametrize("part, held, held_bytes", [(1 << 20, 1 << 18, 1 << 24), (500, 300, 1 << 24), (500, 1 << 18, 5000), (1, 1, 1)])
def test_workers_hold_a_bounded_number_of_phrases(spark, monkeypatch, part, held, held_bytes):
    """A batch of many distinct phrases is given out in pieces, which together have every phrase as often as it stands in it."""
    for name, value in (("PART", part), ("HELD", held), ("HELD_BYTES", held_bytes)):
        monkeypatch.setattr(phrases, name, value, raising=False)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["é€", "b", "Of", f"w{rng.randrange(10**6)}", "x.", "😀\n"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr"])) for k in range(200)]
    rows += [(None, None, "en"), (None, "", "fr"), (None, " . ", "fr")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([len(r[2]) + ord(r[2][0]) for r in rows], pa.int64()), pa.array([k % 4 for k in range(len(rows))], pa.int64())],
        ["text", "lang", "language", "shard"],
    )
    wanted = [collections.Counter() for _ in range(4)]
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            own = piece.split()
            wanted[0][lang, ""] += len(own)
            for n in (1, 2, 3):
                wanted[n].update((lang, " ".join(own[k : k + n])) for k in range(len(own) - n + 1))

    given = given_out(spark, batch, lambda texts: phrases.phrase_counts(texts, 3, all_passing(spark)))
    found = [collections.Counter() for _ in range(4)]
    for out in given:
        for lang, n, phrase, count in zip(*(c.to_pylist() for c in out.columns)):
            found[n][lang, phrase] += count
    assert [dict(f) for f in found] == [dict(w) for w in wanted]
    # Beyond what is held, a worker gives out one part: as many bytes, or one text; a word takes two bytes at least.
    words_most = max(part, 400) // 2
    assert max(out.num_rows for out in given) <= max(min(held, held_bytes) + 3 * words_most, len(rows))
    assert max(out.column("phrase").nbytes for out in given) <= held_bytes + 28 * 3 * words_most

    for n in (1, 2, 3):
        given = given_out(spark, batch, lambda texts: phrases.locally_frequent(texts, n, 10, 4, all_passing(spark) if n > 1 else None))
        assert max(out.num_rows for out in given) <= held + words_most
        counts = collections.Counter()
        for out in given:
            for term, count in zip(*(c.to_pylist() for c in out.columns)):
                counts[term] += count
        assert sum(counts.values()) == sum(wanted[n].values())


def test_texts_of_phrases_are_taken_at_once(spark, monkeypatch):
    """The result is the same however often workers give out what they hold."""
    monkeypatch.setattr(phrases, "PART", 300)
    rows = phrase_rows()
    whole = collocations(frame(spark, rows)).collect()
    monkeypatch.setattr(phrases, "HELD", 20, raising=False)
    assert collocations(frame(spark, rows)).collect() == whole != []


def test_scores_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", 0, "", 10**13), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 7 * 10**11), ("en", 2, "a b", 5 * 10**11)], "lang string, words int, phrase string, f long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "frequent_phrases", lambda *a, **k: counted)
        found = collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["score"] for r in found] == [10**6 * (5 * 10**11) ** 2 // (3 * 10**12 * 7 * 10**11)]


def brute_negatives(rows, anchors=50):
    nodes = sorted(set((math.inf if i is None else i, lab, tuple(math.floor(256 * x) for x in v), tuple(v)) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)), key=str)
    nodes = [(i, lab, q) for i, lab, q, _ in nodes]
    out = []
    for a, node in enumerate(nodes):
        if node[0] == math.inf or node[0] % anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(node[2], other[2])), other[0], other[1]) for b, other in enumerate(nodes) if b != a)
        for down, pid, _ in [s for s in scored if s[2] == node[1]][:5]:
            inside = [(n, i) for n, i, lab in scored if lab != node[1] and 50 * -down <= 100 * -n <= 95 * -down][:3]
            for rank, (n, nid) in enumerate(inside, 1):
                out.append(tuple(None if x == math.inf else x for x in (node[0], pid, rank, nid, -down, -n)))
    return out


def vector_rows(seed, n, dims=6, spread=1.0):
    rng = random.Random(seed)
    rows = [(k, [float(np.float32(rng.gauss(0.4, spread))) for _ in range(dims)], rng.randrange(3)) for k in range(n)]
    rows += [(k, rows[1][1], k % 2) for k in range(n, n + 60)]  # one common vector: ties
    rows += [(n + 100, [0.0] * dims, 0), (n + 101, [0.0] * dims, 1), (50 * n, [0.0] * dims, 0)]
    rows += [(n + 200, None, 1), (n + 201, [1.0] * dims, None), (n + 202, [float("nan")] * dims, 1), (n + 203, [float("inf")] * dims, 1), (n + 204, [None] * dims, 1)]
    rows += [(None, rows[2][1], 1), (None, rows[3][1], 0), rows[4], rows[4], (0, rows[5][1], 1), (n + 300, rows[6][1][:3], 2), (n + 301, [], 0)]
    return rows


@pytest.mark.parametrize("seed, n, spread, block", [(1, 300, 1.0, 1024), (2, 300, 0.2, 40), (3, 120, 0.05, 7)])
def test_hard_negatives(spark, monkeypatch, seed, n, spread, block):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", block)
    monkeypatch.setattr(negatives, "MOST_BLOCK", block)
    rows = vector_rows(seed, n, spread=spread)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS block", "'clash' AS uid", "'clash' AS kind", "'clash' AS id")
    found = hard_negatives(table, F.col("vec_id") % 50 == 0).collect()
    assert ordered(found) == ordered(brute_negatives(rows))
    assert len(found) > 20


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(1e6, 3e6) for _ in range(4)], k % 3) for k in range(120)]
    found = hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).collect()
    assert ordered(found) == ordered(brute_negatives(rows)) and found
