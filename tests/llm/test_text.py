"""Decontamination, personal data, language model, token counts and the pipeline."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from cases import SCHEMA, WORD, components, edge_rows, frame, language_counts, ordered, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from casetrail.llm import decontamination, pii, tokens
from casetrail.llm.decontamination import banded_distances, contaminated_regions, contamination
from casetrail.llm.language_model import Ranges, learn_weights, pack_numbers, score_texts, unpack_numbers
from casetrail.llm.pii import base_spans, personal_data, sanitised
from casetrail.llm.queries import tokenizer_path
from casetrail.llm.tokens import count_tokens, splice

ITEMS = "item_id long, text string"


def edit_distance_inside(piece, text):
    """Least edit distance of the piece to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def folded(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return decontamination.fold(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def contaminated(rows, items):
    """(doc_id, item) by comparing every piece with every text."""
    out = set()
    for doc_id, text, *_ in rows:
        data = folded(text)
        for item, passage in items:
            body = folded(passage)
            last = max(len(body) - decontamination.PIECE, 0)
            for at in {*range(0, last, decontamination.STRIDE), last}:
                piece = body[at : at + decontamination.PIECE]
                if len(piece) >= 8 and edit_distance_inside(piece, data) <= int(len(piece) * decontamination.BUDGET):
                    out.add((doc_id, item))
    return out


def benchmark_case():
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(20, 45))) for k in range(8)] + [(50, None), (51, ""), (52, "tiny"), (0, "")]
    items.append(items[3])
    rows = [r for r in edge_rows(21) if len(r[1] or "") < 3000]
    edited = list(items[2][1])
    for at in (9, 40, 77):
        edited[at] = "#q"
    rows += [
        (500, prose(rng, 30) + " " + items[1][1] + " " + prose(rng, 20), "en", "a"),
        (501, items[2][1].upper().replace(" ", " -- "), "en", "a"),
        (502, prose(rng, 10) + " " + "".join(edited) + " " + prose(rng, 10), "en", "a"),
        (503, prose(rng, 5) + items[4][1][:190] + prose(rng, 40), "en", "a"),
        (504, items[5][1] + " " + items[6][1], "en", "a"),
        (505, items[7][1][:60] + " " + prose(rng, 60), "en", "a"),
    ]
    return rows, items


def test_contamination_matches_brute_force(spark):
    rows, items = benchmark_case()
    got = contamination(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], int(i)) for r in got for i in r["items"].split(",") if i}
    assert found == contaminated(rows, items)
    assert {500, 501, 502, 504} <= {d for d, _ in found} and 505 not in {d for d, _ in found}
    assert all(r["kept"] != r["contaminated"] for r in got)


def test_regions_point_at_the_passage(spark):
    rows, items = benchmark_case()
    got = contaminated_regions(frame(spark, rows), spark.createDataFrame(items, ITEMS)).where("doc_id = 500").collect()[0]
    data = got["kept"]["text"].encode()
    low, high = min(r["start"] for r in got["regions"]), max(r["end"] for r in got["regions"])
    assert folded(data[low:high].decode()) == folded(items[1][1])


def test_benchmark_in_blocks(spark, monkeypatch):
    rows, items = benchmark_case()
    bench = spark.createDataFrame(items, ITEMS)
    want = ordered(contamination(frame(spark, rows), bench).select("doc_id", "items").collect())
    blocks = decontamination.benchmark_blocks
    monkeypatch.setattr(decontamination, "benchmark_blocks", lambda b, i, t: blocks(b, i, t, 300))
    assert ordered(contamination(frame(spark, rows), bench).select("doc_id", "items").collect()) == want


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(22)
    for _ in range(60):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(8, 30)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        wide = len(piece) + len(text) + 2
        padded = b"\xff" * len(piece) + text
        got, _ = banded_distances([np.frombuffer(piece, np.uint8)], [np.frombuffer(padded, np.uint8)], [wide])
        assert got[0] == edit_distance_inside(piece, padded)


def patterns(text):
    """The base kinds by their definitions, with no shortcut."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1.@-+ 0945()é²%", max_size=60))
def test_base_patterns(text):
    assert base_spans(text) == patterns(text)


def test_base_patterns_of_long_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        assert isinstance(base_spans(text), list)
    assert base_spans("call +1 (377) 555-0271, card 4111 1111 1111 1111, a.b@c.de.") == patterns("call +1 (377) 555-0271, card 4111 1111 1111 1111, a.b@c.de.")


def private_rows():
    rng = random.Random(23)
    rows = [r for r in edge_rows(23)]
    for k in range(6):
        rows.append((600 + k, f"{prose(rng, 9)} doctor zaphod writes {prose(rng, 3)} z@mail.org {prose(rng, 9)}", "en", "a"))
    rows.append((700, "the doctor came", "en", "a"))
    rows += [(710 + k, f"{prose(rng, 9)} the doctor {prose(rng, 9)}", "en", "a") for k in range(30)]
    rows.append((701, "ip 10.0.0.300 and 10.0.0.30, card 4111111111111111 é +49 30 1234567", "en", "a"))
    return rows


def test_personal_data(spark):
    rows = private_rows()
    got = {r["doc_id"]: r for r in personal_data(frame(spark, rows)).collect() if r["doc_id"] is not None}
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        spans = patterns(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == n for x in spans) for n in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    # "zaphod" and "writes" stand beside the address alone; "doctor" is common without it.
    terms = {text[f["start"] : f["end"]] for i, text, *_ in rows if i and 600 <= i < 700 for f in got[i]["found"] if f["kind"] == "term"}
    assert terms == {"zaphod", "writes"} and got[701]["n_ip"] == 1 and not got[700]["found"]


def rare_rows(n=400):
    """Plain rows of two common words each, and names beside a value that stands once or twice."""
    rng = random.Random(29)
    rows = [(k, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(12)), "en", "a") for k in range(n)]
    rows += [(5000, "alpha beta quillon wrote from q@mail.org beta", "en", "a"), (5001, "gamma quillon wrote from q@mail.org delta", "en", "a")]
    return rows + [(5002, "alpha beta tre\u0301moux 10.1.2.3 gamma", "en", "a")]


def test_values_seen_once_or_twice_are_judged(spark):
    rows = rare_rows()
    texts = {r[0]: r[1] for r in rows}
    got = personal_data(frame(spark, rows)).collect()
    marked = {(r["doc_id"], texts[r["doc_id"]][f["start"] : f["end"]]) for r in got for f in r["found"] if f["kind"] == "term"}
    # A letter with a combining mark is one term on both sides, and the common words tell nothing.
    assert marked == {(i, w) for i in (5000, 5001) for w in ("quillon", "wrote", "from")} | {(5002, "tre\u0301moux")}


def test_a_disclosing_term_is_marked_wherever_it_stands(spark):
    rng = random.Random(30)
    plain = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(n))
    rows = [(k, plain(12), "en", "a") for k in range(400)]
    # The name stands a hundred terms from the value, twice, and once where the value is not.
    rows += [(k, f"quillon {plain(100)} q@mail.org {plain(100)} Quillon", "en", "a") for k in range(5000, 5006)]
    rows.append((5006, f"{plain(30)} quillon {plain(3)}", "en", "a"))
    got = {r["doc_id"]: [(f["start"], f["end"]) for f in r["found"] if f["kind"] == "term"] for r in personal_data(frame(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        assert got[doc_id] == [m.span() for m in re.finditer("(?i)quillon", text)]
    assert "uillon" not in "".join(r["text"] for r in sanitised(frame(spark, rows)).collect())


def test_sanitised_texts(spark):
    rows = [r for r in private_rows() if r[0] is not None and r[0] not in (12,)]
    got = {r["doc_id"]: r["text"] for r in sanitised(frame(spark, rows)).collect()}
    assert "z@mail.org" not in got[600] and "zaphod" not in got[600] and "<email>" in got[600] and "doctor" in got[600]
    assert got[701] == "ip 10.0.0.300 and <ip>, card <card> é <phone>" and got[1] is None


def test_language_model_base_scores(spark):
    rows = edge_rows(24)
    got = ordered(score_texts(frame(spark, rows)).drop("score").collect())
    want = ordered(language_counts(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want))


def test_bigrams_predict_held_out_text_better(spark):
    rng = random.Random(25)
    vocabulary = [prose(rng, 1) for _ in range(60)]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}
    rows = []
    for k in range(300):
        text = [rng.choice(vocabulary)]
        while len(text) < 40:
            text.append(rng.choice(follow[text[-1]]))
        rows.append((k, " ".join(text), "en", "a"))
    held = score_texts(frame(spark, rows)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert held["s"] > 0.6 * held["b"]


def test_model_is_a_distribution():
    rng = np.random.default_rng(26)
    weights = learn_weights(rng.integers(0, 64**3, 500), rng.integers(1, 50, 500).astype(float), 10_000, 900)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 0] > 0).all() and weights[0, 2] == 0
    assert np.allclose(learn_weights(np.zeros(0, np.int64), np.zeros(0), 0, 0).sum(axis=1), 1)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50, unique=True), st.integers(3, 20))
@settings(max_examples=200, deadline=None)
def test_ranges_are_lossless(keys, bits):
    ranges, keys = Ranges(bits), np.array(sorted(keys), np.uint64)
    for part, begin, end in ranges.split(keys):
        own, rest = ranges.unpack(ranges.pack(keys[begin:end]) + b"rest")
        assert bytes(rest) == b"rest"
        assert ((own & np.uint64((1 << (64 - bits)) - 1)) + (np.uint64(part) << np.uint64(64 - bits)) == keys[begin:end]).all()


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**60)), max_size=40))
def test_packed_numbers(values):
    assert unpack_numbers(pack_numbers(np.array(values, np.int64)), len(values)).tolist() == values


needs_tokenizers = pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no vocabulary files")
ODD_TEXTS = [
    "", " ", "a", "  two  spaces ", "end \n next\n\n  x", "<|endoftext|> and a <|endoftext|>b", "it's we'll I'D", "tab\t x   y z\x1c q",
    "é€😀 ñandú 12 345", "x" * 500, "a\r\n b", "\u0085 next",
]


@needs_tokenizers
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_match_the_library(spark, name):
    rows = edge_rows(27) + [(800 + k, t, "en", "a") for k, t in enumerate(ODD_TEXTS)]
    path = tokenizer_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t, *_ in rows]
    assert ordered(count_tokens(frame(spark, rows), path).collect()) == ordered(want)


@needs_tokenizers
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_spliced_chunks_equal_the_whole(name):
    rng = random.Random(28)
    counter = tokens.Counter(tokenizer_path(name))
    texts = [prose(rng, 400), "ab" * 1500, "x" * 3000, " " * 2000 + "y", "\n".join(prose(rng, 5) for _ in range(80)), "😀é" * 400]
    for text in texts:
        whole = counter.encode(text)
        assert splice(text, counter.encode, 300, 40, 4) == whole


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert contamination(empty, spark.createDataFrame([], ITEMS)).isEmpty()
    assert personal_data(empty).isEmpty() and score_texts(empty).isEmpty()
    assert count_tokens(empty, tokenizer_path()).isEmpty()


def test_no_benchmark_keeps_everything(spark):
    rows = edge_rows(29)
    got = contamination(frame(spark, rows), spark.createDataFrame([], ITEMS)).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, items = benchmark_case()
    rows += [(900, " ".join(w + "###" for w in prose(random.Random(30), 50).split()), "en", "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
        if name != "sharding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean, distinct, safe, mixed, shards = seen
    assert {r["doc_id"] for r in clean} <= {i for i, t, *_ in rows if len(WORD.findall(t or "")) >= 20} - {900}
    assert {500, 502, 504} <= {r["doc_id"] for r in clean}
    kept = {i for i, _, _, k in components([(r["doc_id"], r["text"]) for r in clean]) if k}
    assert {r["doc_id"] for r in distinct} == kept
    dirty = {i for i, _ in contaminated([(r["doc_id"], r["text"]) for r in distinct], items)}
    assert {r["doc_id"] for r in safe} == kept - dirty and dirty
    n_words = lambda found: sum(len(WORD.findall(r["text"])) for r in found)
    assert abs(n_words(mixed) - 1.5 * n_words(safe)) <= len({r["source"] for r in safe})
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in mixed) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in shards)
    assert ordered((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ordered(
        (r["doc_id"], r["shard"], r["slot"]) for r in shards
    )


@pytest.mark.parametrize("length", [95, 117, 150, 233, 500])
def test_runs_of_an_item_are_found_at_all_places(length):
    """Every verbatim run of 95 bytes, at every place of items of several lengths; of halves, too."""
    rng = random.Random(31)
    shortest = decontamination.PIECE + decontamination.STRIDE - 1
    item = "".join(rng.choice("abcdefghij") for _ in range(length))
    index = decontamination.Index.build([(1, item)])
    for size in {shortest, max(shortest, length // 2)}:
        for at in range(0, length - size + 1):
            text = "".join(rng.choice("klmnopq ") for _ in range(50)) + item[at : at + size] + " klm" * 9
            data = np.frombuffer(text.encode(), np.uint8)
            assert index.regions(data, np.array([0, len(data)])), (length, size, at)


def test_runs_of_one_letter_are_gone_through_in_windows(monkeypatch):
    index = decontamination.Index.build([(1, "x" * 300), (2, "x" * 300)])
    # Equal pieces are one.
    assert len(index.pieces) == 1 and index.items == [[1, 2]]
    data = np.full(20_000, ord("x"), np.uint8)
    held = []
    bands = decontamination.Index.bands
    monkeypatch.setattr(decontamination.Index, "bands", lambda self, at, number: (held.append(len(at) * 73), bands(self, at, number))[1])
    monkeypatch.setattr(decontamination, "MOST_HITS", 50_000)
    found = index.regions(data, np.array([0, 9_000, 20_000]))
    assert max(held) <= 50_000 and len(held) > 20
    assert sorted(t for t, *_ in found) == [0, 1] and all(d == 0 for *_, d in found)
    held.clear()
    # The same without windows.
    monkeypatch.setattr(decontamination, "MOST_HITS", 1 << 40)
    assert index.regions(data, np.array([0, 9_000, 20_000])) == found and len(held) == 1


def test_windows_leave_out_nothing(monkeypatch):
    rng = random.Random(32)
    items = [(k, prose(rng, 40)) for k in range(30)]
    index = decontamination.Index.build(items)
    text = " ".join(" ".join(w for w in t.split() if rng.random() > 0.03) + " " + prose(rng, 60) for _, t in items)
    raw = np.frombuffer(text.encode(), np.uint8)
    data, offsets, _ = decontamination.fold(raw, np.array([0, len(raw) // 2, len(raw)]))
    whole = index.regions(data, offsets)
    for most in (1, 100, 1000):
        monkeypatch.setattr(decontamination, "MOST_HITS", most)
        assert index.regions(data, offsets) == whole
    assert len({index.items[k][0] for _, k, *_ in whole}) > 20


def test_very_long_runs_of_digits_are_no_address():
    from casetrail.llm.pii import base_spans

    for text, ip in (("0" * 5000 + ".1.2.3", True), ("9" * 5000 + ".1.2.3", False), ("1.2.3." + "0" * 9000, True), ("0" * 4400 + "255.1.2.3", True), ("0" * 4400 + "256.1.2.3", False), ("1" * 10_000, False)):
        assert [(s, e) for s, k, e in base_spans(text) if k == 1] == ([(0, len(text))] if ip else [])
