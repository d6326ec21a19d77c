"""Word bigram model by deleted interpolation, scored over the whole corpus.

Maximum-likelihood estimates of a bigram, a word and the uniform distribution are mixed with weights
per frequency of the context. The weights are learned by expectation-maximisation on counts from
which the occurrence at hand has been deleted, so every training token serves as held-out data.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.arrays import Words, mix, mix_one, text_bytes, within
from casetrail.llm.exchange import chunk_of, layout

#: Frequencies of contexts are bucketed by powers of two; the last bucket is open.
CONTEXT_BUCKETS = 24
#: Counts are binned for learning: exact up to 7, then by halves of a power of two.
BINS = 64
EM_ROUNDS = 60
HOLD_OUT = 10
_END = np.uint64(mix_one(0x454E44))
_START = np.uint64(mix_one(0x53544152))


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Bin of each count; 0 to 7 have one each."""
    log = np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.int64)
    return np.where(counts < 8, counts, np.minimum(8 + np.maximum(log - 6, 0), BINS - 1)).astype(np.int64)


def value_of(bins: np.ndarray) -> np.ndarray:
    """A count that stands for each bin."""
    return np.where(bins < 8, bins, 2.0 ** ((bins - 8 + 6.5) / 2))


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one bucket for each power of two."""
    return np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), CONTEXT_BUCKETS - 1), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, occurrences: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
    """Weights (uniform, word, bigram) per context bucket from binned deleted counts.

    A cell is (bigram, context, word) as one number. Buckets nothing falls into take uniform
    and word estimates in equal parts, and buckets whose context is never seen no bigram.
    """
    pair, context, word = cells // (BINS * BINS), cells // BINS % BINS, cells % BINS
    seen = value_of(context)
    p2 = np.where(context > 0, np.minimum(value_of(pair) / np.maximum(seen, 1), 1.0), 0.0)
    p1 = value_of(word) / max(n_tokens - 1, 1)
    p0 = np.full(len(cells), 1 / (n_words + 1))
    bucket = context_bucket(np.rint(seen).astype(np.int64))
    weights = np.tile([0.2, 0.3, 0.5], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.5, 0.5, 0.0]
    parts = np.stack([p0, p1, p2], axis=1)
    for _ in range(EM_ROUNDS):
        share = weights[bucket] * parts
        share *= (occurrences / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], CONTEXT_BUCKETS) for k in range(3)], axis=1)
        total = sums.sum(axis=1, keepdims=True)
        # A little of the uniform distribution always stays, so nothing has probability zero.
        weights = np.where(total > 0, np.maximum(sums / np.maximum(total, 1e-300), [1e-6, 0, 0]), weights)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


class Tokens:
    """The tokens of a chunk: lower-case words and one end for each text, with the context of each."""

    def __init__(self, table: pa.Table):
        words = Words(*text_bytes(table.column("text")))
        counts = words.counts()
        self.n_tokens = counts + 1
        first = np.cumsum(self.n_tokens) - self.n_tokens
        text = np.repeat(np.arange(len(counts)), self.n_tokens)
        self.first, self.text = first, text
        self.token = np.full(len(text), _END, np.uint64)
        self.token[np.repeat(first, counts) + within(counts)] = words.hashes(lower=True)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[first] = _START
        self.pair = mix(self.context * np.uint64(0x9E3779B97F4A7C15) + self.token)
        self.training = ~np.asarray(table.column("held_out").combine_chunks())[text].astype(bool)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words (contexts included) and pairs, and where each token's are among them."""
        words, at = np.unique(np.concatenate([self.token, [_START]]), return_inverse=True)
        pairs, pair_at = np.unique(self.pair, return_inverse=True)
        return words, at[:-1], pairs, pair_at


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers as bytes; those above 254 follow at full width."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[values >= 255].astype("<i8").tobytes()


def unpack_numbers(payload: bytes | memoryview, n: int) -> np.ndarray:
    small = np.frombuffer(payload, np.uint8, n)
    values = small.astype(np.int64)
    values[small == 255] = np.frombuffer(payload, "<i8", int((small == 255).sum()), n)
    return values


class Ranges:
    """Sorted keys cut into ``2 ** bits`` ranges, packed losslessly: range, counts per 1/65536, low six bytes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.sub = max(0, 16 - bits)

    def split(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        numbers, at = np.unique(keys >> np.uint64(64 - self.bits), return_index=True)
        bounds = [*at.tolist(), len(keys)]
        return list(zip(numbers.tolist(), bounds[:-1], bounds[1:]))

    def pack(self, keys: np.ndarray) -> bytes:
        low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        within_range = (keys >> np.uint64(48)) & np.uint64((1 << self.sub) - 1)
        counts = np.bincount(within_range.astype(np.int64), minlength=1 << self.sub).astype("<u4")
        return struct.pack("<q", len(keys)) + counts.tobytes() + low

    def unpack(self, payload: bytes) -> tuple[np.ndarray, memoryview]:
        """Keys of one range without the bits that the range has in common, and what follows them."""
        n = struct.unpack_from("<q", payload)[0]
        counts = np.frombuffer(payload, "<u4", 1 << self.sub, 8)
        at = 8 + 4 * (1 << self.sub)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(payload, np.uint8, 6 * n, at).reshape(-1, 6)
        keys = wide.view("<u8").ravel() | (np.repeat(np.arange(1 << self.sub, dtype=np.uint64), counts) << np.uint64(48))
        return keys, memoryview(payload)[at + 6 * n :]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model log10 probabilities of every row's whole text.

    Rows whose crc32 of the id as text is a multiple of 10 are held out; the model learns from all
    others. Tokens are words (runs of other than ASCII white space, A-Z in lower case) and one end.
    Chunks of rows send their distinct words and pairs with their counts by range of hash; ranges
    add them up and answer. Counts cover all training rows; nothing is pruned.

    Null texts are empty: one end. A null id counts as the empty text, so it is held out. Repeated
    rows are each counted and scored. Without training rows every weight is on the uniform
    distribution. An empty table gives no rows. Only the id and text columns are read.

    Result: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.
    """
    sizes = layout(docs, text_col)
    ranges = Ranges(max(3, (sizes.n_bytes // 5 // 1_000_000).bit_length()))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        chunk_of(F.col(id_col), sizes.n_chunks).alias("chunk"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        (F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(HOLD_OUT)) == 0).alias("held_out"),
    ).repartition("chunk")
    by_chunk = source.groupBy("chunk")
    pair_part = 1 << ranges.bits

    def request(table: pa.Table) -> pa.Table:
        tokens = Tokens(table)
        words, at, pairs, pair_at = tokens.keys()
        counted = np.bincount(at[tokens.training], minlength=len(words))
        # Texts begin in the start context as often as there are texts.
        counted[np.searchsorted(words, _START)] = int(tokens.training[tokens.first].sum())
        pair_counts = np.bincount(pair_at[tokens.training], minlength=len(pairs))
        rows = [(part, ranges.pack(words[b:e]) + pack_numbers(counted[b:e])) for part, b, e in ranges.split(words)]
        rows += [(pair_part + part, ranges.pack(pairs[b:e]) + pack_numbers(pair_counts[b:e])) for part, b, e in ranges.split(pairs)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table(
            {"part": pa.array([p for p, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())}
        )

    def add_up(table: pa.Table) -> pa.Table:
        """Totals for each chunk's keys, preceded by what this range adds to N and V, on one of the answers."""
        part = table.column("part")[0].as_py()
        keys, counts = [], []
        for payload in table.column("payload").to_pylist():
            own, rest = ranges.unpack(payload)
            keys.append(own)
            counts.append(unpack_numbers(rest, len(own)))
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
        answers = [pack_numbers(totals[x]) for x in np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])]
        n = v = 0
        if part < pair_part:
            start = _START & np.uint64((1 << (64 - ranges.bits)) - 1) if int(_START) >> (64 - ranges.bits) == part else None
            real = totals if start is None else totals[distinct != start]
            n, v = int(real.sum()), int((real > 0).sum())
        extra = [(n, v)] + [(0, 0)] * (len(answers) - 1)
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "part": table.column("part"),
                "tokens": pa.array([x for x, _ in extra], pa.int64()),
                "words": pa.array([x for _, x in extra], pa.int64()),
                "payload": pa.array(answers, pa.binary()),
            }
        )

    def counts_of(table: pa.Table, answers: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with their own, their context's and their pair's counts in all training rows."""
        tokens = Tokens(table)
        words, at, pairs, pair_at = tokens.keys()
        found = dict(zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist()))
        word_counts = np.concatenate([unpack_numbers(found[part], e - b) for part, b, e in ranges.split(words)])
        pair_counts = np.concatenate([unpack_numbers(found[pair_part + part], e - b) for part, b, e in ranges.split(pairs)])
        own = word_counts[at]
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[tokens.first] = word_counts[np.searchsorted(words, _START)]
        return tokens, own, context, pair_counts[pair_at]

    def deleted_counts(table: pa.Table, answers: pa.Table) -> pa.Table:
        """How often each cell of binned counts, less the occurrence itself, occurs in training rows."""
        tokens, own, context, pair = counts_of(table, answers)
        own, context, pair = (x[tokens.training] - 1 for x in (own, context, pair))
        cells, n = np.unique((bin_of(pair) * BINS + bin_of(context)) * BINS + bin_of(own), return_counts=True)
        stats = [pa.compute.sum(answers.column(c)).as_py() or 0 for c in ("tokens", "words")]
        return pa.table({"cell": pa.array([*cells.tolist(), -1, -2], pa.int64()), "n": pa.array([*n.tolist(), *stats], pa.int64())})

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell")
        n_tokens, n_words = (int(frame.loc[frame["cell"] == k, "n"].sum()) for k in (-1, -2))
        cells = frame[frame["cell"] >= 0]
        weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), n_tokens, n_words)
        return pd.DataFrame({"model": [struct.pack("<qq", n_tokens, n_words) + weights.astype("<f8").tobytes()]})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, own, context, pair = counts_of(table, answers)
        model = answers.column("model")[0].as_py()
        n, v = struct.unpack_from("<qq", model)
        weights = np.frombuffer(model, "<f8", offset=16).reshape(-1, 3)[context_bucket(context)]
        base = np.log10((own + 0.1) / (n + 0.1 * (v + 1)))
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        mixed = np.log10(weights[:, 0] / (v + 1) + weights[:, 1] * own / max(n, 1) + weights[:, 2] * p2)
        per_text = lambda x: np.add.reduceat(x, tokens.first)
        return pa.table(
            {
                "id": table.column("id"),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(tokens.n_tokens, pa.int64()),
                "n_known": pa.array(per_text((own > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(table), n), pa.int64()),
                "base_score": pa.array(per_text(base), pa.float64()),
                "score": pa.array(per_text(mixed), pa.float64()),
            }
        )

    requests = by_chunk.applyInArrow(request, "part int, chunk int, payload binary")
    answers = requests.groupBy("part").applyInArrow(add_up, "chunk int, part int, tokens long, words long, payload binary").repartition("chunk")
    cells = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(deleted_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # At most BINS ** 3 cells, however large the corpus; one row of weights comes out.
    model = cells.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "model binary")
    informed = answers.withColumn("model", model.scalar())
    done = by_chunk.cogroup(informed.groupBy("chunk")).applyInArrow(
        score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return done.withColumnRenamed("id", id_col)
