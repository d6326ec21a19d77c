"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm.arrays import Words, mix, span_hashes, text_bytes
from casetrail.llm.common import cut, release_shuffles
from casetrail.llm.components import connected_components, merge_components
from casetrail.session import ship

SHINGLE = 5
#: Links have ``100 * intersection >= PERCENT * union``.
PERCENT = 75
# 128 samples in 32 bands of 4: a pair at 0.75 shares no band with probability 5e-6, at 0.8 with 5e-8.
BANDS, BAND_ROWS = 32, 4
SAMPLES = BANDS * BAND_ROWS
#: Bits of an odd sketch, in words of 64.
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: Links are confirmed from this estimate on; over five standard deviations below 0.75.
LEAST_ESTIMATE = 0.5
#: Members of a bucket compared in one group at a time.
BLOCK = 128
#: Rounds in which each bucket is compared with one head only, before whole buckets are.
HEAD_ROUNDS = 1
_LAST = np.iinfo(np.int64).max

_rng = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = (_rng.integers(1, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin.

    A text of fewer words than ``width`` has its whole word sequence as one shingle; a blank one none.
    """
    words = Words(data, offsets)
    counts = words.counts()
    per_text = np.where(counts >= width, counts - (width - 1), np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), per_text)
    first = np.cumsum(per_text) - per_text
    starts = np.repeat(words.first[:-1], per_text) + np.arange(len(text)) - first[text]
    ends = np.minimum(starts + width, words.first[1:][text])
    hashes = span_hashes(mix(words.hashes(lower=True)), starts, ends, 1)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def minhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima per text (uint32); every text must have a shingle."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.empty((len(starts), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        found[:, k] = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], starts)
    return found


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, row::BAND_ROWS].astype(np.uint64))
    return keys.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Fold the (number, value) samples of a text into a bitmap by parity."""
    numbered = mix((np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) + samples.astype(np.uint64))
    bit = numbered % np.uint64(SKETCH_BITS)
    sketch = np.zeros((len(samples), SKETCH_WORDS), np.uint64)
    rows = np.arange(len(samples))
    for k in range(SAMPLES):
        sketch[rows, (bit[:, k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit[:, k] & np.uint64(63))
    return sketch.view(np.int64)


def estimated_similarity(odd: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the number of bits in which two sketches differ."""
    inside = np.maximum(1 - 2 * np.asarray(odd, float) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / 2 * np.log(inside) / (2 * SAMPLES)


#: Sketches of linked texts differ in at most this many bits.
MOST_ODD = int(max(x for x in range(SKETCH_BITS // 2) if estimated_similarity(x) >= LEAST_ESTIMATE))

_SIGNATURE = "id long, row_id {kind}, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, odd array<long>"


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of about a megabyte: first and last row, their bytes and offsets."""
    data, offsets = text_bytes(batch.column(name))
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (1 << 20), side="right")) - 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)), pa.array(values.ravel(), pa.int64()))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: set size, a 128-bit hash of the set, band keys and odd sketch (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in _texts(batch, "text"):
                hashes, first = shingles(data, offsets)
                sizes = np.diff(first)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))])
                other = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)))])
                some = np.flatnonzero(sizes)
                samples = minhashes(hashes, first[some]) if len(some) else np.zeros((0, SAMPLES), np.uint32)
                place = np.full(len(sizes), -1)
                place[some] = np.arange(len(some))
                at = pa.array(place, pa.int64(), mask=place < 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(begin, end - begin),
                        batch.column("row_id").slice(begin, end - begin),
                        batch.column("text_hash").slice(begin, end - begin),
                        pa.array(sizes, pa.int64()),
                        pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)),
                        pa.array((other[first[1:]] - other[first[:-1]]).view(np.int64)),
                        _lists(band_keys(samples)).take(at),
                        _lists(odd_sketches(samples)).take(at),
                    ],
                    ["id", "row_id", "text_hash", "n_shingles", "s1", "s2", "bands", "odd"],
                )

    chosen = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    return chosen.mapInArrow(run, _SIGNATURE.format(kind=chosen.schema["row_id"].dataType.simpleString()))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(``node``, ``members``): 48 bits of each shingle hash, sorted, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in _texts(batch, "text"):
                hashes, first = shingles(data, offsets)
                packed = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    packed.append((hashes[a:b] >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(begin, end - begin), pa.array(packed, pa.binary())], ["node", "members"])

    return texts.mapInArrow(run, "node long, members binary")


def read_set(members: bytes) -> np.ndarray:
    raw = np.frombuffer(members, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of distinct values reach the similarity."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirm(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that are links: sizes and odd sketches first, then the full sets."""
    of_a = sketches.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("odd").alias("odd_a"))
    of_b = sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("odd").alias("odd_b"))
    likely = pairs.join(of_b, "b").join(of_a, "a").where(
        (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (differing_bits(F.col("odd_a"), F.col("odd_b")) <= MOST_ODD)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wide = None, None
        for batch in batches:
            flags = []
            for x, y in zip(*(batch.column(k).to_pylist() for k in ("members_a", "members_b"))):
                if x != last:
                    last, wide = x, read_set(x)
                flags.append(linked(wide, read_set(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(flags, pa.bool_()))

    with_sets = (
        likely.select("a", "b")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("members_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("members").alias("members_a")), "a")
    )
    return with_sets.mapInArrow(run, "a long, b long")


def link_across(table: pa.Table) -> pa.Table:
    """Links between components among the members of one pair of blocks; one for each two components joined.

    ``side`` 0 and 1 are two blocks whose members are compared with each other, 2 is one block.
    """
    comp = np.asarray(table.column("component"))
    side = np.asarray(table.column("side"))
    ids = np.asarray(table.column("id"))
    odd = np.array(table.column("odd").to_pylist(), np.int64).reshape(-1, SKETCH_WORDS).view(np.uint64)
    members = table.column("members")
    sets: dict[int, np.ndarray] = {}
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = read_set(members[k].as_py())
        return sets[k]

    found = []
    for i in np.flatnonzero(side != 1).tolist():
        others = np.flatnonzero((comp != comp[i]) & ((side == 1) if side[i] == 0 else (np.arange(len(ids)) > i)))
        bits = np.bitwise_count(odd[others] ^ odd[i]).sum(axis=1)
        for j in others[np.argsort(bits, kind="stable")][: int((bits <= MOST_ODD).sum())].tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y and linked(set_of(i), set_of(j)):
                root[max(x, y)] = min(x, y)
                found.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row under links of at least 0.75 Jaccard similarity of word shingles.

    Words are runs of other than ASCII white space, with A-Z in lower case; a set has the distinct
    shingles of five words. Rows with equal sets are one node. Nodes that share a MinHash band
    are candidates. First each bucket's members are compared with its smallest id, whose links
    join most of them; then members of one bucket that are still in different components are compared
    with each other, in blocks. So a bucket of any size is worked through completely, and members
    already known to belong together are not compared again. Sizes and odd sketches exclude pairs
    before the full sets confirm them.

    Null and blank texts have empty sets and are linked with nothing. A null id comes after all
    others and null stays its own id. Rows that share or lack an id are documents of their own, linked only by their texts. An empty
    table gives no rows. Only the id (an integer) and text columns are read.

    Result: id, ``n_shingles``, ``component_id``, ``kept`` (the row's id is its component's), ``first`` (of the rows of its component
    the one to stay: the smallest id, then the smallest hash of the text; rows equal in both are all marked),
    ``text_hash`` (``xxhash64`` of the text).
    """
    release_shuffles(docs.sparkSession)
    ship(docs.sparkSession)
    # Numbers of rows are given to what the checkpoint holds, so they stay the same whatever is computed again.
    rows = cut(signatures(docs, id_col, text_col)).withColumn("row", F.monotonically_increasing_id())
    nodes = rows.where("n_shingles > 0")
    # Rows with equal sets: one row stands for all; hot sets are aggregated before the join.
    classes = nodes.groupBy("s1", "s2").agg(
        F.min("row").alias("node"), F.min_by("id", "row").alias("node_id"), F.min_by("text_hash", "row").alias("node_hash"), F.min(F.struct("id", "text_hash")).alias("first_row")
    )
    classes = cut(classes)

    keyed = nodes.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n_shingles", "odd", "bands")
    banded = keyed.select("id", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(banded.join(heads, "key").select("key", "id", "head"))
    pairs = members.where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()

    in_buckets = members.select("id").distinct()
    sketches = cut(keyed.select("id", "n_shingles", "odd").join(in_buckets, "id", "left_semi"))
    # A node's text is that of any row with its id and text hash.
    wanted = classes.select(F.col("node").alias("id"), "node_id", "node_hash").join(in_buckets, "id", "left_semi")
    wanted = wanted.withColumnRenamed("id", "node").dropDuplicates(["node_id", "node_hash"])
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("node_id"), F.xxhash64(text_col).alias("node_hash"), F.col(text_col).alias("text")
    ).join(wanted, ["node_id", "node_hash"])
    sets = cut(shingle_sets(texts).dropDuplicates(["node"]).withColumnRenamed("node", "id"))

    done = connected_components(confirm(pairs, sketches, sets))
    rounds = 0
    while True:
        located = members.select("key", "id").join(done, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        torn = located.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most")
        open_rows = cut(located.join(torn, "key"))
        if open_rows.isEmpty():
            break
        if rounds < HEAD_ROUNDS:
            # Another head: the smallest id outside the bucket's first component, against that component's members,
            # and a member of that component, found by hash, against all outside it.
            order = F.xxhash64(F.lit(rounds), "id")
            chosen = open_rows.groupBy("key").agg(
                F.min_by(F.when(F.col("component") == F.col("least"), F.col("id")), F.when(F.col("component") == F.col("least"), order)).alias("inside"),
                F.min_by(F.when(F.col("component") != F.col("least"), F.col("id")), F.when(F.col("component") != F.col("least"), order)).alias("outside"),
            )
            against = open_rows.join(chosen, "key").select(
                F.when(F.col("component") == F.col("least"), F.col("outside")).otherwise(F.col("inside")).alias("a"), F.col("id").alias("b")
            )
            more = confirm(against.distinct(), sketches, sets)
        else:
            more = cross_links(open_rows, sketches, sets)
        more = cut(more)
        final = rounds >= HEAD_ROUNDS
        rounds += 1
        if not more.isEmpty():
            done = merge_components(done, more)
        if final:
            break
    # The row that stays, per component: an aggregate over classes, each of which has told its smallest row.
    owned = classes.select("s1", "s2", "node", "first_row").join(done.select(F.col("id").alias("node"), "component"), "node", "left")
    owned = owned.select("s1", "s2", "first_row", F.coalesce("component", "node").alias("component"))
    least = owned.groupBy("component").agg(F.min("first_row").alias("least"))
    of_class = owned.join(least, "component").select("s1", "s2", "least")
    labelled = rows.select("id", "row_id", "text_hash", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("least.id")).otherwise(F.col("id"))
    return labelled.select(
        F.col("row_id").alias(id_col), "n_shingles", F.when(own != _LAST, own).alias("component_id"), (F.col("id") == own).alias("kept"),
        ((F.col("n_shingles") == 0) | (F.struct("id", "text_hash") == F.col("least"))).alias("first"), "text_hash",
    )


def cross_links(open_rows: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of one bucket, every pair of members considered.

    The members of the largest component meet all others in blocks; the others meet each other
    in pairs of blocks. No group holds more than two blocks.
    """
    sizes = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    placed = (
        open_rows.select("key", "id", "component")
        .join(major, "key")
        .withColumn("major_blocks", blocks(F.col("n_major")))
        .withColumn("minor_blocks", blocks(F.col("n_all") - F.col("n_major")))
        .withColumn("hash", F.xxhash64("id"))
    )
    inside = F.col("component") == F.col("major")
    mine = F.pmod("hash", F.col("minor_blocks")).cast("int")
    majors = placed.where(inside).select(
        "key", "id", "component", F.lit("major").alias("kind"), F.pmod("hash", F.col("major_blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("j"), F.lit(1).alias("side"),
    )
    minors = placed.where(~inside).withColumn("mine", mine)
    against_major = minors.select(
        "key", "id", "component", F.lit("major").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("major_blocks") - 1)).alias("i"),
        F.col("mine").alias("j"), F.lit(0).alias("side"),
    )
    among = minors.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1))).select(
        "key", "id", "component", F.lit("minor").alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    rows = majors.unionByName(against_major).unionByName(among)
    loaded = rows.join(sketches.select("id", "odd"), "id").join(sets, "id")
    return loaded.groupBy("key", "kind", "i", "j").applyInArrow(link_across, "a long, b long").distinct()
