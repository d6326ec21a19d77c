"""Small tables with the cases every operator has to survive, and brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "ba ce di fo gu ha je ki lo mu né pa qu ro sa te vu wa xi yo zü".split()
LATE = 1 << 62


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n):
    return " ".join(words(rng, n))


def edge_rows(seed=1):
    """(doc_id, text, lang, source) with nulls, blanks, copies, near copies, shared passages and a very long text."""
    rng = random.Random(seed)
    passage, other = prose(rng, 60), prose(rng, 400)
    near = other.split()
    near[50], near[200] = "changed", "again"
    long = prose(rng, 30_000)
    cut = long.split()
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, "one", "en", None),
        (5, "one two three", "en", None),
        (6, "ONE two\tthree", None, None),
        (10, other, "en", "b"),
        (11, " ".join(near), "en", "b"),
        (12, other, "fr", "b"),
        (12, other, "fr", "b"),
        (13, prose(rng, 80) + " " + passage + "\n" + prose(rng, 30), "en", "b"),
        (14, passage + " " + prose(rng, 90), "en", "c"),
        (15, prose(rng, 40) + "\n" + prose(rng, 40) + " " + passage, "en", "c"),
        (16, (prose(rng, 25) + " ") * 4, "en", "c"),
        (17, long, "de", "c"),
        (18, " ".join(cut[:100] + ["inserted"] + cut[100:]), "de", "c"),
        (19, "é€😀 " * 30, "de", "c"),
        (20, "x" * 300, "de", "c"),
        (None, prose(rng, 70) + " " + passage, "de", "c"),
        (None, None, None, None),
    ]
    rows += [(100 + k, prose(rng, rng.randint(5, 200)), rng.choice(["en", "fr"]), rng.choice("abcd")) for k in range(40)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, clashing=True):
    """The rows, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if not clashing:
        return df
    names = "id chunk size taken kept key part payload component row_id members n_words target shard slot regions item __row1 extra".split()
    return df.selectExpr("*", *[f"'clash' AS {n}" for n in names], "length(text) AS n_chars")


def late(doc_id):
    return LATE if doc_id is None else doc_id


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeated_windows(rows, width):
    first = {}
    split = [(late(i), WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (i, w), row in zip(split, rows):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone[k : k + width] = [True] * width
        out.append((row[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def repeated_strings(rows, length):
    first = {}
    data = [(late(i), (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            key = b[k : k + length]
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, b), row in zip(data, rows):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((row[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """(doc_id, set size, component, kept) from all pairs; every row is a node of its own, a component its smallest id."""
    sets = [(late(i), shingle_set(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (_, a) in enumerate(sets):
        for m, (_, b) in enumerate(sets[:n]):
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = find(n), find(m)
                parent[max(x, y)] = min(x, y)
    least = collections.defaultdict(lambda: LATE)
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least[find(n)], i)
    back = lambda x: None if x == LATE else x
    return [(row[0], len(s), back(least[find(n)]), i == least[find(n)]) for n, ((i, s), row) in enumerate(zip(sets, rows))]


def shared_ids(seed=9):
    """Rows that share or lack an id, copied and clean texts mixed under each."""
    rng = random.Random(seed)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = a.split()
    near[10] = "changed"
    return [(1, a, "en", "a"), (2, a, "en", "a"), (2, c, "en", "a"), (None, a, "en", "a"), (None, b, "en", "a"), (None, d, "en", "b"), (None, d, "en", "b"), (1, a, "fr", "a"), (5, " ".join(near), "en", "a"), (5, e, "en", "a"), (6, None, "en", "a"), (6, e[:120], "en", "a")]


def language_counts(rows):
    """(doc_id, held out, tokens, known, training tokens, base score)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t, *_ in rows]
    counts = collections.Counter(w for row, own in zip(rows, tokens) if not held(row[0]) for w in own)
    n, v = sum(counts.values()), len(counts)
    score = lambda own: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
    return [(row[0], held(row[0]), len(own), sum(counts[w] > 0 for w in own), n, score(own)) for row, own in zip(rows, tokens)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))
