"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from casetrail.session import ship

#: Texts of more characters than this are encoded in chunks of this length.
CHUNK = 1 << 16
OVERLAP = 1 << 9
#: Consecutive tokens, equal in id and place, that must agree before a boundary counts as stable.
AGREE = 8
# Words remembered by a Python worker, and characters split or encoded at a time.
MEMO = 300_000
PART = 1 << 19

# A space before a visible character always starts a piece of a byte-level pre-tokenizer.
PIECE_START = re.compile(r" (?=\S)")

Encode = Callable[[str], list[tuple[int, int, int]]]


def splice(text: str, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> list[tuple[int, int, int]]:
    """Tokens (id, start, end) of a text from overlapping chunks.

    The next chunk starts ``overlap`` characters before the end of the last. A boundary is stable
    where ``agree`` tokens in a row before it and ``agree`` after it are equal in both encodings;
    the earlier chunk is used up to there and the later one from there. Where no boundary is stable,
    the overlap is doubled, up to the whole of what has been read; a text in which nothing ever
    agrees is so encoded in one piece.
    """
    done = encode(text[:chunk])
    end = min(chunk, len(text))
    while end < len(text):
        width = overlap
        while True:
            begin = max(0, end - width)
            stop = min(len(text), end + chunk)
            fresh = [(i, s + begin, e + begin) for i, s, e in encode(text[begin:stop])]
            if begin == 0:
                done = fresh
                break
            at = stable_boundary(done, fresh, begin, agree)
            if at is not None:
                done = done[: at[0]] + fresh[at[1] :]
                break
            width *= 2
        end = stop
    return done


def stable_boundary(old: list, new: list, begin: int, agree: int) -> tuple[int, int] | None:
    """Indices in both lists of the middle of the first run of ``2 * agree`` equal tokens."""
    low = len(old)
    while low and old[low - 1][1] >= begin:
        low -= 1
    places = {token: k for k, token in enumerate(new[: 2 * (len(old) - low) + 2 * agree])}
    run, last = 0, None
    for k in range(low, len(old)):
        at = places.get(old[k])
        run = run + 1 if at is not None and last is not None and at == last + 1 else int(at is not None)
        last = at
        if run >= 2 * agree:
            return k - agree + 1, at - agree + 1
    return None


class Counter:
    """Counts tokens as the tokenizer's own library does, with no special tokens added."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_piece = False

            def encode(text: str) -> list[tuple[int, int, int]]:
                pieces = model.encode(text, return_type="proto", num_threads=1).pieces
                if text.isascii():
                    return [(p.id, p.begin, p.end) for p in pieces]
                # Places are in bytes; a character ends where its last byte does.
                place = [0]
                for k, character in enumerate(text):
                    place += [k] * (len(character.encode()) - 1) + [k + 1]
                return [(p.id, place[p.begin], place[p.end]) for p in pieces]

            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as file:
                declared = json.load(file)
            before = declared.get("pre_tokenizer") or {}
            # Pieces of such a tokenizer are encoded independently of each other.
            self.by_piece = (
                before.get("type") == "ByteLevel"
                and before.get("use_regex", True)
                and not before.get("add_prefix_space")
                and not declared.get("normalizer")
                and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in declared.get("added_tokens", []))
            )

            def encode(text: str) -> list[tuple[int, int, int]]:
                found = tokenizer.encode(text, add_special_tokens=False)
                return [(i, s, e) for i, (s, e) in zip(found.ids, found.offsets)]

            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.encode = encode

    def sizes(self, texts: list[str]) -> list[int]:
        """Tokens of texts encoded whole, a few at a time: the library's results are far larger than the texts."""
        found, begin = [], 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= PART):
                size += len(texts[end]) + 64
                end += 1
            found += self.lengths(texts[begin:end])
            begin = end
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts above the chunk length are spliced."""
        counts = [0] * len(texts)
        part: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if len(text) > self.chunk:
                counts[k] = len(splice(text, self.encode, self.chunk, self.overlap))
                continue
            part.append(k)
            size += len(text)
            if size >= PART:
                self._count_part(texts, part, counts)
                part, size = [], 0
        self._count_part(texts, part, counts)
        return counts

    def _count_part(self, texts: list[str], part: list[int], counts: list[int]) -> None:
        if not self.by_piece:
            for k, n in zip(part, self.sizes([texts[k] for k in part])):
                counts[k] = n
            return
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        # The first part of a text has no space before it; the others had one, which the split took away.
        split = [PIECE_START.split(texts[k]) for k in part]
        unknown = list(set().union(*[pieces[1:] for pieces in split]).difference(memo))
        memo.update(zip(unknown, self.sizes([f" {piece}" for piece in unknown])))
        heads = self.sizes([pieces[0] for pieces in split])
        for k, pieces, head in zip(part, split, heads):
            counts[k] = head + sum(map(memo.__getitem__, pieces[1:]))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every row's whole text, and whether the tokens exceed the limit.

    ``tokenizer`` is the path of a ``.json`` file (tokenizers) or a ``.model`` file (sentencepiece),
    present on every executor. No special tokens are added; their strings inside a text are treated
    as the library does by default. Texts above 65,536 characters are encoded in overlapping chunks.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are each counted. An empty table
    gives no rows. Only the id and text columns are read, so others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = Counter(tokenizer)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            counts = pa.array(counter.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    kind = chosen.schema["id"].dataType.simpleString()
    counted = chosen.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
