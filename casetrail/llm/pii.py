"""Personal data: fixed patterns, and terms that disclose a protected value through co-occurrence."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm.common import cut
from casetrail.session import ship

# Fixed patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from all others, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _letters(first: int, end: int) -> str:
    """The letters and combining marks of a range of code points, as ranges of a character class."""
    codes = [c for c in range(first, end) if unicodedata.category(chr(c))[0] in "LM"]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0])]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


# The one definition of a term, three letters or marks, for documents and vocabulary alike. Python looks
# up classes in a table only below U+10000, so the rest is left out where a text does not need it.
_TERM, _TERM_BMP = (re.compile(f"[{_letters(0, end)}]{{3,}}") for end in (0x110000, 0x10000))


def pattern_of(text: str) -> re.Pattern:
    return _TERM_BMP if text.isascii() or max(text) < "\U00010000" else _TERM


#: Documents without any link of term and value that are added to those seen, so that a few meetings by chance tell less.
PRIOR = 4
#: Bits of the filter of disclosing terms: so many a term, and no more than so many in all.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27
#: Bits set for a term.
PROBES = 4
#: Words whose numbers a worker remembers.
REMEMBERED = 1 << 19
#: Shares of the value's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.7, 0.9


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` so that long runs cost no more than their length."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and at > last:
            begin = at
            while begin > last and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
                begin -= 1
            if begin < at:
                found.append((begin, domain.end()))
                last = domain.end()
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, in code points."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (group.lstrip("0.") for group in m.groups())):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_PLACES = pa.struct([("term", pa.int64()), ("at", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def terms_in(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms that no base match touches; ``spans`` are sorted by start."""
    at, reached = 0, 0
    for m in pattern_of(text).finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][0] < end:
            reached = max(reached, spans[at][2])
            at += 1
        if start >= reached:
            yield m.group(), start, end


def distinct_terms(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    words = {w for w, _, _ in terms_in(text, spans)} if spans else set(pattern_of(text).findall(text))
    return {w.lower() for w in words}


def number_of(term: str) -> int:
    """A term as 64 bits, by which it is counted and joined."""
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


class Numbers(dict):
    """Numbers of the terms met; forgotten when there are too many."""

    def __missing__(self, term: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[term] = number = number_of(term)
        return number


def protected(docs: DataFrame, text_col: str) -> DataFrame:
    """``values`` and ``terms``, each distinct, of the rows that show a protected value; a value is a digest of the match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            values, terms = [], []
            for text in batch.column(0).to_pylist():
                own = base_spans(text) if text else []
                if own:
                    shown = {f"{kind}:{text[start:end]}" for start, kind, end in own}
                    values.append([hashlib.blake2b(v.encode(), digest_size=12).hexdigest() for v in sorted(shown)])
                    terms.append([numbers[t] for t in distinct_terms(text, own)])
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.int64()))], ["values", "terms"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "values array<string>, terms array<long>")


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """(``term``, ``df_term``): how many rows have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update([numbers[t] for t in distinct_terms(text, base_spans(text))] if text else ())
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term"))


def share_told(rows: Column, both: Column, df_value: Column, df_term: Column) -> Column:
    """How much of a value's information ``log2(rows / df_value)`` a term tells.

    A term tells ``log2(P(value | term) / P(value))``. The estimate of ``P(value | term)`` is shrunk by ``PRIOR``
    documents with the term in which the value is as common as anywhere, so no pair is left out for being rare, and
    one meeting tells less than several. Null for a value that every row has.
    """
    everywhere = df_value / rows
    given = (F.least(both, df_value, df_term) + PRIOR * everywhere) / (df_term + PRIOR)
    return F.when(everywhere < 1, F.log2(given / everywhere) / -F.log2(everywhere))


def disclosing_terms(docs: DataFrame, text_col: str) -> DataFrame:
    """(``term``, ``share``) of the terms that disclose a protected value, see ``share_told``; the largest share of each.

    A term and a value meet in a row that has both. Values that stand in the same rows are told alike by
    every term, so they are judged as one.
    """
    seen = cut(protected(docs, text_col).withColumn("__row", F.monotonically_increasing_id()))
    total = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    shown = seen.select("__row", F.explode("values").alias("value"))
    # The set of rows of a value as 128 bits, whatever their order.
    where = [F.expr("bit_xor(xxhash64(__row))").alias("a"), F.expr("bit_xor(xxhash64(1, __row))").alias("b")]
    values = shown.groupBy("value").agg(F.count(F.lit(1)).alias("df_value"), *where)
    kinds = (
        shown.join(values, "value")
        .groupBy("__row")
        .agg(F.collect_set(F.struct("a", "b", "df_value")).alias("kinds"))
        .withColumnRenamed("__row", "__kinds_row")
    )
    terms = seen.select("__row", F.explode("terms").alias("term")).join(vocabulary(docs, text_col), "term").withColumn("rows", total)
    met = terms.join(kinds, F.col("__row") == F.col("__kinds_row"))
    # Pairs that would stay below the threshold even if the two met in every row of the value are not counted.
    able = F.filter("kinds", lambda k: share_told(F.col("rows"), k["df_value"], k["df_value"], F.col("df_term")) >= GENERALISE)
    pairs = met.select("rows", "term", "df_term", F.explode(able).alias("kind")).groupBy("kind", "term", "df_term", "rows").agg(F.count(F.lit(1)).alias("n"))
    share = share_told(F.col("rows"), F.col("n"), F.col("kind.df_value"), F.col("df_term"))
    return pairs.select("term", share.alias("share")).where(F.col("share") >= GENERALISE).groupBy("term").agg(F.max("share").alias("share"))


def term_filter(disclosing: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms, of bounded size: it spares others the exact join and never leaves out one of them."""
    n = disclosing.count()
    bits = 64
    while bits < min(n * FILTER_BITS, MOST_FILTER_BITS):
        bits *= 2
    low, high = F.col("term").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("term", 32)
    probes = F.array(*[(low + k * high).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)])
    words = (
        disclosing.select(F.explode(probes).alias("at"))
        .select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS INT))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    filled = np.zeros(bits // 64, np.int64)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(filled.astype("<i8").view(np.uint8), bitorder="little")


def scan(docs: DataFrame, id_col: str, text_col: str, filled: np.ndarray) -> DataFrame:
    """Base spans of every row, and where each term that passes the filter stands in it."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        mask = len(bits) - 1

        class Passing(Numbers):
            """The number of a term that passes, else None."""

            def __missing__(self, term: str) -> int | None:
                number = super().__missing__(term)
                low, high = number & 0xFFFFFFFF, (number >> 32) & 0xFFFFFFFF
                if not all(bits[(low + k * high) & mask] for k in range(PROBES)):
                    self[term] = number = None
                return number

        passing = Passing()
        for batch in batches:
            spans, terms = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text) if text else []
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                at: dict[int, list[dict]] = {}
                for word, start, end in terms_in(text, own) if text else ():
                    number = passing[word.lower()]
                    if number is not None:
                        at.setdefault(number, []).append({"start": start, "end": end})
                terms.append([{"term": t, "at": places} for t, places in at.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(terms, pa.list_(_PLACES))], ["id", "spans", "terms"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(
        run, f"id {kind}, spans array<struct<start:long,kind:int,end:long>>, terms array<struct<term:long,at:array<struct<start:long,end:long>>>>"
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base matches of every row and the terms that disclose a matched value of any row.

    A term (three letters or more) discloses a protected value if its standing in a row tells 70 % of the
    value's information; from 90 % on it is to be removed, below generalised, wherever it stands in any
    row. Every pair of a value and a term of one row is judged, however rare. Statistics cover all rows.

    Null texts are empty and have no spans. Repeated rows each have their own. An empty table gives
    no rows. Only the id and text columns are read, so others may have any name.

    Result: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` (text), ``found``: an array of
    (start, kind, end, action).
    """
    ship(docs.sparkSession)
    disclosing = cut(disclosing_terms(docs, text_col))
    found = cut(scan(docs, id_col, text_col, term_filter(disclosing)).withColumn("__row", F.monotonically_increasing_id()))
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    places = F.transform("at", lambda p: F.struct(p["start"].alias("start"), F.lit(4).alias("kind"), p["end"].alias("end"), action.alias("action")))
    extra = (
        found.select("__row", F.explode("terms").alias("t"))
        .select("__row", "t.term", "t.at")
        .join(disclosing, "term")
        .groupBy("__row")
        .agg(F.flatten(F.collect_list(places)).alias("extra"))
    )
    joined = found.drop("terms").join(extra, "__row", "left")
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("replace").alias("action")))
    everything = F.array_sort(F.concat(base, F.coalesce("extra", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,action:string>>"))))
    return joined.select(
        F.col("id").alias(id_col),
        *[_count_of(k) for k in range(4)],
        F.sha2(listed(F.array_sort("spans")), 256).alias("base_sha256"),
        listed(everything).alias("spans"),
        F.transform(
            everything, lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["kind"]).alias("kind"), s["end"].alias("end"), s["action"].alias("action"))
        ).alias("found"),
    )


def _count_of(kind: int):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def sanitise(text: str | None, found: list[dict] | None) -> str | None:
    """The text with base matches replaced by their kind, terms generalised to their kind or removed.

    Where matches overlap, the first one, or the longer of two with one start, covers the others' common part.
    """
    if text is None or not found:
        return text
    parts, last = [], 0
    for span in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if span["end"] <= last:
            continue
        parts.append(text[last : max(span["start"], last)])
        if span["start"] >= last:
            parts.append("" if span["action"] == "remove" else f"<{span['kind']}>")
        last = span["end"]
    return "".join([*parts, text[last:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``text`` sanitised. Ids must be unique; the other columns are kept as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [sanitise(t, f) for t, f in zip(batch.column(at).to_pylist(), batch.column("__found").to_pylist())]
            columns = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "__found"]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "__found"])

    found = personal_data(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("found").alias("__found"))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    return joined.mapInArrow(run, docs.schema)
