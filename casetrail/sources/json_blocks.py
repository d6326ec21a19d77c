"""JSON values of files of any size: lines and arrays cut into values by many tasks.

A file is read in blocks of bytes. For a file that is one array, a first scan finds what each block does to the state
of a reader, whatever state it begins in: whether it ends inside a string, and how far brackets nest deeper or less. Putting these
together along a file (a few numbers a block) tells every block the state it begins in, so a second scan cuts it into elements by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.session import ship
from casetrail.sources.storage import file_system

#: Bytes of a block, and of values passed on at a time.
BLOCK = 8 << 20
_VALUES = 4 << 20
# States of a reader: outside a string, inside one, inside one after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_BLANK = b" \t\r\n"
_MARK = b"\xef\xbb\xbf"


def structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which bytes stand outside strings, how much each changes the depth, and the state after the last, from the state before the first."""
    places = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _BACKSLASH, places, -1)) if len(data) else places
    # Backslashes right before each byte and, last, before the end; one more if the first byte is escaped itself.
    run = np.concatenate([[0], places - plain])
    if state == ESCAPED:
        run[np.concatenate([[True], plain == -1])] += 1
    quotes = (data == _QUOTE) & (run[:-1] & 1 == 0)
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) & 1 == 1
    outside = ~inside & ~quotes
    change = ((data == 91) | (data == 123)).astype(np.int64) - ((data == 93) | (data == 125))
    if not len(data):
        return outside, change, state
    end = OUTSIDE if not inside[-1] else ESCAPED if run[-1] & 1 else INSIDE
    return outside, np.where(outside, change, 0), end


def element_edges(data: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places where an element of the outer array begins or ends, which of them begin one, and state and depth after the last byte."""
    outside, change, end = structure(data, state)
    depths = depth + np.cumsum(change)
    opens = (change == 1) & (depths == 1)
    closes = (change == -1) & (depths == 0)
    commas = outside & (data == _COMMA) & (depths == 1)
    at = np.flatnonzero(opens | closes | commas)
    return at, ~closes[at], end, int(depths[-1]) if len(data) else depth


class _File:
    """Blocks of one file."""

    def __init__(self, path: str, length: int, size: int):
        system, name = file_system(path)
        self.handle, self.length, self.size = system.open_input_file(name), length, size

    def block(self, number: int) -> bytes:
        begin = number * self.size
        return self.handle.read_at(min(self.size, self.length - begin), begin) if begin < self.length else b""


def _is_array(path: str, length: int, size: int) -> bool:
    file, number = _File(path, length, size), 0
    while data := file.block(number):
        text = (data.removeprefix(_MARK) if number == 0 else data).lstrip(_BLANK)
        if text:
            return text.startswith(b"[")
        number += 1
    return False


def _elements(path: str, length: int, size: int, number: int, state: int, depth: int) -> Iterator[bytes]:
    """The elements that begin in a block; the last one is followed into the blocks after it."""
    file = _File(path, length, size)
    data = file.block(number)
    at, begins, state, depth = element_edges(np.frombuffer(data, np.uint8), state, depth)
    edges, starts = at.tolist(), begins.tolist()
    for begin, end, is_start in zip(edges[:-1], edges[1:], starts[:-1]):
        if is_start:
            yield data[begin + 1 : end]
    if edges and starts[-1]:
        parts = [data[edges[-1] + 1 :]]
        while True:
            number += 1
            more = file.block(number)
            at, _, state, depth = element_edges(np.frombuffer(more, np.uint8), state, depth)
            parts.append(more[: int(at[0])] if len(at) else more)
            if len(at) or not more:
                break
        yield b"".join(parts)


def _lines(path: str, length: int, size: int, number: int) -> Iterator[bytes]:
    """The lines that begin in a block."""
    file = _File(path, length, size)
    data = file.block(number)
    begin = 0
    if number:
        if file.handle.read_at(1, number * size - 1) != b"\n":
            begin = data.find(b"\n") + 1
            if not begin:
                return
    elif data.startswith(_MARK):
        begin = len(_MARK)
    rows = data[begin:].split(b"\n")
    yield from rows[:-1]
    parts = [rows[-1]]
    if not data or data.endswith(b"\n"):
        return
    while more := file.block(number := number + 1):
        end = more.find(b"\n")
        parts.append(more if end < 0 else more[:end])
        if end >= 0:
            break
    yield b"".join(parts)


def _begin_states(table: pd.DataFrame) -> pd.DataFrame:
    """State and depth in which every block of a file begins; a row a block."""
    table = table.sort_values("block", kind="stable")
    ends, deeper = (table[[f"{name}{s}" for s in range(3)]].to_numpy().tolist() for name in ("end", "deeper"))
    state, depth, found = OUTSIDE, 0, []
    for k in range(len(table)):
        found.append((state, depth))
        state, depth = ends[k][state], depth + deeper[k][state]
    states, depths = zip(*found)
    return pd.DataFrame({"path": table["path"], "file": table["file"], "length": table["length"], "block": table["block"], "state": states, "depth": depths})


def list_json_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``path``, ``file`` (the name a scan gives) and ``length`` of the files below a path; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return listed.select("path", F.col("_metadata.file_path").alias("file"), "length")


def read_json_values(spark: SparkSession, path: str | list[str] | DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (``value``, ``source_file``) per JSON value of files of lines and files of one array, also mixed in a folder.

    A file whose first visible character is ``[`` is an array. Files of either form are split into blocks between tasks, so neither
    a file nor a line of it has a greatest size; one value must fit into a task. Blank lines and blank elements are left
    out. What is no JSON comes as the text between its edges, for the parser to reject; an array that is cut off ends with such a text.
    Files may also be given as rows, as ``list_json_files`` gives them; their names do not reach the driver then.
    """
    ship(spark)
    files = path if isinstance(path, DataFrame) else list_json_files(spark, path).repartition("path")
    kept = "path string, file string, length long"

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_is_array(p, n, block) for p, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, "is_array"])

    last = F.floor((F.greatest("length", F.lit(1)) - 1) / block)
    formed = files.mapInArrow(heads, f"{kept}, is_array boolean")
    blocks = formed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition("path", "block")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(_File(row["path"], row["length"], block).block(row["block"]), np.uint8)
                for state in range(3):
                    _, change, end = structure(data, state)
                    row |= {f"end{state}": end, f"deeper{state}": int(change.sum())}
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema(
        [("path", pa.string()), ("file", pa.string()), ("length", pa.int64()), ("block", pa.int64())]
        + [field for s in range(3) for field in ((f"end{s}", pa.int32()), (f"deeper{s}", pa.int64()))]
    )
    layout = f"{kept}, block long, " + ", ".join(f"end{s} int, deeper{s} long" for s in range(3))
    scanned = blocks.filter("is_array").drop("is_array").mapInArrow(summaries, layout)
    begun = scanned.groupBy("path").applyInPandas(_begin_states, f"{kept}, block long, state int, depth long").repartition("path", "block")

    def values(cut):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def batch_of(texts: list[bytes], file: str) -> pa.RecordBatch:
                shown = [t.decode("utf-8", "replace") for t in texts]
                return pa.RecordBatch.from_arrays([pa.array(shown, pa.string()), pa.array([file] * len(shown), pa.string())], ["value", "source_file"])

            for batch in batches:
                for row in batch.to_pylist():
                    texts, size = [], 0
                    for text in cut(row):
                        text = text.strip(_BLANK)
                        if text:
                            texts.append(text)
                            size += len(text)
                        if size >= _VALUES:
                            yield batch_of(texts, row["file"])
                            texts, size = [], 0
                    yield batch_of(texts, row["file"])

        return run

    result = "value string, source_file string"
    elements = begun.mapInArrow(values(lambda r: _elements(r["path"], r["length"], block, r["block"], r["state"], r["depth"])), result)
    lines = blocks.filter("NOT is_array").mapInArrow(values(lambda r: _lines(r["path"], r["length"], block, r["block"])), result)
    return lines.unionByName(elements)
