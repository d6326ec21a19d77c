"""JSON files cut into values by blocks, against a parser of whole files."""

import json
import random

import numpy as np
import pytest

from casetrail.sources import json_blocks
from casetrail.sources.json_blocks import ESCAPED, INSIDE, OUTSIDE, _begin_states, _elements, _is_array, _lines, element_edges, structure


def reader(data, state):
    """State and depth after each byte, one byte at a time."""
    depth = 0
    for c in data:
        if state == OUTSIDE:
            state = INSIDE if c == 34 else OUTSIDE
            depth += {91: 1, 123: 1, 93: -1, 125: -1}.get(c, 0)
        elif state == ESCAPED:
            state = INSIDE
        else:
            state = {34: OUTSIDE, 92: ESCAPED}.get(c, INSIDE)
    return state, depth


def test_blocks_change_the_state_as_a_reader_does():
    rng = random.Random(2)
    for _ in range(3000):
        state = rng.randrange(3)
        data = bytes(rng.choice(b'"\\[]{},ab') for _ in range(rng.randrange(14)))
        if state == OUTSIDE or b"\\" in data:
            # Backslashes outside a string are no JSON.
            data = data.replace(b"\\", b"") if state == OUTSIDE else data
        plain = bytearray()
        at = state
        for c in data:
            if at == OUTSIDE and c == 92:
                continue
            plain.append(c)
            at = reader(bytes([c]), at)[0]
        _, change, end = structure(np.frombuffer(bytes(plain), np.uint8), state)
        assert (end, int(change.sum())) == reader(bytes(plain), state)


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return rng.choice([None, 1.5, "a,b", 'q"]', "\\", "\\\\\"", "é€😀[{", "", True])
    items = [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return items if kind == 3 else {f"k{i}\\\"": v for i, v in enumerate(items)}


def cut(path, length, size):
    """All blocks of a file, each by itself."""
    import pandas as pd

    n = max(1, -(-length // size))
    if not _is_array(path, length, size):
        return [x for k in range(n) for x in _lines(path, length, size, k)]
    rows = []
    for k in range(n):
        data = np.frombuffer(json_blocks._File(path, length, size).block(k), np.uint8)
        row = {"path": path, "file": path, "length": length, "block": k}
        for s in range(3):
            _, change, end = structure(data, s)
            row |= {f"end{s}": end, f"deeper{s}": int(change.sum())}
        rows.append(row)
    begun = _begin_states(pd.DataFrame(rows))
    return [x for r in begun.to_dict("records") for x in _elements(path, length, size, r["block"], r["state"], r["depth"])]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
def test_values_whatever_the_block(tmp_path, block):
    rng = random.Random(block)
    mark = "\ufeff" * (block > 2)
    for turn in range(25):
        values = [value(rng) for _ in range(rng.randrange(6))]
        for name, text in (
            ("array", mark * (turn % 2) + rng.choice(["", " \n", "\t"]) + json.dumps(values, indent=rng.choice([None, 1]), ensure_ascii=bool(turn % 3))),
            ("lines", mark * (turn % 2) + "\n" * (turn % 4) + "".join(json.dumps({"v": v}) + rng.choice(["\n", "\r\n", "\n\n"]) for v in values).rstrip("\n" * (turn % 2))),
        ):
            path = tmp_path / f"{name}-{turn}"
            data = text.encode()
            path.write_bytes(data)
            found = [json.loads(x) for x in cut(f"file:{path}", len(data), block) if x.strip(b" \t\r\n")]
            assert found == (values if name == "array" else [{"v": v} for v in values])


def test_edges_of_a_cut_off_array(tmp_path):
    path = tmp_path / "x"
    path.write_text('[{"a": 1}, {"b": [2, ')
    assert [x.strip() for x in cut(f"file:{path}", 21, 5)] == [b'{"a": 1}', b'{"b": [2,']
    assert element_edges(np.zeros(0, np.uint8), INSIDE, 4)[2:] == (INSIDE, 4)


def test_an_array_is_split_between_tasks(spark, tmp_path):
    records = [{"id": f"i{k}", "name": "x" * (k % 300)} for k in range(400)]
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "array.json").write_text(json.dumps(records))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ] ")
    found = json_blocks.read_json_values(spark, str(tmp_path), block=1000)
    by_file = {}
    for r in found.collect():
        by_file.setdefault(r.source_file.rsplit("/", 1)[1], []).append(json.loads(r.value)["id"])
    assert {k: sorted(v) for k, v in by_file.items()} == {n: sorted(r["id"] for r in records) for n in ("array.json", "lines.json")}
