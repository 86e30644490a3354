"""JSON lines by byte offset: any splits give the same lines and numbers; look-ups read their bytes alone; bad lines raise with their number."""

import io
import json
import os

import pytest

from orrery.sources import offsets

LINES = ['{"id": "a", "question": " What? "}', "", '{"id": "b", "question": "É 漢字 \\u00e9"}\r', '{"id": "a", "question": "last wins"}', '{"id": null, "question": "no id"}', '{"id": "long", "question": "' + "x" * 5000 + '"}', '{"id": "end", "question": "no line feed"}']


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes("\n".join(LINES).encode())
    (tmp_path / "in" / "b.jsonl").write_bytes(b'{"id": "z", "question": "other file"}\n')
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "in" / "empty.jsonl").write_bytes(b"")
    return f"{tmp_path}/in"


@pytest.mark.parametrize("size", [1, 7, 40, 1000, 1 << 20])
def test_splits_do_not_matter(size):
    raw = "\n".join(LINES).encode()
    got = [x for a in range(0, len(raw), size) for x in offsets.split_lines(io.BytesIO(raw), a, min(a + size, len(raw)))]
    assert b"".join(x for _, x in got) == raw and [x.rstrip(b"\n").decode() for _, x in got] == LINES
    assert all(raw[a : a + len(x)] == x for a, x in got)


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_lines_have_numbers(spark, path, size):
    got = sorted((os.path.basename(r.file), r.line, r.text) for r in offsets.numbered_lines(spark, path, split_bytes=size).collect())
    want = [("a.jsonl", k + 1, x.removesuffix("\r")) for k, x in enumerate(LINES)] + [("b.jsonl", 1, '{"id": "z", "question": "other file"}')]
    assert got == want
    assert sorted(r.question for r in offsets.questions_of(spark, path, split_bytes=size).collect()) == sorted(["What?", "É 漢字 é", "last wins", "no id", "x" * 5000, "no line feed", "other file"])


def test_bad_lines_raise_with_their_number(spark, path):
    with open(f"{path}/b.jsonl", "ab") as f:
        f.write(b'\n{"id": "y", "question": "  "}\n{broken\n[1]\n{"id": "w"}\n')
    got = sorted((r.line, r.error) for r in offsets.bad_lines(spark, path, split_bytes=16).collect())
    assert got == [(3, "blank question"), (4, "not a JSON object"), (5, "not a JSON object"), (6, "blank question")]
    with pytest.raises(Exception, match=r"b\.jsonl line [3-6]: "):
        offsets.questions_of(spark, path).collect()


def test_lookup_reads_its_bytes_only(spark, path, tmp_path):
    index = offsets.write_offsets(spark, path, f"{tmp_path}/index", split_bytes=50)
    assert {r.pid for r in index.collect()} == {"a", "b", "long", "end", "z"}
    at = {r.pid: (r.offset, r.bytes) for r in index.collect()}
    raw = bytearray("\n".join(LINES).encode())
    keep = [at[k] for k in ("a", "end")]
    for i in range(len(raw)):  # what isn't asked for is no text any more
        if not any(a <= i < a + n for a, n in keep):
            raw[i] = 0xFF
    open(f"{path}/a.jsonl", "wb").write(bytes(raw))
    asked = spark.createDataFrame([("end",), ("a",), ("a",), ("gone",), (None,), ("z",)], "pid string")
    got = sorted((str(r.pid), r.text and json.loads(r.text)["question"]) for r in offsets.lines_of(index, asked).collect())
    assert got == [("None", None), ("a", "last wins"), ("a", "last wins"), ("end", "no line feed"), ("gone", None), ("z", "other file")]


def test_spans_join_neighbours():
    near = offsets.NEAR
    assert list(offsets.spans([(0, 10), (10, 5), (15 + near, 5), (20 + 3 * near, 1)])) == [(0, 20 + near, [0, 1, 2]), (20 + 3 * near, 21 + 3 * near, [3])]
    assert [len(x[2]) for x in offsets.spans([(k * offsets.AT_ONCE // 2, offsets.AT_ONCE // 2) for k in range(5)])] == [2, 2, 1]
    assert list(offsets.spans([])) == []


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert offsets.numbered_lines(spark, f"{tmp_path}/none").count() == 0
