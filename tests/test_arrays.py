"""JSON arrays re-cut by byte ranges, against the reader that takes one task a file."""

import json
import random

import pytest

from turnwise.sources import arrays
from turnwise.sources import conversations as sources


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def talks(n=60):
    """Texts with braces, quotes, backslashes and brackets, also at their ends."""
    rng = random.Random(6)
    parts = ["{", "}", "[", "]", '"', "\\", '\\"', "\n", "é", "日本", " ", "a", ", ", "}}", '"}', "\\\\", ""]

    def text():
        return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 200])))

    def turns():
        return [{"from": rng.choice(["human", "gpt"]), "value": text()} for _ in range(rng.choice([0, 1, 4]))]

    return [{"id": str(i), "other": {"nested": [{}, {"deep": "}"}]}, "conversations": turns()} for i in range(n)]


LAYOUTS = {
    "compact": lambda rows: json.dumps(rows),
    "indented": lambda rows: json.dumps(rows, indent=3, ensure_ascii=False) + "\n",
    "windows": lambda rows: json.dumps(rows, indent=1).replace("\n", "\r\n") + "\r\n \r\n",
    "spaced": lambda rows: "  [ \n" + " ,\n ".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n]   ",
}


def rows_of(df):
    return sorted((r.id, [tuple(t) for t in r.conversations]) for r in df.collect())


@pytest.mark.parametrize("layout", list(LAYOUTS))
@pytest.mark.parametrize("size", [1201, 1 << 20])
def test_objects_are_those_of_the_whole_file_reader(spark, tmp_path, small_ranges, layout, size):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_bytes(LAYOUTS[layout](talks(25)).encode())
    files = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    expected = rows_of(sources.read_raw(spark, files))
    assert len(expected) == 50
    small_ranges(size)
    assert rows_of(sources.read_raw(spark, files, recut=f"{tmp_path}/recut")) == expected


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps(talks(400)))
    small_ranges(4096)
    cut = arrays.fragments(spark, [str(tmp_path / "a.json")])
    ranges = -(-(tmp_path / "a.json").stat().st_size // 4096)
    assert cut.rdd.getNumPartitions() > 4
    assert ranges - 1 <= arrays.range_sums(cut).count() <= ranges


def test_an_object_over_many_ranges(spark, tmp_path, small_ranges):
    long = {"id": "long", "conversations": [{"from": "gpt", "value": "{x}" * 3000}, {"from": "human", "value": "}" * 500}]}
    short = {"id": "short", "conversations": []}
    (tmp_path / "a.json").write_text(json.dumps([short, long, long, short]))
    small_ranges(900)
    got = sources.read_raw(spark, [str(tmp_path / "a.json")], recut=f"{tmp_path}/recut").collect()
    assert sorted(r.id for r in got) == ["long", "long", "short", "short"]
    assert {r.conversations[0].value for r in got if r.id == "long"} == {"{x}" * 3000}


@pytest.mark.parametrize("text,n", [("[]", 0), ("", 0), ("[1, null, \"}\", {\"id\": \"a\"}]", 1), ('{"id": "a"}', 1), ('{"id": "a"}\n{"id": "b"}\n', 2)])
def test_other_files(spark, tmp_path, text, n):
    (tmp_path / "a.json").write_text(text)
    got = arrays.recut_arrays(spark, [str(tmp_path / "a.json")], f"{tmp_path}/recut").collect()
    assert len(got) == n and all(json.loads(r.value)["id"] for r in got)


def test_quotes_after_backslashes():
    import numpy as np

    for text in ('"a\\"b"', '"\\\\"', '"\\\\\\""', '""', "", '{"k": "\\\\\\\\"}'):
        data = np.frombuffer(text.encode(), np.uint8)
        expected, inside, escaped = [], False, False
        for c in text:
            expected.append(c == '"' and not escaped)
            escaped = c == "\\" and not escaped
        assert list(arrays._quotes(data)) == expected


def test_lines_of_arrays_are_arrays(spark, tmp_path):
    from turnwise.plans import inputs

    objects = spark.createDataFrame([(json.dumps(r),) for r in talks(9)], "value string").repartition(2)
    inputs.as_arrays(objects).write.text(f"{tmp_path}/arrays")
    read = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("*.txt")]
    assert sum(map(len, read)) == 9 and len(read) == 2
