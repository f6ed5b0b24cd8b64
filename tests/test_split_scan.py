"""Records that cross lines and blocks, against readers that see the whole file."""

import contextlib
import csv
import io
import json
import random

import pytest
from conftest import rows
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from labelmill.sources import readers, split_scan


@contextlib.contextmanager
def blocks_of(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "16"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


CELLS = ["", "a", "two words", 'say "hi"', "line\nbreak", "\n\n", ",", '","', '"', "tail\n", "é,ü\n\"x\"", "x" * 90, "y\n" * 40]


def random_csv(seed, n=25):
    rng = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]))
    w.writerow(["id", "text", "n"])
    data = [(str(i), rng.choice(CELLS), rng.choice(CELLS)) for i in range(n)]
    w.writerows(data)
    return out.getvalue(), data


@pytest.mark.parametrize("seed", range(2))
def test_csv_blocks_equal_a_whole_reader(spark, tmp_path, seed):
    parts = [random_csv(seed * 10 + k) for k in range(3)]
    for k, (text, _) in enumerate(parts):
        (tmp_path / f"f{k}.csv").write_text(text, encoding="utf-8")
    want = [(i, *r) for i, r in enumerate(r for _, data in parts for r in data)]
    for size in (90, 1 << 20):
        with blocks_of(spark, size):
            df = readers.load_csv(spark, str(tmp_path))
            assert sorted(rows(df, "row_index", "id", "text", "n")) == want


def test_csv_is_read_by_a_task_per_block(spark, tmp_path):
    text, data = random_csv(99, 400)
    (tmp_path / "one.csv").write_text(text, encoding="utf-8")
    with blocks_of(spark, 500):
        found = split_scan.records(spark, str(tmp_path), split_scan.CsvScanner(), 0)
        assert found.blocks.count() > 20 and found.rows.rdd.getNumPartitions() > 20
        assert found.rows.count() == len(data) + 1 and found.files.first()["records"] == len(data) + 1


def test_csv_joined_by_shuffle_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_scan, "MOST_BROADCAST", 2)
    text, data = random_csv(7, 100)
    (tmp_path / "one.csv").write_text(text, encoding="utf-8")
    with blocks_of(spark, 150):
        assert sorted(rows(readers.load_csv(spark, str(tmp_path)), "row_index", "text", "n")) == [(i, t, n) for i, (_, t, n) in enumerate(data)]


def test_csv_broken_records_keep_positions(spark, tmp_path):
    text = 'a,b\r\n1,"x\r\ny"\r\n\r\nbare"quote,2\r\n"closed"late,3\r\n4,ok\r\n5,6,7\r\n"8","""q"""\r\n9,"never closed\r\n10,11\r\n'
    (tmp_path / "one.csv").write_bytes(text.encode())
    for size in (9, 1 << 20):
        with blocks_of(spark, size):
            assert sorted(rows(readers.load_csv(spark, str(tmp_path)), "row_index", "a", "b")) == [(0, "1", "x\ny"), (3, "4", "ok"), (5, "8", '"q"')]


def test_csv_other_header_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x\ny",b\n1,2\n')
    (tmp_path / "b.csv").write_text('"x\ny",c\n1,2\n')
    with pytest.raises((PySparkException, Exception), match="header"):
        readers.load_csv(spark, str(tmp_path)).collect()


VALUES = ["", "a", 'q"uote', "back\\slash", "\\", '\\"', "}{", "[}", "],[", "a}\\", "é\n", {"x": [1, {"y": "}"}]}, [1, 2, [3]], None, 1.5, True, "}" * 50, "\\" * 7]


def random_json(seed, n=20):
    rng = random.Random(seed)
    data = [{"id": i, "s": rng.choice([v for v in VALUES if isinstance(v, str)]), "m": {"k": rng.choice(["}", '"', "ok"]), "v": rng.choice([[], [1], [1, 2]])}} for i in range(n)]
    return json.dumps(data, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.choice([True, False])), data


@pytest.mark.parametrize("seed", range(2))
def test_json_blocks_equal_a_whole_reader(spark, tmp_path, seed):
    parts = [random_json(seed * 10 + k) for k in range(2)] + [("[ ]\n", [])] * (seed % 2)
    for k, (text, _) in enumerate(parts):
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
    flat = [r for _, data in parts for r in data]
    for size in (300, 1 << 20):
        with blocks_of(spark, size):
            df = readers.load_json(spark, str(tmp_path))
            got = sorted((r["row_index"], r["id"], r["s"], r["m"]["k"], r["m"]["v"]) for r in df.collect())
            assert got == [(i, r["id"], r["s"], r["m"]["k"], r["m"]["v"]) for i, r in enumerate(flat)]


def test_one_line_array_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"i": i, "t": "}" * (i % 5)} for i in range(500)]))
    with blocks_of(spark, 700):
        found = split_scan.records(spark, str(tmp_path), split_scan.JsonScanner(), 1)
        assert found.blocks.count() > 10 and found.rows.count() == 500
        assert readers.load_json(spark, str(tmp_path)).filter("row_index <> i").count() == 0


@pytest.mark.parametrize("text", ['[{"a":1},]', '[{"a":1} {"a":2}]', '[1,{"a":1}]', '[{"a":1}', '[{"a":"x}]', '{"a":[{"b":1}]}', '[[{"a":1}]]', '[{"a":1}]]', '[{"a":1},{"a":}]', '[{"a":1}] x'])
def test_broken_json_raises(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    for size in (7, 1 << 20):
        with blocks_of(spark, size), pytest.raises((PySparkException, Py4JError)):
            readers.load_json(spark, str(tmp_path)).collect()


def test_string_states():
    s = split_scan.JsonScanner()
    for piece, inside, want in [('{"a":"x"', False, False), ('{"a":"x', False, True), ('{"a":"', False, True), ('{"a":""', False, False), ('x"', True, False), ('x\\"', True, True), ('x\\\\"', True, False), ("", True, True), ("", False, False), ('","b":"', True, True)]:
        assert s.scan((inside, 0), piece, {})[0] == want, piece
