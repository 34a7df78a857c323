import csv
import random

import pytest

from goldweave.sources import split_csv, tables


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    pieces = ["plain", "a, b", 'say "hi"', "line\nend", "\n\n", '"', '""', "é", "", "N/A", " x ", "end\r\nhere", '5" disk', "long " * 120, ","]
    return [[str(i), *["".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) for _ in range(3)]] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_read_what_one_does(spark, tmp_path, small_splits, end):
    for k in range(2):
        with open(tmp_path / f"x{k}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerows([["id", "one", "two words", "th`ree"], *rows_of(k)])
    want = sorted(map(tuple, tables.read_csv(spark, str(tmp_path), split=False).collect()), key=repr)
    got = tables.read_csv(spark, str(tmp_path), split=True)
    assert got.columns == ["id", "one", "two words", "th`ree"]
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 800
    assert split_csv._lines(spark, str(tmp_path), "UTF-8").rdd.getNumPartitions() > 50
    # Large files take this way by themselves.
    assert split_csv.largest(spark, str(tmp_path)) > 700
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "x0.csv")).collect()), key=repr) == sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "x0.csv"), split=False).collect()), key=repr)


def test_records_that_span_many_splits(spark, tmp_path, small_splits):
    text = "\n".join(f"line {i}, with ""a quote"" and more" for i in range(400))
    (tmp_path / "x.csv").write_text('id,text\n1,short\n2,"' + text.replace('"', '""') + '"\n3,5" disk\n4,"open to the end\n of the file')
    got = {r.id: r.text for r in tables.read_csv(spark, str(tmp_path / "x.csv"), split=True).collect()}
    assert got == {"1": "short", "2": text, "3": '5" disk', "4": "open to the end\n of the file"}
    (tmp_path / "e.csv").write_text("id,text\n")
    assert tables.read_csv(spark, str(tmp_path / "e.csv"), split=True).count() == 0


def test_states_of_lines():
    line = split_csv.stays_open
    assert not line("a,b", False) and line('a,"b', False) and not line('a,"b"', False) and not line('a,"b""c",d', False)
    assert line("a,b", True) and not line('a",b', True) and line('a",b,"c', True) and not line('5" disk', False) and line('x""y', True)
