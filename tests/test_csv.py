import csv
import io
import random

import pytest

from equiframe.sources import csv_records as R
from equiframe.sources.csv import has_multiline_records, read_csv, write_csv


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_null_tokens_and_types(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c,d\n1,--,x,True\n2,NA,None,\n3,N/A,null,False\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "string"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, None, "x", "True"), (2, None, None, None), (3, None, None, "False")]


def test_numbers_booleans_and_lookalikes(spark, tmp_path):
    path = write(tmp_path / "b.csv", "i,f,e,b,code,date\n1,1.5,1e3,True,1d,2020-01-01\n-2,NaN,.5,false,2f,2020-01-02\n")
    df = read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "double", "boolean", "string", "string"]
    assert df.filter("i = -2").first()["f"] is None


def test_integers_with_gaps_stay_integers(spark, tmp_path):
    assert read_csv(spark, write(tmp_path / "c.csv", "k,v\n1,\n,2\n")).dtypes == [("k", "bigint"), ("v", "bigint")]


def test_round_trip_with_quotes_and_lines(spark, tmp_path):
    rows = [(1, 'say "hi", twice', True), (2, "two\nlines", False), (3, "  padded ", True)]
    path = str(tmp_path / "out")
    write_csv(spark.createDataFrame(rows, "`case.id` int, text string, flag boolean"), path)
    assert has_multiline_records(spark, path)
    back = read_csv(spark, path)
    assert back.dtypes == [("case.id", "bigint"), ("text", "string"), ("flag", "boolean")]
    assert sorted(tuple(r) for r in back.collect()) == rows


def reader_state(line, inside):
    """Character by character: a quote opens a field only where the field begins."""
    begins, i = not inside, 0
    while i < len(line):
        if inside:
            if line[i] == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif begins and line[i] == '"':
            inside = True
        begins = not inside and line[i] == ","
        i += 1
    return inside


def test_state_of_a_line():
    rng = random.Random(2)
    for _ in range(4000):
        line = "".join(rng.choice('a",') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert R.ends_inside(line, inside) == reader_state(line, inside), (line, inside)
    assert not R.ends_inside('5" pipe,x', False) and R.ends_inside('a,"5"" pipe', False)
    assert R.ends_inside('"' + 'a""' * 20_000, False)


@pytest.fixture
def small_splits(spark):
    for name, value in (("maxPartitionBytes", "60"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_over_lines_in_small_splits(spark, tmp_path, small_splits, ending):
    rng, files = random.Random(3), []
    for f in range(3):
        rows = [(f"{f}-{i}", "".join(rng.choice(['a', 'b c', '"', ',', '\n', '\n\n', '""', ' é ']) for _ in range(rng.randrange(14))) or "x",
                 rng.choice(["plain", 'say "x"', "5\n6", "x" * 150])) for i in range(40)]
        text = io.StringIO(newline="")
        writer = csv.writer(text, lineterminator=ending, quoting=csv.QUOTE_ALL if f == 1 else csv.QUOTE_MINIMAL)
        writer.writerows([("the key", "free\ntext" if f == 0 else "free\ntext", "third"), *rows])
        (tmp_path / f"{f}.csv").write_text(text.getvalue() if f else text.getvalue().rstrip("\r\n"), encoding="utf-8", newline="")
        files += rows
    lines = R._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 50
    assert R.split_starts(spark, str(tmp_path)).filter("inside").count() > 10
    back = read_csv(spark, str(tmp_path))
    assert back.columns == ["the key", "free\ntext", "third"]
    assert sorted(map(tuple, back.collect())) == sorted(files)


def test_a_lone_quote_opens_nothing(spark, tmp_path, small_splits):
    path = write(tmp_path / "p.csv", 'k,size,note\n1,5" pipe,"two\nlines"\n2,6" pipe,x\n' + "3,7,y\n" * 20 + '4,8" end,"a ""b"" c\n"\n')
    rows = {tuple(r) for r in read_csv(spark, path).collect()}
    assert rows == {(1, '5" pipe', "two\nlines"), (2, '6" pipe', "x"), (3, "7", "y"), (4, '8" end', 'a "b" c\n')}


def test_an_open_end_and_repeated_names(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,A,\n1,2,"x\ny"\n\n3,4,"never closed\nto the end')
    back = read_csv(spark, path)
    assert back.columns == ["a0", "A1", "_c2"]
    rows = {tuple(r) for r in back.collect()}
    assert (1, 2, "x\ny") in rows and len(rows) == 2
    assert R.column_names("\ufeffid,name") == ["id", "name"]
