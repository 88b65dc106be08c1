from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabloom import generate_customers, load_table, save_table
from tabloom.errors import DataError
from tabloom.sources.delimited import detect_separator, file_forms
from tabloom.sources.tables import save_splits


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_with_comma_and_semicolon(spark, tmp_path):
    df = load_table(spark, write(tmp_path, "a.csv", "a,b,c\n1,2,3\n4,5,6\n"))
    assert df.columns == ["a", "b", "c"] and rows(df) == [(1, 2, 3), (4, 5, 6)]
    df = load_table(spark, write(tmp_path, "b.csv", "a;b;c\n1;2;3\n"))
    assert df.columns == ["a", "b", "c"] and rows(df) == [(1, 2, 3)]
    df = load_table(spark, write(tmp_path, "c.tsv", "a\tb\n1\tx\n"))
    assert rows(df) == [(1, "x")]


def test_separator_ties_go_to_the_earlier_one():
    assert detect_separator("a;b,c") == ","
    assert detect_separator("a|b|c,d") == "|"
    assert detect_separator("abc") == ","


def test_wrong_first_separator_falls_back(spark, tmp_path):
    # The header has more commas than semicolons, but with commas later rows are too long.
    text = "x,y,z;b\n1,2,3,4;5\n"
    df = load_table(spark, write(tmp_path, "a.csv", text))
    assert df.columns == ["x,y,z", "b"] and rows(df) == [("1,2,3,4", 5)]
    with pytest.raises(DataError, match="not a table"):
        load_table(spark, write(tmp_path, "b.csv", "a,b\n1,2,3;4;5|6|7\t8\t9\n"), sep=",")


def test_encodings(spark, tmp_path):
    assert rows(load_table(spark, write(tmp_path, "a.csv", "n,v\né,1\n", "latin-1"))) == [("é", 1)]
    assert rows(load_table(spark, write(tmp_path, "b.csv", "﻿n,v\né,1\n"))) == [("é", 1)]


def test_folder_with_two_column_orders_and_encodings(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    write(folder, "a.csv", "id,price,name\n1,10,é\n")
    write(folder, "b.csv", "id,name,price\n2,ü,20\n", "latin-1")
    write(folder, "c.csv", "name;id;price\nx;3;30\n")
    df = load_table(spark, str(folder), "csv")
    assert sorted(tuple(r) for r in df.select("id", "price", "name").collect()) == [(1, 10, "é"), (2, 20, "ü"), (3, 30, "x")]
    write(folder, "d.csv", "id,cost,name\n4,40,y\n")
    with pytest.raises(DataError, match="different columns"):
        load_table(spark, str(folder), "csv")


def test_latin_files_stay_splittable(spark, tmp_path):
    path = write(tmp_path, "a.csv", "n,v\n" + "é,1\n" * 3, "latin-1")
    assert not file_forms(spark, path)[0].spanning
    path = write(tmp_path, "b.csv", 'n,v\n"é\nü",1\n', "latin-1")
    assert file_forms(spark, path)[0].spanning and rows(load_table(spark, path)) == [("é\nü", 1)]


def test_quoted_cells_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n"x ""y"", z",1\n"two\nlines",2\n')
    assert file_forms(spark, path)[0].spanning
    assert sorted(rows(load_table(spark, path))) == [("two\nlines", 2), ('x "y", z', 1)]
    plain = write(tmp_path, "b.csv", 'a,b\n"x, y",1\n')
    assert not file_forms(spark, plain)[0].spanning


def test_missing_tokens_and_types(spark, tmp_path):
    text = "i,d,b,s,e,w\n1,NA,True,x,,1d\n,2.5,False,null,n/a,2\n 3,1e3,,NaN,,3\n"
    df = load_table(spark, write(tmp_path, "a.csv", text))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "double", "string"]
    assert rows(df) == [
        (1, None, True, "x", None, "1d"),
        (None, 2.5, False, None, None, "2"),
        (3, 1000.0, None, None, None, "3"),
    ]


def test_short_rows_are_filled(spark, tmp_path):
    assert rows(load_table(spark, write(tmp_path, "a.csv", "a,b,c\n1,2\n"))) == [(1, 2, None)]


def test_declared_schema_needs_no_inference(spark, tmp_path):
    df = load_table(spark, write(tmp_path, "a.csv", "a,b\n1,2\n"), schema="a double, b string")
    assert rows(df) == [(1.0, "2")]


def test_json(spark, tmp_path):
    df = load_table(spark, write(tmp_path, "a.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]'))
    assert rows(df) == [(1, "x"), (2, None)]
    df = load_table(spark, write(tmp_path, "a.jsonl", '{"a": 1}\n{"a": 2}\n'))
    assert rows(df) == [(1,), (2,)]
    df = load_table(spark, write(tmp_path, "c.json", '[{"a": {"x": 1}, "b": {"y": 2}}]'))
    assert [r.a.x for r in df.collect()] == [1]


def test_json_by_column(spark, tmp_path):
    text = '{"a b": {"0": 1, "1": 2, "10": null}, "t": {"1": "x", "0": "é \\"q\\""}, "f": {"0": 0.5, "1": 2, "10": 1e300}, "u": {"0": null}, "m": {"0": 1, "1": "z"}}'
    df = load_table(spark, write(tmp_path, "b.json", text))
    assert df.columns == ["a b", "t", "f", "u", "m"]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "string", "string"]
    assert sorted(rows(df), key=str) == [(1, 'é "q"', 0.5, None, "1"), (2, "x", 2.0, None, "z"), (None, None, 1e300, None, None)]
    many = json.dumps({"a": {str(i): i for i in range(5000)}, "b": {str(i): str(i) for i in range(5000)}})
    wide = load_table(spark, write(tmp_path, "many.json", many))
    assert wide.columns == ["a", "b"] and wide.count() == 5000 and wide.where("b = cast(a as string)").count() == 5000
    # The same shape one level down is a record with structs, and one without row numbers is a record.
    assert load_table(spark, write(tmp_path, "r.json", '{"a": {"x": 1}, "b": {"y": 2}}')).first().a.x == 1


def test_errors(spark, tmp_path):
    with pytest.raises(DataError, match="not found"):
        load_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(DataError, match="not found"):
        load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(DataError, match="Unsupported dataset format"):
        load_table(spark, write(tmp_path, "a.xyz", "hello"))
    with pytest.raises(DataError, match="no rows"):
        load_table(spark, write(tmp_path, "e.csv", "a,b\n"))


def test_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "a double").write.parquet(path)
    assert load_table(spark, path).where("a is null").count() == 1


def test_overwrite_protection(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "a bigint, b string")
    path = save_table(df, str(tmp_path / "t.csv"))
    with pytest.raises(DataError, match="exists already"):
        save_table(df, path)
    save_table(df, path, overwrite=True)
    assert sorted(rows(load_table(spark, path))) == [(1, 'a "q", b'), (2, None)]


def test_splits_are_one_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string")
    path = save_splits(df, str(tmp_path / "parts"))
    assert rows(spark.read.parquet(path).where("split = 'test'")) == [(2, "test")]


def test_generated_customers(spark):
    df = generate_customers(spark, 500)
    assert df.count() == 500
    assert {r[0] for r in df.select("churn").distinct().collect()} <= {0, 1}
    again = df.repartition(5).exceptAll(generate_customers(spark, 500))
    assert again.count() == 0
    other = generate_customers(spark, 500, seed=1).exceptAll(df)
    assert other.count() > 400
    priced = generate_customers(spark, 2000, task="regression")
    stats = priced.agg(
        F.count("price"), F.min("price"), F.count_if(F.col("monthly_charges").isNull()), F.avg("income")
    ).first()
    assert stats[0] == 2000 and stats[1] >= 0 and 20 < stats[2] < 120 and 58000 < stats[3] < 62500
    for bad in ({"task": "bogus"}, {"rows": 10}):
        with pytest.raises(DataError):
            generate_customers(spark, **({"rows": 100} | bad))
