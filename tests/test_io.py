import json
import os
import tempfile

from murmur.schemas import COMMENTS_SCHEMA
from murmur.sources import io


def test_csv_quotes_newlines_and_na(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text(
        'comment_id,videoID,categoryID,views,commentText\n'
        '1,v1,24,10,"line one\nline two"\n'
        '2,v1,24,NA,"she said ""hi"""\n'
        '3,v2,22,5,NA\n'
        '4,v2,22,5,null\n'
        '5,v2,NA,5,\n'
        '6,v3,10,7,None\n'
        '7,v3,10,7,"  padded  "\n', encoding="utf-8")
    rows = {r["comment_id"]: r for r in io.read_table_csv(spark, str(p), COMMENTS_SCHEMA).collect()}
    assert rows[1]["commentText"] == "line one\nline two"
    assert rows[2]["commentText"] == 'she said "hi"' and rows[2]["views"] is None
    assert [rows[i]["commentText"] for i in (3, 4, 5, 6)] == [None, None, None, None]
    assert rows[5]["categoryID"] is None
    assert rows[7]["commentText"] == "  padded  "


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "v", 24, 3, 'a "q"\nb'), (2, "w", 22, 4, None), (3, "x", 10, 5, " sp ")],
                               COMMENTS_SCHEMA)
    out = str(tmp_path / "rt")
    io.write_table(df, out, fmt="csv")
    back = io.read_table_csv(spark, out, COMMENTS_SCHEMA)
    assert sorted(back.collect()) == sorted(df.collect())


def _cells(rnd):
    return rnd.choice(["", "plain", 'a "quoted" word', "two\nlines", "\n\n", '"', '""\n"', "comma, here", " sp ", "é😀", "x" * 60, "tail\n"])


def test_quoted_files_split_into_blocks_equal_the_whole_file_reader(spark, tmp_path):
    import csv
    import random

    from pyspark.sql import types as T

    rnd = random.Random(12)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "more")])
    for name, n, end in (("a", 200, "\n"), ("b", 1, "\n"), ("c", 0, "\n"), ("d", 90, "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "text", 'a "more" name'])
            w.writerows([f"{name}{i}", _cells(rnd), _cells(rnd)] for i in range(n))
    (tmp_path / "e.csv").write_text('id,text,more\n\n"e1","' + "long\n" * 300 + '",z\n\n')
    (tmp_path / "f.csv").write_text("id,text,more\nf1,no end,of line", encoding="utf-8")
    want = sorted(map(tuple, io.read_table_csv(spark, str(tmp_path), schema, multi_line=True).collect()), key=str)
    assert len(want) == 293
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = io.read_table_csv(spark, str(tmp_path), schema)
            assert sorted(map(tuple, got.collect()), key=str) == want
            records = io.quoted_records(spark, str(tmp_path / "a.csv"))
            assert size != "64" or records.select("block").distinct().count() > 40
        (tmp_path / "bad.csv").write_text('id,text,more\nx,"open,y\nz,z,z\n')
        import pytest

        for size in ("16", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            with pytest.raises(Exception, match="quotes that do not close"):
                io.read_table_csv(spark, str(tmp_path / "bad.csv"), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _json(tmp_path, obj):
    p = tmp_path / f"cat{len(os.listdir(tmp_path))}.json"
    p.write_text(json.dumps(obj, indent=2))
    return str(p)


def test_categories_last_title_wins(spark, tmp_path):
    path = _json(tmp_path, {"kind": "x", "items": [
        {"id": "24", "snippet": {"title": "Entertainment"}},
        {"id": "10", "snippet": {"title": "Music"}},
        {"id": "24", "snippet": {"title": "Comedy"}}]})
    got = {r["categoryID"]: r["category"] for r in io.category_dim(io.read_categories(spark, path)).collect()}
    assert got == {24: "Comedy", 10: "Music"}


def test_categories_empty_items(spark, tmp_path):
    path = _json(tmp_path, {"items": []})
    assert io.category_dim(io.read_categories(spark, path)).count() == 0


def test_categories_bad_id(spark, tmp_path):
    import pytest

    path = _json(tmp_path, {"items": [{"id": "x1", "snippet": {"title": "Bad"}}]})
    with pytest.raises(Exception):
        io.category_dim(io.read_categories(spark, path)).collect()
    lenient = io.category_dim(io.read_categories(spark, path), strict=False).collect()
    assert lenient[0]["categoryID"] is None
