import datetime as dt

import pytest

from tapeloom.sources import trade_files

SCHEMA = "code string, day date, side string, price double, volume long"
RENAME = {"证券代码": "code", "日期": "day", "买卖": "side", "成交价": "price", "数量": "volume"}


def write(folder, name, text, encoding):
    (folder / name).write_bytes(text.encode(encoding))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "a.csv", "证券代码,日期,买卖,成交价,数量\n600000,2024-01-02,买入,10.5,100\n", "utf-8-sig")
    write(tmp_path, "b.csv", "证券代码,日期,买卖,成交价,数量\n000001,20240103,卖出,\"1,010.25\",\"1,200\"\n\n", "gbk")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", "c.csv", "code,day,price,extra,side\n300001,2024/01/04,,x,\"buy\nmore\"\n", "utf-8")
    write(tmp_path, "empty.csv", "", "utf-8")
    write(tmp_path, "note.txt", "no table", "utf-8")
    return tmp_path


WANT = [("000001", dt.date(2024, 1, 3), "卖出", 1010.25, 1200), ("300001", dt.date(2024, 1, 4), "buy\nmore", None, None), ("600000", dt.date(2024, 1, 2), "买入", 10.5, 100)]


def test_mixed_encodings_make_one_table(spark, folder):
    import json

    spark.dataSource.register(trade_files.TradeFiles)
    source = spark.read.format("trade_files").schema(SCHEMA).option("rename", json.dumps(RENAME)).load(str(folder))
    assert sorted(map(tuple, source.collect())) == WANT and source.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, trade_files.read_trade_files(spark, str(folder), SCHEMA, RENAME).collect())) == WANT


@pytest.mark.parametrize("line, say", [("1,2024-01-02,b,ten,5", r"bad.csv, line 3: 'ten' is no double for price"), ("1,2024-13-02,b,1,5", "line 3: '2024-13-02' is no date"), ("1,2024-01-02,b,1,5.5", "'5.5' is no bigint"),
                                       ("1,2024-01-02,b,nan,5", "'nan' is no double"), ("1,2024-01-02,b,1", "line 3: 4 fields, the header has 5")])
def test_a_bad_value_names_file_and_line(spark, tmp_path, line, say):
    write(tmp_path, "bad.csv", f"code,day,side,price,volume\n1,2024-01-01,b,1,1\n{line}\n", "utf-8")
    with pytest.raises(Exception, match=say):
        trade_files.read_trade_files(spark, str(tmp_path), SCHEMA).collect()


def test_bytes_of_no_encoding(tmp_path):
    with pytest.raises(ValueError, match="x.csv: not valid in any of utf-8"):
        trade_files.decode(b"\xff\xfe\xff", "x.csv", ["utf-8"])
    assert trade_files.decode("买".encode("gbk"), "x") == "买" and trade_files.decode("﻿a".encode("utf-8"), "x") == "a"
