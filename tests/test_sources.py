"""Round trips of the file formats, labels, datasets, serialization and streams."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quadrat import serialize
from quadrat.design import Design
from quadrat.errors import DatasetError, SerializationError, SourceError
from quadrat.sample import Sample
from quadrat.sources import datasets, files, labelled, sav
from quadrat.streaming import watch_mean


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1.0, "a", 1, dt.date(2020, 2, 29), "x" * 300), (None, "", 2, None, ""), (-5.25, "ünï", 151, dt.date(1959, 12, 31), "y" * 700), (1e10, None, -99, dt.date(2000, 1, 1), None)]
    df = spark.createDataFrame(rows, "num double, txt string, code int, day date, note string")
    df = labelled.with_metadata(df, "num", label="A number")
    return labelled.with_metadata(df, "code", value_labels={"1": "one", "2": "two"})


@pytest.mark.parametrize("compress", [False, True, "zlib"])
def test_spss(spark, table, tmp_path, compress):
    path = str(tmp_path / "t.sav")
    files.write_spss(table, path, compress=compress, file_label="mine")
    df, labels = files.read_spss_with_labels(path, spark=spark)
    got = [tuple(r) for r in df.collect()]
    want = [(r["num"], r["txt"] or "", float(r["code"]), r["day"], r["note"] or "") for r in table.collect()]
    assert got == want
    assert labels["labels"]["num"] == "A number" and labels["value_labels"]["code"] == {1.0: "one", 2.0: "two"}
    assert [r[0] for r in files.read_spss(path, spark=spark, rows_skip=2, n_max=1, columns=["num"]).collect()] == [-5.25]
    assert files.create_from_spss(path, spark=spark).resolve_labels("code") == {1: "one", 2: "two"}
    with open(path, "rb") as f, pytest.raises(SourceError):
        sav.parse(f.read()[:150])


def test_spss_missing(spark, tmp_path):
    v = sav.Variable("v", missing=(9.0,), missing_range=(90.0, 99.0))
    path = tmp_path / "m.sav"
    path.write_bytes(sav.build(sav.Sav([v], [(1.0,), (9.0,), (95.0,), (None,)])))
    assert [r[0] for r in files.read_spss(str(path), spark=spark).collect()] == [1.0, None, None, None]
    kept = files.read_spss(str(path), spark=spark, user_na=True)
    assert [r[0] for r in kept.collect()] == [1.0, 9.0, 95.0, None]
    assert [r[0] for r in labelled.zap_missing(kept).collect()] == [1.0, None, None, None]


def test_portable(spark, tmp_path):
    def number(x):
        if x is None:
            return "*."
        digits, out, whole = "0123456789ABCDEFGHIJKLMNOPQRST", "", int(abs(x))
        while whole:
            out = digits[whole % 30] + out
            whole //= 30
        part, frac = abs(x) - int(abs(x)), ""
        for _ in range(10):
            part *= 30
            frac += digits[int(part)]
            part -= int(part)
        return ("-" if x < 0 else "") + (out or "0") + ("." + frac.rstrip("0") if frac.strip("0") else "") + "/"

    text = lambda s: number(len(s)) + s
    body = "A" + text("20200101") + text("000000") + "4" + number(2) + "5" + number(11)
    body += "7" + number(0) + text("NUM") + "".join(map(number, (5, 8, 2, 5, 8, 2))) + "8" + number(99.0) + "C" + text("A number")
    body += "7" + number(6) + text("TXT") + "".join(map(number, (1, 6, 0, 1, 6, 0)))
    body += "D" + number(1) + text("NUM") + number(1) + number(1.0) + text("one") + "F"
    body += "".join(number(x) + text(s) for x, s in ((1.0, "abc"), (-31.5, "d e"), (None, "f"), (99.0, "g"))) + "ZZZZZ"
    full = " " * 200 + "0" * 256 + "SPSSPORT" + body
    (tmp_path / "t.por").write_text("\n".join(full[k : k + 80].ljust(80) for k in range(0, len(full), 80)) + "\n")
    df = files.read_spss(str(tmp_path / "t.por"), spark=spark)
    assert [tuple(r) for r in df.collect()] == [(1.0, "abc"), (-31.5, "d e"), (None, "f"), (None, "g")]
    assert labelled.value_labels(df, "NUM") == {1.0: "one"} and df.schema["NUM"].metadata["label"] == "A number"


def test_stata(spark, table, tmp_path):
    path = str(tmp_path / "t.dta")
    files.write_stata(table.drop("day"), path, file_label="mine")
    df, labels = files.read_stata_with_labels(path, spark=spark)
    assert [r["code"] for r in df.collect()] == [1, 2, 151, -99] and df.collect()[2]["note"] == "y" * 700
    assert labels["labels"]["num"] == "A number" and labels["value_labels"]["code"] == {1.0: "one", 2.0: "two"}
    with pytest.raises(SourceError):
        files.read_stata(str(tmp_path / "none.dta"), spark=spark)


def test_sas(spark, table, tmp_path):
    path = str(tmp_path / "t.xpt")
    files.write_sas(table.select("num", "txt", "code"), path)
    df = files.read_sas(path, spark=spark)
    assert [r["num"] for r in df.collect()][2:] == [-5.25, 1e10] and [r["code"] for r in df.collect()] == [1.0, 2.0, 151.0, -99.0]
    assert df.schema["num"].metadata["label"] == "A number"
    with pytest.raises(SourceError):
        files.write_sas(table.withColumnRenamed("num", "much_too_long"), path)


def test_csv_and_parquet(spark, table, tmp_path):
    files.write_csv(table.select("num", "code"), str(tmp_path / "c"))
    files.write_parquet(table, str(tmp_path / "p"))
    assert files.read_csv(str(tmp_path / "c"), spark=spark).count() == 4
    assert files.create_from_parquet(str(tmp_path / "p"), Design(wgt="code"), spark=spark).n_records == 4


def test_labels(spark, table):
    assert [r["code"] for r in labelled.as_factor(table).collect()] == ["one", "two", "151", "-99"]
    assert [r["code"] for r in labelled.as_factor(table, levels="both").collect()][0] == "[1] one"
    assert labelled.value_labels(labelled.zap_labels(table), "code") == {}
    assert labelled.zap_empty(table).where("txt = ''").count() == 0
    na = labelled.tagged_na("b")
    assert math.isnan(na) and labelled.na_tag(na) == "b" and labelled.is_tagged_na(na, "b") and not labelled.is_tagged_na(math.nan)
    assert labelled.format_tagged_na(na) == "NA(b)" and labelled.labelled_spss([1, 9], na_values=[9]).is_missing(9)


def test_datasets(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "d"))
    datasets.register(datasets.Dataset("mine", str(tmp_path / "d")))
    assert datasets.load("mine", where={"code": [1, 2]}, select="num", spark=spark).columns == ["num"]
    assert datasets.load("mine", n=1, by="code", spark=spark).count() == 4
    assert [r["code"] for r in datasets.load("mine", n=2, order_by="code", order_type="descending", spark=spark).collect()] == [151, 2]
    with pytest.raises(DatasetError):
        datasets.load("other", spark=spark)


def test_serialization(spark):
    df = spark.range(40).selectExpr("id % 4 as h", "id % 8 as p", "cast(id as double) as y", "id % 2 as g")
    s = Sample(df, Design(stratum="h", psu="p"))
    s = s.set_data(df.withColumn("p", F.col("id") if "id" in df.columns else (F.col("y") / 4).cast("int")))
    for made, kind in ((s.estimation.mean("y"), "estimate"), (s.categorical.tabulate("g"), "table"), (s.glm.fit("y", x="g").fitted, "glm"), (s.describe("y"), "describe")):
        back = serialize.from_json(serialize.to_json(made), kind)
        assert back["kind"] == kind
    with pytest.raises(SerializationError):
        serialize.from_json("{}")


def test_stream(spark, tmp_path):
    df = spark.range(60).selectExpr("id % 3 as h", "cast(id / 6 as int) as p", "cast(id as double) as y")
    for k in range(2):
        df.where(F.col("y") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
    found = []
    q = watch_mean(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), Design(stratum="h", psu="p"), "y", lambda est, _: found.append(est.first()), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(60)
    want = Sample(df, Design(stratum="h", psu="p")).estimation.mean("y").rows()[0]
    assert found[-1]["est"] == pytest.approx(want["est"]) and found[-1]["se"] == pytest.approx(want["se"]) and found[-1]["df"] == want["df"]
