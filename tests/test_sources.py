import gzip
import os

from pyspark.sql import functions as F
from wardline.operators.clean import cast_cols, dedupe_rows, require, strip_zeros
from wardline.sources.extracts import headers, list_files, normalise_header, read_extract, snake


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_extract_unions_by_name(spark, tmp_path):
    write(tmp_path / "1_Antiviral-COVID_a_DRG.xls", "Reference Key,Drug Name,Dispensing Date (yyyy-mm-dd)\n007,\"PAX, 150\",2022-03-01\n007,\"PAX, 150\",2022-03-01\n")
    write(tmp_path / "2_Antiviral-COVID_b_DRG.xls", "Reference Key,Dispensing Date (yyyy-mm-dd),Extra\n8,,x\n9,2022-03-02,y\n")
    write(tmp_path / "notes.txt", "nothing")
    folder = str(tmp_path)
    assert [os.path.basename(p) for p in list_files(spark, folder, "_Antiviral-COVID_.+DRG.+xls")] == [
        "1_Antiviral-COVID_a_DRG.xls", "2_Antiviral-COVID_b_DRG.xls"]
    raw = read_extract(spark, folder, "_Antiviral-COVID_.+DRG.+xls", with_order=True)
    df = normalise_header(raw, {"Dispensing Date (yyyy-mm-dd)": "dispensing_date"})
    assert df.columns == ["ref", "drug_name", "dispensing_date", "_ord", "extra"]
    assert set(t for c, t in df.dtypes if c != "_ord") == {"string"}
    rows = dedupe_rows(require(df, "dispensing_date")).orderBy("_ord").collect()
    assert [(r.ref, r.drug_name, r.dispensing_date, r.extra) for r in rows] == [
        ("007", "PAX, 150", "2022-03-01", None), ("9", None, "2022-03-02", "y")]
    typed = cast_cols(df, {"dispensing_date": "date"}).select(strip_zeros("ref").alias("k"), "dispensing_date")
    assert sorted((r.k, str(r.dispensing_date)) for r in typed.collect()) == [
        ("7", "2022-03-01"), ("7", "2022-03-01"), ("8", "None"), ("9", "2022-03-02")]


def test_column_choice_reaches_the_scan(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("a"), F.lit(1).alias("b")).write.parquet(str(tmp_path / "x.parquet"))
    df = read_extract(spark, str(tmp_path), "x", columns=["a"], format="parquet")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == ["a"] and "b#" not in plan.split("ReadSchema")[1]


def test_snake():
    assert snake("Admission.Date..yyyy.mm.dd.") == "admission_date_yyyy_mm_dd"


def test_compressed_files_missing_text_and_line_breaks(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt", encoding="utf-8") as f:
        f.write("\ufeffRef,Note\n1,NA\n2,\"NA \"\n3,\n")
    write(tmp_path / "b.csv", "Ref,Note,More\r\n4,\"two\nlines\",\"say \"\"x\"\"\"\r\n5,N,NA\r\n")
    write(tmp_path / "c.csv", "Ref,Note\n6,last\n")
    write(tmp_path / "d.csv", "")
    paths = list_files(spark, str(tmp_path), "csv")
    found = headers(spark, paths)
    assert {k: [os.path.basename(p) for p in v] for k, v in found.items()} == {
        ("Ref", "Note"): ["a.csv.gz", "c.csv"], ("Ref", "Note", "More"): ["b.csv"]}
    rows = read_extract(spark, str(tmp_path), "csv", line_breaks=True).orderBy("Ref").collect()
    assert [(r.Ref, r.Note, r.More) for r in rows] == [
        ("1", None, None), ("2", "NA ", None), ("3", None, None), ("4", "two\nlines", 'say "x"'), ("5", "N", None), ("6", "last", None)]


def test_headers_read_first_lines_only(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.csv", f"a,b{i}\n" + "1,2\n" * 200_000)
    assert sorted(headers(spark, list_files(spark, str(tmp_path), "csv"))) == [("a", f"b{i}") for i in range(3)]
