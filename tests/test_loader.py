"""Records of delimited files: line feeds in cells, ragged rows, open quotes."""

import csv
import io
import random

import pytest

from docketlake.sources import loader, records

HEAD = "case_status,employer_name,job_title\n"


def write(folder, name, body, head=HEAD):
    path = folder / name
    path.write_text(head + body, newline="")
    return str(path)


def names(df):
    return sorted((r["case_status"], r["employer_name"], r["job_title"]) for r in df.collect())


def test_four_rows(spark, tmp_path):
    """A plain row, a cell with a line feed, a short row and one with a surplus cell."""
    path = write(tmp_path, "LCA_FY2022_Q4.csv", 'Certified,A,Clerk\nCertified,B,"Chief\nengineer"\nCertified,C\nDenied,D,Cook,x\n')
    loaded = loader.load(spark, [path], "lca")
    assert names(loaded.rows) == [("Certified", "A", "Clerk"), ("Certified", "B", "Chief\nengineer")]
    rejects = {r["record"]: (r["file"].rsplit("/")[-1], r["reason"]) for r in loaded.rejects.collect()}
    assert rejects == {
        "Certified,C": ("LCA_FY2022_Q4.csv", "short record: 2 of 3 cells"),
        "Denied,D,Cook,x": ("LCA_FY2022_Q4.csv", "surplus cells: 4 of 3 cells")}
    gate = {r["name"]: (r["value"], r["ok"]) for r in loader.parse_gate(loader.file_report(spark, [path], "lca")).collect()}
    assert gate == {"unparsed_cells": (0, True), "rejected_records": (2, False)}


def test_a_clean_file_passes_its_gate(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'Certified,"A, ""the"" B",x\r\n\r\nDenied,,\r\n')
    loaded = loader.load(spark, [path], "lca")
    assert names(loaded.rows.fillna("-")) == [("Certified", 'A, "the" B', "x"), ("Denied", "-", "-")]
    assert loaded.rejects.count() == 0
    assert all(r["ok"] for r in loader.parse_gate(loader.file_report(spark, [path], "lca")).collect())


def test_quoted_header_with_a_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Certified,A,x", '﻿"case_status","Employer_Name", job_title\n')
    assert names(loader.load_files(spark, [path], "lca")) == [("Certified", "A", "x")]


def test_any_cells_over_small_splits(spark, tmp_path):
    """What a CSV writer wrote comes back, however the files are split."""
    rng = random.Random(4)
    cells = ["plain", "with, comma", 'say "so"', "two\nlines", "\n\n\n", 'mixed\n"quoted", lines\nand more', "", "é\n", "x" * 300]
    paths, want = [], []
    for k in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for _ in range(200):
            row = [rng.choice(["Certified", "Denied"]), rng.choice(cells), rng.choice(cells)]
            writer.writerow(row)
            want.append(tuple(c or "-" for c in row))
        paths.append(write(tmp_path, f"LCA_FY202{k}_Q1.csv", out.getvalue()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        known = records.splits(spark, paths)
        assert len(known.headers) == 3 and len(known.within_quotes) > 10
        loaded = loader.load(spark, paths, "lca")
        assert names(loaded.rows.fillna("-")) == sorted(want)
        assert loaded.rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_quote_that_never_closes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 20)
    body = "Certified,A,x\n" + 'Certified,"B,x\n' + "Certified,C,x\n" * 100
    other = write(tmp_path, "b.csv", "Certified,D,x\n")
    path = write(tmp_path, "a.csv", body)
    loaded = loader.load(spark, [path, other], "lca")
    assert names(loaded.rows) == [("Certified", "A", "x"), ("Certified", "D", "x")]
    assert {r["reason"] for r in loaded.rejects.collect()} == {records.UNCLOSED} and loaded.rejects.count() == 101
    short = write(tmp_path, "c.csv", 'Certified,"B,x\nCertified,C,x\n')
    rejects = loader.rejected(spark, [short], "lca").collect()
    assert [(r["reason"], r["record"]) for r in rejects] == [("quotes do not match", 'Certified,"B,x\nCertified,C,x')]


def test_files_without_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", "")
    assert loader.load_files(spark, [path], "lca").count() == 0
    assert loader.load(spark, [], "lca").rows.count() == 0


def test_an_unknown_column_is_named(spark, tmp_path):
    path = write(tmp_path, "a.csv", "x,y\n", "case_status,surprise\n")
    with pytest.raises(ValueError, match="surprise"):
        loader.load_files(spark, [path], "lca")


def test_plain_files_move_no_rows(spark, tmp_path):
    """Only lines of records over several lines pass an exchange."""
    path = write(tmp_path, "LCA FY2022 Q4 (final).csv", "Certified,A,x\n" * 50)
    rows = loader.load_files(spark, [path], "lca")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 50
