"""Files of each format, made here."""

from __future__ import annotations

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomtrail.sources import files, sinks


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "d" / "r.json").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n')
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>A &amp; B</w:t></w:p><w:p><w:t>C</w:t></w:p>")
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>x</t></si><si><t>y</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<row r="1"><c r="B1" t="s"><v>1</v></c><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>7</v></c></row>')
    (tmp_path / "p.pdf").write_bytes(b"stream\n" + zlib.compress(b"BT (Hello) Tj [(W) -3 (orld)] TJ ET") + b"\nendstream")
    (tmp_path / "broken.docx").write_text("plain after all")
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480))
    return str(tmp_path)


def test_inventory(spark, tree):
    got = {r.name: r for r in files.inventory(spark, tree).collect()}
    want = {"a.txt": "one\ntwo\n", "b.md": "é", "w.docx": "A & B\nC", "s.xlsx": "x\ty\n7", "p.pdf": "Hello\nWorld", "broken.docx": "plain after all", "i.png": None}
    assert {k: got[k].content for k in want} == want
    assert got["a.txt"].lines == 2 and got["a.txt"].size == 8 and got["i.png"].lines is None
    assert got["w.docx"].mime.endswith("wordprocessingml.document")


def test_json_lines(spark, tree):
    inv = files.inventory(spark, tree).where("name = 'r.json'")
    assert [(r.number, r.record.k) for r in files.json_lines(inv, "k int", tolerant=True).orderBy("number").collect()] == [(1, 1), (4, 2)]
    with pytest.raises(Exception):
        files.json_lines(inv, "k int").collect()


def test_contract_and_header(spark, tree):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 1)], "k string, i int")
    assert {r.k for r in files.contiguous(rows, "k", "i").collect()} == {"b", "c"}
    raw = spark.read.format("binaryFile").load(tree + "/i.png").select(files.png_size(F.col("content")).alias("s")).first().s
    assert (raw.width, raw.height) == (640, 480)


def test_more_sources(spark, tree, tmp_path):
    inv = files.inventory(spark, tree)
    assert [tuple(r) for r in files.json_line(inv.where("name = 'r.json'").withColumn("content", F.lit('{"k": 1}\n{"k": 2}')), "r.json#line=2", "k int").collect()] == [(2,)]
    (tmp_path / "doc.json").write_text('{"a": {"pets": [{"id": "x"}, {"name": "y"}]},\n "b": 1}')
    assert files.json_document(spark, str(tmp_path / "doc.json"), "b int").first().b == 1
    (tmp_path / "t.csv").write_text('a,b\n1,"two\n""lines"""\n')
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'two\n"lines"')]
    df = spark.createDataFrame([(2, "y" * 9, b"123"), (1, None, b"")], "i int, t string, b binary")
    assert [tuple(r) for r in files.sample_rows(df, ["i"], 5, most=4).collect()] == [("1", None, "<0 bytes>"), ("2", "yyyy…", "<3 bytes>")]
    seeds = spark.createDataFrame([("t", ["a", "b"], [["1", "2"], ["3", None]])], "tbl string, columns array<string>, rows array<array<string>>")
    assert [(r.place, r.row) for r in files.seed_tables(seeds).collect()] == [(0, {"a": "1", "b": "2"}), (1, {"a": "3", "b": None})]
    assert {r.name for r in files.top_folders(inv, tree, ["d"]).collect()} == {"r.json"}
    names = spark.createDataFrame([(f"file:{tree}/a.txt",), ("~/b.md",), ("no.txt",)], "name string")
    assert {r.name: r.content for r in files.lookup(inv, names, tree).collect()} == {f"file:{tree}/a.txt": "one\ntwo\n", "~/b.md": "é", "no.txt": None}
    assert [(r.folder, r.file) for r in files.folder_table(inv.select("path"), r"/(d)/([^/]+)$", ["folder", "file"]).collect()] == [("d", "r.json")]
    docs = spark.createDataFrame([(1, (tmp_path / "doc.json").read_text())], "i int, j string")
    assert [r.entity for r in files.nested_entities(docs, "i", "j", {"pet": "$.a.pets"}, "id").collect()] == ["pet:x", "pet:1"]
    tasks = spark.createDataFrame([("o", "w", "x", None), ("o", "v", None, 1)], "origin string, world string, text string, n int")
    assert files.task_list(tasks, "o", "w", ["text"]).count() == 1
    with pytest.raises(Exception, match="lacks n"):
        files.task_list(tasks, "o", "w", ["text", "n"]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x|y", None), (2, "a\tb", 3.5)], "k int, b string, a double")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":3.5,"b":"a\\tb","k":2}', '{"a":null,"b":"x|y","k":1}']
    with pytest.raises(Exception, match="already exists"):
        sinks.write_json_lines(df, str(tmp_path / "j"))
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "r"), ["k"])
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    cells = spark.createDataFrame([({"p": "1"},), ({"q": "2", "z": "9"},)], "c map<string,string>")
    sinks.write_ragged_csv(cells, "c", ["p", "q"], str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {("1", None), (None, "2")}
    assert {r.value for r in sinks.tsv_lines(df).collect()} == {"1\tx|y\t", "2\ta b\t3.5"}
    assert [r.value for r in sinks.markdown_table(df.select("k", "b"), ["k"]).orderBy("line").collect()] == ["| k | b |", "| --- | --- |", "| 1 | x\\|y |", "| 2 | a\tb |"]
    one = sinks.write_bundle(df, "k", str(tmp_path / "b"))
    two = sinks.write_bundle(df.withColumn("a", F.when(F.col("k") == 2, 4.5).otherwise(F.col("a"))), "k", str(tmp_path / "b2"))
    assert [r.k for r in sinks.changed_members(one, two, "k").collect()] == [2]
