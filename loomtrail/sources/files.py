"""Files as tables: an inventory with text, lines, JSON lines by number, and office formats.

Bytes come from Spark's binaryFile reader, so any store that Spark reads will do; a task holds one file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix and type (fixed values).
MIME = {
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "png": "image/png",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "odt": "application/vnd.oasis.opendocument.text",
}
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def _plain(xml: str, breaks: str) -> str:
    text = re.sub(r"<[^>]+>", "", re.sub(breaks, "\n", xml))
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return text.strip("\n")


def _sheet(archive: zipfile.ZipFile) -> str:
    """The first sheet's rows, cells joined by tabs, in the order of their columns."""
    names = archive.namelist()
    shared = [_plain(x, "(?!)") for x in re.findall(r"(?s)<si>(.*?)</si>", archive.read("xl/sharedStrings.xml").decode())] if "xl/sharedStrings.xml" in names else []
    first = min(n for n in names if n.startswith("xl/worksheets/sheet"))
    rows = []
    for row in re.findall(r"(?s)<row\b[^>]*>(.*?)</row>", archive.read(first).decode()):
        cells = []
        for head, body in re.findall(r"(?s)<c\b([^>]*)>(.*?)</c>", row):
            column = re.search(r'r="([A-Z]+)', head)
            value = _plain("".join(re.findall(r"(?s)<(?:v|t)[^>]*>(.*?)</(?:v|t)>", body)), "(?!)")
            cells.append((len(column[1]) if column else 0, column[1] if column else "", shared[int(value)] if 't="s"' in head else value))
        rows.append("\t".join(v for *_, v in sorted(cells)))
    return "\n".join(rows)


def _pdf(data: bytes) -> str:
    """Strings that text operators show, of plain and deflated streams."""
    out = []
    for raw in re.findall(rb"(?s)stream\r?\n(.*?)\r?\nendstream", data):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for show in re.findall(rb"(?s)(\((?:\\.|[^\\)])*\)\s*Tj|\[.*?\]\s*TJ)", raw):
            out.append("".join(re.sub(rb"\\(.)", rb"\1", s).decode("latin-1") for s in re.findall(rb"(?s)\(((?:\\.|[^\\)])*)\)", show)))
    return "\n".join(out)


def extract(name: str, data: bytes) -> str | None:
    """The text of a file by its suffix; null for other formats and for bytes that are not text."""
    suffix = name.rpartition(".")[2].lower() if "." in name else ""
    if suffix in ("docx", "xlsx", "odt"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                if suffix == "xlsx":
                    return _sheet(archive)
                return _plain(archive.read("word/document.xml" if suffix == "docx" else "content.xml").decode(), r"</(?:w:p|text:p|text:h)>")
        except (zipfile.BadZipFile, LookupError, ValueError):
            return None if b"\0" in data else _strict(data)
    if suffix == "pdf":
        return _pdf(data)
    if suffix in ("", "txt", "md", "csv", "json"):
        text = _strict(data)
        return data.decode("latin-1") if text is None else text
    return None


def _strict(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, name, mime, size, sha256, content and lines of each file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [extract(n, c) for n, c in zip(pdf["name"], pdf["raw"], strict=True)]
            yield pdf.drop(columns="raw").assign(content=text)

    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    rows = files.select("path", name.alias("name"), kinds[suffix].alias("mime"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("raw"))
    out = rows.mapInPandas(each, "path string, name string, mime string, size long, sha256 string, content string")
    return out.withColumn("lines", F.when(F.col("content").isNotNull(), F.size(F.split(F.regexp_replace("content", "\n$", ""), "\n"))).cast("long"))


def lines(files: DataFrame) -> DataFrame:
    """path, number (from 1) and text of each line."""
    return files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("number", "line")).withColumn("number", F.col("number") + 1)


def json_lines(files: DataFrame, schema: str, tolerant: bool = False) -> DataFrame:
    """path, number and record of each line that is not blank; a broken line is an error, or skipped if ``tolerant``."""
    rows = lines(files).where(F.trim("line") != "")
    record = F.from_json("line", schema, {"mode": "PERMISSIVE" if tolerant else "FAILFAST"})
    out = rows.select("path", "number", record.alias("record"))
    return out.where(F.to_json("record") != "{}") if tolerant else out


def contiguous(rows: DataFrame, by: str, index: str) -> DataFrame:
    """Groups whose index does not run 0, 1, 2, ...: none if the contract holds."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(index).alias("first"), F.max(index).alias("last"), F.countDistinct(index).alias("kinds")).where("first <> 0 or last <> n - 1 or kinds <> n")


def png_size(content: Column) -> Column:
    """Width and height from a PNG header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def json_line(files: DataFrame, uri: str, schema: str) -> DataFrame:
    """The record that a ``path#line=N`` names; no row if there is none."""
    path, _, number = uri.partition("#line=")
    return json_lines(files.where(F.col("path").endswith(path)), schema).where(F.col("number") == int(number)).select("record.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file that holds a JSON object over any number of lines; a broken file is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; without a schema all columns are texts."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def sample_rows(df: DataFrame, order: list[str], n: int, most: int = 120) -> DataFrame:
    """The first ``n`` rows as texts, cut to ``most`` characters; bytes are shown by their number."""
    shown = []
    for field in df.schema:
        c = F.col(field.name)
        cut = F.when(F.length(c.cast("string")) > most, F.concat(F.substring(c.cast("string"), 1, most), F.lit("…"))).otherwise(c.cast("string"))
        shown.append((F.concat(F.lit("<"), F.length(c), F.lit(" bytes>")) if field.dataType.typeName() == "binary" else cut).alias(field.name))
    return df.orderBy(*order).limit(n).select(*shown)


def seed_tables(seeds: DataFrame) -> DataFrame:
    """Rows of seeds (tbl, columns array<string>, rows array<array<string>>): tbl, place and a mapping of columns to values."""
    each = seeds.select("tbl", "columns", F.posexplode("rows").alias("place", "cells"))
    wide = F.when(F.size("cells") != F.size("columns"), F.raise_error(F.concat(F.lit("a row of "), "tbl", F.lit(" has other cells than columns"))).cast("map<string,string>")).otherwise(F.map_from_arrays("columns", "cells"))
    return each.select("tbl", "place", wide.alias("row"))


def top_folders(files: DataFrame, root: str, folders: list[str]) -> DataFrame:
    """Files below the given top folders of ``root``, with the folder."""
    below = F.regexp_extract("path", rf"\Q{root.rstrip('/')}\E/([^/]+)/", 1)
    return files.withColumn("folder", below).where(F.col("folder").isin(folders))


def lookup(files: DataFrame, names: DataFrame, home: str) -> DataFrame:
    """Files by name (name), where ``file:`` in front, and ``~`` or nothing for the home folder, are understood."""
    plain = F.regexp_replace(F.col("name"), "^file:(//)?", "")
    path = F.when(plain.startswith("~/"), F.concat(F.lit(home), F.substring(plain, 2, 1 << 20))).when(~plain.startswith("/"), F.concat(F.lit(f"{home}/"), plain)).otherwise(plain)
    wanted = names.select("name", path.alias("_p"))
    return wanted.join(files.drop("name").withColumn("_p", F.regexp_replace("path", "^file:(//)?", "")), "_p", "left").drop("_p")


def folder_table(files: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Folder names as columns: the groups of ``pattern``, found in the path; other files are left out."""
    found = [F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return files.where(F.col("path").rlike(pattern)).select(*found, *files.columns)


def nested_entities(documents: DataFrame, ident: str, json: str, paths: dict[str, str], id_field: str) -> DataFrame:
    """Entities in JSON documents: for each kind the members of the list at its path, with an id from a field or else their place."""
    out = []
    for kind, path in paths.items():
        items = F.from_json(F.get_json_object(json, path), "array<string>")
        each = documents.select(F.col(ident), F.posexplode(items).alias("place", "item"))
        key = F.coalesce(F.get_json_object("item", f"$.{id_field}"), F.col("place").cast("string"))
        out.append(each.select(ident, F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), key).alias("entity"), "item"))
    first, *others = out
    for df in others:
        first = first.unionByName(df)
    return first


def task_list(tasks: DataFrame, origin: str, world: str, required: list[str]) -> DataFrame:
    """Tasks of an origin and a world; one that lacks a required field is an error."""
    mine = tasks.where((F.col("origin") == origin) & (F.col("world") == world))
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    bad = F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.lit("a task lacks "), F.array_join(lacks, ", "))).cast("string"))
    return mine.withColumn("_bad", bad).where(F.col("_bad").isNull()).drop("_bad")
