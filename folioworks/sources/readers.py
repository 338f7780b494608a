"""Readers for document files and paged JSON listings, and writers for packages and reports.

Files are read by the binaryFile source and unpacked in ``mapInPandas``; a damaged file gives no row, or, where the schema has one, a
null. Nothing is fetched over a network here: a paged source gets its pages from a function or a folder.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Spine members in reading order: path, pos, item_id, href, media_type, title, text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
                    opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
                    package = ElementTree.fromstring(z.read(opf))
                    items = {e.get("id"): e for e in package.iter() if e.tag.endswith("}item") or e.tag == "item"}
                    refs = [e.get("idref") for e in package.iter() if e.tag.split("}")[-1] == "itemref"]
                    for i, ref in enumerate(refs):
                        item = items.get(ref)
                        if item is None:
                            continue
                        text = z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.get("href")))).decode("utf-8", "replace")
                        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
                        rows.append((p, i + 1, ref, item.get("href"), item.get("media-type"), title and title[1].strip(), text))
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "pos", "item_id", "href", "media_type", "title", "text"])

    return _files(spark, path, "*.epub").mapInPandas(read, "path string, pos int, item_id string, href string, media_type string, title string, text string")


def epub_resources(spark: SparkSession, path: str) -> DataFrame:
    """All other members with their digests: path, name, size, content."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    rows += [(p, n, z.getinfo(n).file_size, z.read(n)) for n in sorted(z.namelist()) if not n.endswith((".xhtml", ".html", ".opf", ".ncx", "/", "mimetype", "container.xml"))]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "size", "content"])

    return _files(spark, path, "*.epub").mapInPandas(read, "path string, name string, size long, content binary")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs in order: path, pos, style, text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for i, para in enumerate(root.iter(_W + "p")):
                    style = para.find(f"{_W}pPr/{_W}pStyle")
                    rows.append((p, i + 1, None if style is None else style.get(_W + "val"), "".join(t.text or "" for t in para.iter(_W + "t"))))
            yield pd.DataFrame(rows, columns=["path", "pos", "style", "text"])

    return _files(spark, path, "*.docx").mapInPandas(read, "path string, pos int, style string, text string")


def docx_chapters(paragraphs: DataFrame) -> DataFrame:
    """Chapters: a heading starts one, text before the first is chapter 0, chapters without a body are dropped."""
    from folioworks.operators.ordering import runs_by_heading

    heading = F.coalesce(F.col("style").rlike("(?i)^heading"), F.lit(False))
    runs = runs_by_heading(paragraphs.withColumn("is_heading", heading), "path", "pos", F.col("is_heading"))
    body = F.when(~F.col("is_heading") & (F.trim("text") != ""), F.struct("pos", "text"))
    g = runs.groupBy("path", "run").agg(F.min(F.when(F.col("is_heading"), F.struct("pos", "text")))["text"].alias("title"), F.array_sort(F.collect_list(body)).alias("b"))
    return g.where(F.size("b") > 0).select("path", F.col("run").alias("chapter_no"), "title", F.transform("b", lambda x: x["text"]).alias("paragraphs"))


_RTF_TOKEN = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
# Destinations whose text is not part of the body.
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata"}


def rtf_text(raw: str) -> str:
    """The body text of an RTF file."""
    out, stack, skip, after = [], [], False, 0
    for m in _RTF_TOKEN.finditer(raw):
        word, arg, hexa, char, brace, text = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif char == "*" or word in _RTF_SKIP:
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and arg:
            out.append(chr(int(arg) % 65536))
            after = 1
        elif hexa:
            out.append("" if after else bytes.fromhex(hexa).decode("cp1252", "replace"))
            after = 0
        elif char and char in "\\{}":
            out.append(char)
        elif char == "~":
            out.append("\u00a0")
        elif text:
            out.append(text[1:] if after and text[:1] == "?" else text)
            after = 0
    return "".join(out).strip()


def rtf_documents(spark: SparkSession, path: str, title: Column | None = None) -> DataFrame:
    """path, title, author, text; the title is the override, the file's own, its first line, or the file name."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = [bytes(c).decode("cp1252", "replace") for c in pdf["content"]]
            info = lambda f: [(m := re.search(rf"\{{\\{f} ([^{{}}]*)\}}", r)) and m[1].strip() or None for r in raw]
            yield pd.DataFrame({"path": pdf["path"], "own": info("title"), "author": info("author"), "text": [rtf_text(r) for r in raw]})

    rows = _files(spark, path, "*.rtf").mapInPandas(read, "path string, own string, author string, text string")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    first_line = F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit(""))
    return rows.select("path", F.coalesce(title if title is not None else F.lit(None).cast("string"), F.col("own"), first_line, stem).alias("title"), "author", "text")


class PagedListing(DataSource):
    """A listing read page by page, one partition per listing, until a short or missing page or the page limit.

    Options: path (a folder with files <listing>-<page>.json), listings (comma list), list_key, page_size, max_pages.
    Rows: listing, page, pos, record (JSON text). Registered as 'paged_listing'.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "listing string, page int, pos int, record string"

    def reader(self, schema: object) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x.strip()) for x in self.options["listings"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import os

        size, most = int(self.options.get("page_size", 50)), int(self.options.get("max_pages", 5))
        for page in range(1, most + 1):
            file = os.path.join(self.options["path"], f"{partition.value}-{page}.json")
            if not os.path.exists(file):
                return
            with open(file, encoding="utf-8") as f:
                records = json.load(f).get(self.options.get("list_key", "data")) or []
            for i, r in enumerate(records):
                yield (partition.value, page, i + 1, json.dumps(r))
            if len(records) < size:
                return


def write_packages(chapters: DataFrame, target: str, book: str, name: str, text: str) -> DataFrame:
    """One ZIP per book with its files in path order, written beside its place and moved there; returns book, path, n_files.

    ``target`` must be a folder that all executors share.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        b = str(pdf[book].iloc[0])
        final, staged = os.path.join(target, f"{b}.epub"), os.path.join(target, f".{b}.{os.getpid()}.part")
        with zipfile.ZipFile(staged, "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
            for n, t in sorted(zip(pdf[name], pdf[text])):
                z.writestr(zipfile.ZipInfo(n), t, zipfile.ZIP_DEFLATED)
        with zipfile.ZipFile(staged) as z:
            if z.testzip() is not None:
                raise OSError(f"{staged} is damaged")
        os.replace(staged, final)
        return pd.DataFrame({book: [pdf[book].iloc[0]], "path": [final], "n_files": [len(pdf)]})

    return chapters.groupBy(book).applyInPandas(write, f"{book} {dict(chapters.dtypes)[book]}, path string, n_files long")


def markdown_report(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One Markdown table of few rows, as one row with column report."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__l")))), lambda x: x["__l"]), "\n")
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.agg(F.concat(F.lit(head), body).alias("report"))


def stop_rule(fetch: Callable[[int], list], size: int, most: int) -> Iterator[tuple[int, list]]:
    """Pages of a listing until a short one or the limit."""
    for page in range(1, most + 1):
        got = fetch(page)
        yield page, got
        if len(got) < size:
            return
