"""Sources: folders of documents, exported page trees, stored tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.contracts import CONTRACTS, empty
from graphloom.functions.text import WS, squeeze, title_case

EXTENSIONS = ("pdf", "docx", "pptx", "html", "htm", "md", "txt")
PAGE = (
    "page_id string, title string, space_key string, version int, content_hash string, sanitized_text string, "
    "metadata struct<headings:array<struct<level:int,text:string>>>, stored_at string, is_deleted boolean"
)


def _file_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Path, modified, length, extension of the files below a folder with one of the extensions, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(*extensions))


def folder_documents(spark: SparkSession, folder: str, now: str) -> DataFrame:
    """raw_documents of a folder; the id is the file's name without extension."""
    name = _file_name(F.col("path"))
    return discover(spark, folder).select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), name.alias("document_name"), F.col("path").alias("source_path"), F.lit(now).alias("ingested_at")
    )


def plain_to_markdown(text: Column, stem: Column) -> Column:
    """A text as it is if it starts with ``#``, else under a title made of the file's name."""
    title = title_case(F.translate(stem, "_-", "  "))
    return F.when(F.regexp_replace(text, f"^{WS}+", "").startswith("#"), text).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


def html_to_markdown(data: bytes) -> str:
    """Headings, list items, table rows and paragraphs of an HTML page."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.skip = 0

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag in ("script", "style"):
                self.skip += 1
            elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag == "tr":
                self.out.append("\n|")
            elif tag in ("p", "div", "ul", "ol", "table", "section"):
                self.out.append("\n\n")
            elif tag == "br":
                self.out.append("\n")

        def handle_endtag(self, tag: str) -> None:
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("td", "th"):
                self.out.append(" |")
            elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                self.out.append("\n\n")

        def handle_data(self, text: str) -> None:
            if not self.skip:
                text = re.sub(r"\s+", " ", text)
                start = not self.out or self.out[-1].endswith(("\n", " "))
                self.out.append(text.lstrip() if start else text)

    p = Parser()
    p.feed(data.decode("utf-8", "replace"))
    lines = [x.rstrip() for x in "".join(p.out).split("\n")]
    out: list[str] = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    return "\n".join(out).strip()


#: How a file's bytes become Markdown; formats that need a library are added by the caller.
Converter = Callable[[bytes], str]
CONVERTERS: dict[str, Converter] = {"md": lambda b: b.decode("utf-8", "replace"), "html": html_to_markdown, "htm": html_to_markdown}


def extract(spark: SparkSession, folder: str, now: str, converters: dict[str, Converter] | None = None) -> tuple[DataFrame, DataFrame]:
    """Markdown of all files of a folder, and the rejected ones (source_path, error).

    A file whose format has no converter, or whose converter fails, is rejected and stops nothing.
    """
    known = CONVERTERS | (converters or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, ext, data in zip(part.path, part.extension, part.content, strict=True):
                text, error = None, None
                try:
                    if ext == "txt":
                        text = bytes(data).decode("utf-8", "replace")
                    elif ext in known:
                        text = known[ext](bytes(data))
                    else:
                        error = f"no converter for {ext}"
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append((path, ext, text, error))
            yield pd.DataFrame(out, columns=["path", "extension", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(*EXTENSIONS))
    done = files.mapInPandas(run, "path string, extension string, text string, error string")
    name = _file_name(F.col("path"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    markdown = F.when(F.col("extension") == "txt", plain_to_markdown(F.col("text"), stem)).otherwise(F.col("text"))
    good = done.where("error is null").select(stem.alias("document_id"), name.alias("document_name"), F.col("path").alias("source_path"), F.lit(now).alias("ingested_at"), markdown.alias("markdown"))
    return good, done.where("error is not null").select(F.col("path").alias("source_path"), "error")


def clean_page(text: Column, title: Column) -> Column:
    """Without macro remains, white space squeezed, and without the title repeated at the end."""
    clean = squeeze(F.regexp_replace(text, r"MAC\d+(?:true|false)", " "))
    ends = (title != "") & F.endswith(clean, title)
    return F.when(ends, F.rtrim(F.left(clean, F.length(clean) - F.length(title)))).otherwise(clean)


def mark_headings(text: Column, headings: Column) -> Column:
    """Each heading's first occurrence set on a line of its own as a heading; blank or absent ones are passed over."""

    def step(t: Column, h: Column) -> Column:
        at = F.instr(t, F.coalesce(h["text"], F.lit("")))
        mark = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.when(F.coalesce(h["level"], F.lit(0)) == 0, 1).otherwise(h["level"])), F.lit(" "), h["text"], F.lit("\n\n"))
        after = F.substring(t, at + F.char_length(h["text"]), F.char_length(t))
        return F.when((F.coalesce(h["text"], F.lit("")) != "") & (at > 0), F.concat(F.left(t, at - 1), mark, after)).otherwise(t)

    return F.aggregate(F.coalesce(headings, F.array().cast("array<struct<level:int,text:string>>")), text, step)


def page_markdown(pages: DataFrame) -> Column:
    """A page's title as heading and its cleaned text with headings."""
    body = mark_headings(clean_page(F.coalesce(pages["sanitized_text"], F.lit("")), pages["title"]), pages["metadata.headings"])
    return F.concat(F.lit("# "), pages["title"], F.lit("\n\n"), body)


def page_documents(spark: SparkSession, folder: str, now: str) -> DataFrame:
    """Raw documents of an exported page tree with their Markdown; deleted pages are left out.

    One JSON file a page below ``pages``; the folder it lies in names its parent page, none directly below ``pages``.
    """
    read = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    pages = read.json(f"{folder}/pages").withColumn("path", F.col("_metadata.file_path")).where("not coalesce(is_deleted, false)")
    parent = F.element_at(F.split("path", "/"), -2)
    return pages.select(
        F.col("page_id").alias("document_id"), F.col("title").alias("document_name"), F.col("path").alias("source_path"), F.lit(now).alias("ingested_at"),
        F.nullif(parent, F.lit("pages")).alias("parent_page_id"), "space_key", "content_hash", "version", page_markdown(pages).alias("markdown"),
    )


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table, or an empty one of its contract where nothing is stored yet.

    If a run ended between the two steps that put a new table in the place of an old one, the new one, which was
    complete by then, is put there.
    """
    try:
        return spark.read.parquet(f"{root}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        for kind in ("new", "old"):
            left = [x.getPath() for x in fs.globStatus(path(f"{root}/{table}.{kind}-*")) or () if kind == "old" or fs.exists(path(x.getPath(), "_SUCCESS"))]
            if left and fs.globStatus(path(f"{root}/{table}.old-*")):
                fs.rename(left[-1], path(f"{root}/{table}"))
                return spark.read.parquet(f"{root}/{table}")
        if table not in CONTRACTS:
            raise
        return empty(spark, table)
