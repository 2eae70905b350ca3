"""Section-aware chunking of Markdown: sections by heading, blocks by line state, chunks by packing blocks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import WS, strip, token_count

MAX_TOKENS, OVERLAP_TOKENS = 800, 100
PATH_SEPARATOR = " > "
_HEADING = f"^(#{{1,6}}){WS}+(.*)$"
_LIST = f"^({WS}*[-*+]{WS}+|{WS}*[0-9]+[.)]{WS}+)"


def lines(docs: DataFrame, key: str = "document_id", text: str = "markdown") -> DataFrame:
    """document_id, line_no, line, level (null: no heading), title: the lines of every text; null texts have none."""
    split = docs.select(F.col(key).alias("document_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    is_heading = F.col("line").rlike(f"(?s){_HEADING}")
    return split.select(
        "*",
        F.when(is_heading, F.length(F.regexp_extract("line", "^(#+)", 1))).alias("level"),
        F.when(is_heading, strip(F.regexp_replace("line", f"^#{{1,6}}{WS}+", ""))).alias("title"),
    )


def with_sections(lines_: DataFrame) -> DataFrame:
    """T-2: adds section_no (headings up to the line) and section (array of titles, outermost first, skipped levels left out).

    Deeper titles end with a heading of a lower level; text before the first heading has an empty path; headings
    count inside code too. One window over each document, in line order.
    """
    w = Window.partitionBy("document_id").orderBy("line_no")
    out = lines_.withColumn("section_no", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))
    titles: list[Column] = []
    for k in range(1, 7):
        last = F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w)
        cut = F.coalesce(F.last(F.when(F.col("level") < k, F.col("line_no")), ignorenulls=True).over(w), F.lit(-1))
        titles.append(F.when(last["line_no"] > cut, last["title"]))
    path = F.filter(F.array(*titles), lambda t: t.isNotNull() & (t != ""))
    return out.withColumn("section", path)


def blocks(docs: DataFrame, key: str = "document_id", text: str = "markdown") -> DataFrame:
    """T-4: document_id, section_no, section, block_no, block: paragraphs, lists and tables, never cut inside.

    A blank line ends a paragraph, but after a list or table it only ends that state, so what follows joins the block;
    a table starts a new block only after a paragraph, a list never does, an indented line stays with its list or table.
    """
    body = with_sections(lines(docs, key, text)).where("level is null")
    bare = strip(F.col("line"))
    kind = (
        F.when(bare == "", "B").when(bare.startswith("|"), "T").when(F.col("line").rlike(_LIST), "L").when(F.col("line").rlike("^[ \t]"), "I").otherwise("X")
    )
    w = Window.partitionBy("document_id", "section_no").orderBy("line_no")
    body = body.withColumn("kind", kind)
    # the state after a line: a table, a list, or neither; an indented line keeps it
    state = F.last(F.when(F.col("kind") == "I", None).when(F.col("kind").isin("T", "L"), F.col("kind")).otherwise("N"), ignorenulls=True).over(w)
    body = body.withColumn("state", F.coalesce(state, F.lit("N")))
    body = body.withColumn("prev", F.coalesce(F.lag("state").over(w), F.lit("N")))
    ends = (F.col("kind").isin("B", "T") & (F.col("prev") == "N")) | ((F.col("kind") == "X") & (F.col("prev") != "N"))
    body = body.withColumn("block_no", F.sum(ends.cast("int")).over(w)).where("not (kind = 'B' and prev = 'N')")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = body.groupBy("document_id", "section_no", "block_no").agg(strip(joined).alias("block"), F.first("section").alias("section"))
    return out.where("block <> ''").select("document_id", "section_no", "section", "block_no", "block")


def pack(tokens: list[int], max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """T-5: chunks of whole blocks as ranges of their numbers, from the blocks' token counts.

    A chunk ends before the block that would exceed the limit and once the limit is reached; the next one starts with
    the last blocks worth the overlap. A block over the limit is kept whole and is its own overlap.
    """
    upto = [0, *accumulate(tokens)]
    out, first = [], 0

    def close(end: int) -> int:
        """The next chunk's first block: the last one from which on the overlap is reached."""
        out.append((first, end))
        return end if overlap_tokens <= 0 else max(first, bisect_right(upto, upto[end] - overlap_tokens, hi=end) - 1)

    for i in range(len(tokens)):
        if first < i and upto[i + 1] - upto[first] > max_tokens:
            first = close(i)
        if upto[i + 1] - upto[first] >= max_tokens:
            first = close(i + 1)
    if first < len(tokens):
        out.append((first, len(tokens)))
    return out


def _packer(max_tokens: int, overlap_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, contents = [], [], []
            for row, items in enumerate(batch.column("items").to_pylist()):
                for k, (a, b) in enumerate(pack([x["tokens"] for x in items], max_tokens, overlap_tokens)):
                    rows.append(row)
                    number.append(k)
                    contents.append("\n\n".join(x["block"] for x in items[a:b]))
            kept = batch.select(["document_id", "section_no", "section"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int32()), pa.array(contents, pa.string())], names=["document_id", "section_no", "section", "k", "content"])

    return run


def chunk_documents(docs: DataFrame, key: str = "document_id", text: str = "markdown", max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, min_tokens: int = 0, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """T-3, T-6, T-7: chunk_id, document, section_path, content, token_count of all documents.

    Chunks never span sections and are numbered through a document. A section without a path is named after its
    document. Documents without a block, null or empty ones have no chunk. Keys are unique and not null. With
    ``min_tokens`` smaller chunks are left out. T-1: ``count`` gives the tokens of a text column, such as a pandas_udf
    over a tokenizer; the word rule by default.
    """
    b = blocks(docs, key, text).withColumn("tokens", count(F.col("block")))
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("block_no", "block", "tokens"))), lambda x: F.struct(x["block"].alias("block"), x["tokens"].alias("tokens"))
    )
    per_section = b.groupBy("document_id", "section_no").agg(items.alias("items"), F.first("section").alias("section"))
    kinds = {f.name: f.dataType.simpleString() for f in per_section.schema}
    kind = ", ".join(f"{c} {kinds[c]}" for c in ("document_id", "section_no", "section")) + ", k int, content string"
    packed = per_section.select("document_id", "section_no", "section", "items").mapInArrow(_packer(max_tokens, overlap_tokens), kind)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("section_no", "k")) - 1
    out = packed.select(
        F.format_string("%s_chunk_%04d", F.col("document_id"), number).alias("chunk_id"),
        F.col("document_id").alias("document"),
        F.coalesce(F.nullif(F.array_join("section", PATH_SEPARATOR), F.lit("")), F.col("document_id").cast("string")).alias("section_path"),
        "content",
    ).withColumn("token_count", count(F.col("content")))
    return out.where(F.col("token_count") >= min_tokens) if min_tokens else out
