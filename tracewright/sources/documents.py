"""Document files to blocks: format dispatch, descriptors, and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.text import collapsed, digest
from tracewright.operators.corpus import row_text

#: Suffixes that can be read, and their media types.
MEDIA_TYPES = {"md": "text/markdown", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
#: Suffixes that other packages would be needed for.
NEEDS_PACKAGE = ("pdf", "docx", "xlsx")


class UnsupportedFormat(ValueError):
    """Files whose format can't be read here."""


def read_files(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """``doc_id, path, suffix, media_type, sha256, content`` of the files below ``path``.

    Suffixes that no reader knows, and files of over ``most`` bytes, which no row can hold, are refused before any content is read, with how many files have them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if large := files.filter(F.col("length") > most).select("path", "length").limit(5).collect():
        raise UnsupportedFormat(f"files of over {most} bytes: {[(r['path'], r['length']) for r in large]}")
    named = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    unknown = {r["suffix"]: r["n"] for r in named.filter(~F.col("suffix").isin(*MEDIA_TYPES)).groupBy("suffix").agg(F.count("*").alias("n")).limit(100).collect()}
    if unknown:
        missing = sorted(set(unknown) & set(NEEDS_PACKAGE))
        raise UnsupportedFormat(f"no reader for {unknown}" + (f"; packages for {missing} are not installed" if missing else ""))
    media = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    sha = F.sha2("content", 256)
    return named.select(digest([F.element_at(F.split("path", "/"), -1), sha], 12).alias("doc_id"), "path", "suffix", media[F.col("suffix")].alias("media_type"), sha.alias("sha256"), "content")


def plain(text: Column) -> Column:
    """Without line breaks in markup, paired emphasis and code marks, and runs of white space."""
    out = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")
    for mark in (r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"(?<![A-Za-z0-9])_([^_]+)_(?![A-Za-z0-9])"):
        out = F.regexp_replace(out, mark, "$1")
    return collapsed(out)


def markdown_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, block_no, kind, heading_path, text`` of Markdown texts.

    A heading, each bullet with the lines that go on below it, and each table row is a block of its own; other lines
    up to a blank one are a paragraph. A row repeats its table's header as ``label: value``; rule rows are left
    out. The heading path of a block holds the last heading of each level above it that no higher one has ended.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line"))
    blank, heading = F.col("line").rlike(r"^\s*$"), F.col("line").rlike(r"^#{1,6}\s+\S")
    bullet, row = F.col("line").rlike(r"^\s*([-*+]|[0-9]+[.)])\s+\S"), F.col("line").rlike(r"^\s*\|.*\|\s*$")
    kind = F.when(blank, "blank").when(heading, "heading").when(bullet, "list").when(row, "table").otherwise("text")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("kind", kind).withColumn("before", F.lag("kind", 1, "blank").over(order))
    # Text goes on in the paragraph or bullet above it; everything else begins a block.
    starts = (F.col("kind") != "text") | F.col("before").isin("blank", "heading", "table")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    table_starts = (F.col("kind") == "table") & (F.col("before") != "table")
    marked = marked.withColumns({"block_no": F.sum(starts.cast("int")).over(up_to), "table_no": F.sum(table_starts.cast("int")).over(up_to), "level": F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))})
    title = F.struct(F.col("level").alias("level"), plain(F.regexp_replace("line", r"^#{1,6}\s+|\s+#*$", "")).alias("title"))
    for level in range(1, 7):
        # The last heading of this level, unless one of a higher level came after it.
        at = F.max(F.when((F.col("kind") == "heading") & (F.col("level") == level), F.col("line_no"))).over(up_to)
        above = F.max(F.when((F.col("kind") == "heading") & (F.col("level") < level), F.col("line_no"))).over(up_to)
        name = F.last(F.when((F.col("kind") == "heading") & (F.col("level") == level), title["title"]), ignorenulls=True).over(up_to)
        marked = marked.withColumn(f"h{level}", F.when(F.coalesce(at, F.lit(-1)) > F.coalesce(above, F.lit(-1)), name))
    path = F.filter(F.array(*[F.col(f"h{k}") for k in range(1, 7)]), lambda x: x.isNotNull())
    marked = marked.withColumn("heading_path", path).filter("kind <> 'blank'")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), plain)
    header = F.first("cells").over(Window.partitionBy("doc_id", "table_no").orderBy("line_no"))
    rows = marked.filter("kind = 'table'").withColumn("cells", cells).withColumn("header", header)
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("line_no"))).filter(r"row_no > 1 AND NOT line RLIKE '^[\\s|:-]+$'")
    named = F.transform("cells", lambda v, k: F.when(v != "", F.concat(F.coalesce(F.nullif(F.try_element_at("header", k + 1), F.lit("")), F.concat(F.lit("column "), (k + 1).cast("string"))), F.lit(": "), v)))
    tables = rows.select("doc_id", "block_no", F.lit("table").alias("kind"), "heading_path", F.array_join(F.filter(named, lambda x: x.isNotNull()), " | ").alias("text"))
    others = marked.filter("kind <> 'table'").groupBy("doc_id", "block_no").agg(F.min_by("kind", "line_no").alias("kind"), F.min_by("heading_path", "line_no").alias("heading_path"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: F.trim(x["line"])), " ")
    body = plain(F.regexp_replace(joined, r"^(#{1,6}\s+|([-*+]|[0-9]+[.)])\s+)", ""))
    others = others.select("doc_id", "block_no", F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")).alias("kind"), "heading_path", body.alias("text"))
    return others.unionByName(tables)


__all__ = ["UnsupportedFormat", "markdown_blocks", "plain", "read_files", "row_text"]
