"""Column expressions on names and texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph import schemas

WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def _lookup(key: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    pairs = chain.from_iterable((F.lit(e), F.lit(name)) for name, group in groups.items() for e in group)
    return F.create_map(*pairs)[key]


def extension(filename: Column) -> Column:
    """Text after the last dot, lower-cased; '' without a dot."""
    return F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))


def classify_files(df: DataFrame, filename: str = "filename") -> DataFrame:
    """df with doc_type (default document), language (default c) and parser (null if none takes the file)."""
    ext = extension(F.col(filename))
    return df.withColumns({"doc_type": F.coalesce(_lookup(ext, schemas.DOC_TYPE_OF), F.lit("document")), "language": F.coalesce(_lookup(ext, schemas.LANGUAGE_OF), F.lit("c")), "parser": _lookup(ext, schemas.PARSER_OF)})


def parse_tags(c: Column) -> Column:
    """Comma-separated tags: trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def estimate_tokens(c: Column) -> Column:
    """A quarter for each ASCII character and one and a half for each other, cut to an int."""
    other = F.length(F.regexp_replace(c, r"[\x00-\x7F]+", ""))
    return ((F.length(c) - other) / F.lit(4.0) + other * F.lit(1.5)).cast("int")


def chunk_preview(c: Column) -> Column:
    """The first 80 characters on one line; dots follow where 80 are left after trimming."""
    short = strip(F.replace(F.substring(F.coalesce(c, F.lit("")), 1, 80), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(short) == 80, F.concat(short, F.lit("..."))).otherwise(short)


def markdown_title(filename: Column, content: Column) -> Column:
    """The level-one heading that opens the text, else the file name."""
    title = strip(F.regexp_extract(content, r"(?Udm)\A#\s+(.+)$", 1))
    return F.when(title != "", title).otherwise(filename)


def extract_title(df: DataFrame, filename: str = "filename", content: str = "content", parser: str = "parser") -> DataFrame:
    """df with title: from a heading where the text parser reads the file, else the file name."""
    return df.withColumn("title", F.when(F.col(parser) == "text", markdown_title(F.col(filename), F.col(content))).otherwise(F.col(filename)))


def page_titles(pages: DataFrame, key: str, order: str, text: str, filename: str) -> DataFrame:
    """(key, title): the first line of the first page with text, if it is short and not blank, else the file name."""
    first = pages.where(strip(F.col(text)) != "").groupBy(key).agg(F.min_by(text, order).alias("__t"))
    line = F.split(strip(F.col("__t")), "\n")[0]
    names = pages.groupBy(key).agg(F.first(filename).alias("__f"))
    title = F.when((F.length(line) < 200) & (strip(line) != ""), strip(line))
    return names.join(first, key, "left").select(key, F.coalesce(title, F.col("__f")).alias("title"))


def heading_titles(paras: DataFrame, key: str, order: str, text: str, filename: str, is_heading: str = "is_heading") -> DataFrame:
    """(key, title): the first heading paragraph, else the file name."""
    return paras.groupBy(key).agg(F.coalesce(F.min_by(strip(F.col(text)), F.when(F.col(is_heading), F.col(order))), F.first(filename)).alias("title"))


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def document_metadata(df: DataFrame) -> DataFrame:
    """df (filename, content, language, parser and, if it has one, metadata) with language, lines and format in metadata.

    What the parser says replaces what metadata had; other fields stay.
    """
    ext, name = extension(F.col("filename")), F.col("parser")
    said = {
        "language": F.when(name == "code", F.col("language")),
        "lines": F.when(name == "code", line_count(F.col("content"))),
        "format": F.when(name == "text", F.when(ext == "md", "markdown").otherwise("plaintext")).when(name == "config", ext),
    }
    had = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast(schemas.DOCUMENT_METADATA)
    fields = [F.coalesce(said[f.name], had[f.name]).alias(f.name) if f.name in said else had[f.name].alias(f.name) for f in schemas.DOCUMENT_METADATA.fields]
    return df.withColumn("metadata", F.struct(*fields))


def assemble_text(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, content): pieces with text, in order, joined by a blank line."""
    own = pieces.where(strip(F.col(text)) != "")
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return own.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("content"))
