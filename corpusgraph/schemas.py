"""Closed vocabularies and table schemas."""

from pyspark.sql import types as T

DOC_TYPES = ("source_code", "document", "schematic", "note")
RELATION_TYPES = ("references", "implements", "depends_on", "related_to", "derived_from")

#: What each file extension is.
DOC_TYPE_OF = {
    "source_code": ("c", "h", "cpp", "hpp", "java", "py", "js", "ts", "rs", "go"),
    "document": ("md", "txt", "pdf", "doc", "docx", "ini", "cfg", "conf", "json", "yaml", "yml"),
    "schematic": ("sch", "schdoc", "kicad_sch", "brd", "pcbdoc"),
}
LANGUAGE_OF = {"c": ("c", "h", "js", "ts", "rs", "go"), "cpp": ("cpp", "hpp", "cc", "cxx"), "java": ("java",), "python": ("py",)}
PARSER_OF = {
    "code": ("c", "h", "cpp", "hpp", "cc", "cxx", "java", "py", "js", "ts", "rs", "go"),
    "text": ("md", "txt", "rst"),
    "config": ("ini", "cfg", "conf", "json", "yaml", "yml"),
    "pages": ("pdf",),
    "paragraphs": ("docx", "doc"),
    "schematic": ("sch", "schdoc", "kicad_sch", "brd", "pcbdoc"),
}
#: Schematics whose parts and signals are read; the other kinds are boards.
DRAWN = ("sch", "schdoc", "kicad_sch")
#: Extensions that a directory scan takes.
SCANNED = tuple(e for group in DOC_TYPE_OF.values() for e in group)

DOCUMENT_METADATA = T.StructType([T.StructField(n, t) for n, t in (
    ("original_filename", T.StringType()), ("size_bytes", T.LongType()), ("language", T.StringType()), ("lines", T.IntegerType()), ("format", T.StringType()), ("pages", T.IntegerType()),
    ("call_graph", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), ("components_count", T.IntegerType()), ("nets_count", T.IntegerType()),
    ("components", T.ArrayType(T.StringType())), ("signals", T.ArrayType(T.StringType())), ("references", T.ArrayType(T.StringType())), ("extra", T.MapType(T.StringType(), T.StringType())),
)])

CHUNK_METADATA = T.StructType([T.StructField(n, t) for n, t in (
    ("type", T.StringType()), ("language", T.StringType()), ("file", T.StringType()), ("function", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()),
    ("calls", T.ArrayType(T.StringType())), ("heading_chain", T.ArrayType(T.StringType())), ("section", T.StringType()), ("heading", T.StringType()),
    ("start_page", T.IntegerType()), ("end_page", T.IntegerType()), ("group", T.StringType()), ("designators", T.ArrayType(T.StringType())),
)])
