"""Keys taken from texts: references, signals, components, keywords, call edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions.batches import map_slices
from corpusgraph.functions.text import extension
from corpusgraph.operators import codetext

#: Include and import targets by language.
INCLUDE = r'(?U)#include\s*[<"]([^>"]+)[>"]'
JAVA_IMPORT = r"(?Udm)^import\s+([\w.]+);"
PYTHON_IMPORT = r"(?Udm)^(?:from\s+([\w.]+)\s+)?import\s+([\w.,\s]+)"
#: Markdown links, file names between backticks and in plain text, and the kinds that count in plain text.
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
QUOTED_FILE = r"(?U)`([^`]+\.\w{1,5})`"
MENTION = r"(?U)[\w/\\]+\.\w{1,5}"
MENTIONED_KINDS = r"\.(?:c|h|py|java|sch|pdf)$"
#: Labels of KiCad files, net names of others.
LABEL = r'(?U)\(label\s+"([^"]+)"'
GLOBAL_LABEL = r'(?U)\(global_label\s+"([^"]+)"'
NET = r"(?iU)(?:NetName|Net)=(\w+)"
#: Names of buses, and of chip families whose drivers are named after them.
BUS_SIGNAL = r"(?U)\b(SPI\d?_\w+|I2C\d?_\w+|UART\d?_\w+|GPIO_\w+|ADC\d?_\w+|TIM\d+_\w+)\b"
CHIP = r"(?i)^(?:STM32|ESP32|ATmega|PIC|nRF|MAX|LM|TI|AD[0-9])"
BUS = r"^(?:SPI|I2C|UART|USART|CAN|USB|ADC|DAC|TIM|GPIO)"


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _exploded(docs: DataFrame, refs: Column) -> DataFrame:
    return docs.select("document_id", F.posexplode(F.filter(refs, lambda r: r != "")).alias("pos", "ref"))


def _filled(refs: Column) -> Column:
    return F.filter(refs, lambda r: r != "")


def code_targets(text: Column, language: Column) -> Column:
    """Include and import targets in order; null for other languages."""
    return _filled(F.when(language.isin("c", "cpp"), _all(text, INCLUDE)).when(language == "java", _all(text, JAVA_IMPORT)).when(language == "python", _all(text, PYTHON_IMPORT)))


def link_targets(text: Column) -> Column:
    """Targets of Markdown links, then file names between backticks."""
    return _filled(F.concat(_all(text, LINK, 2), _all(text, QUOTED_FILE)))


def code_references(docs: DataFrame) -> DataFrame:
    """(document_id, pos, ref): include and import targets in order. docs: document_id, content, language."""
    return _exploded(docs, code_targets(F.col("content"), F.col("language")))


def link_references(docs: DataFrame) -> DataFrame:
    """(document_id, pos, ref): targets of Markdown links, then file names between backticks."""
    return _exploded(docs, link_targets(F.col("content")))


def filename_mentions(docs: DataFrame) -> DataFrame:
    """(document_id, pos, ref): different file names of known kinds in plain text, in order of their first mention."""
    found = F.filter(_all(F.col("content"), MENTION, 0), lambda r: r.rlike(MENTIONED_KINDS))
    return _exploded(docs, F.array_distinct(found))


def _rows(docs: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    kind = docs.schema["document_id"].dataType
    full = T.StructType([T.StructField("document_id", kind), *T._parse_datatype_string(schema).fields])
    names = [f.name for f in full.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.document_id, *x) for r in batch.itertuples(index=False) for x in make(r)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return map_slices(docs.where(F.col("content").isNotNull()).select("document_id", *columns), run, full)


def schematic_components(docs: DataFrame) -> DataFrame:
    """(document_id, pos, designator, value, lib) of schematics, in order. docs: document_id, filename, content."""

    def make(r) -> list[tuple]:
        kicad = r.filename.lower().endswith(".kicad_sch")
        found = codetext.kicad_components(r.content) if kicad else codetext.listed_components(r.content)
        return [(i, *c) for i, c in enumerate(found)]

    return _rows(docs, ["filename", "content"], "pos int, designator string, value string, lib string", make)


def signal_names(text: Column, kicad: Column) -> Column:
    """Sorted different labels of KiCad files, net and bus names of other schematics."""
    labels = F.concat(_all(text, LABEL), _all(text, GLOBAL_LABEL))
    nets = F.concat(_all(text, NET), _all(text, BUS_SIGNAL))
    return F.array_sort(F.array_distinct(F.when(kicad, labels).otherwise(nets)))


def schematic_signals(docs: DataFrame) -> DataFrame:
    """(document_id, signal), each once: labels of KiCad files, net and bus names of other schematics."""
    return docs.select("document_id", F.explode(signal_names(F.col("content"), extension(F.col("filename")) == "kicad_sch")).alias("signal"))


def schematic_references(components: DataFrame, signals: DataFrame) -> DataFrame:
    """(document_id, ref): part values of known chip families and signals of known buses, lower-cased, each once."""
    parts = components.where(F.col("value").rlike(CHIP)).select("document_id", F.lower("value").alias("ref"))
    buses = signals.where(F.col("signal").rlike(BUS)).select("document_id", F.lower("signal").alias("ref"))
    return parts.unionByName(buses).distinct()


def match_keywords(components: DataFrame, signals: DataFrame) -> DataFrame:
    """(document_id, keyword): parts of signal names and designators, of three characters and more, lower-cased, each once."""
    parts = signals.select("document_id", F.explode(F.split("signal", r"[_\d]+")).alias("keyword"))
    names = components.select("document_id", F.col("designator").alias("keyword"))
    return parts.unionByName(names).where(F.length("keyword") >= 3).select("document_id", F.lower("keyword").alias("keyword")).distinct()


def call_edges(docs: DataFrame, reference_spans: bool = False) -> DataFrame:
    """(document_id, pos, caller, callee, is_complete): calls of each function; callee is null where one calls nothing.

    Python files by their syntax tree (complete), others by patterns. pos is the function's place in the file.
    """

    def make(r) -> list[tuple]:
        python = r.filename.lower().endswith(".py")
        found = codetext.calls_by_tree(r.content) if python else codetext.calls_by_pattern(r.content, reference_spans)
        return [(i, name, callee, complete) for i, (name, calls, complete) in enumerate(found) for callee in calls or [None]]

    return _rows(docs, ["filename", "content"], "pos int, caller string, callee string, is_complete boolean", make)


def _last_definition(edges: DataFrame) -> DataFrame:
    """(document_id, caller, calls): sorted callees; of functions with one name the last counts."""
    by = edges.groupBy("document_id", "caller", "pos").agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    return by.groupBy("document_id", "caller").agg(F.max_by("calls", "pos").alias("calls"))


def attach_calls(chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with metadata.calls, (document_id, call_graph)): each function chunk and document with its calls."""
    calls = _last_definition(edges)
    graph = calls.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "calls")))).alias("call_graph"))
    named = calls.select("document_id", F.col("caller").alias("__function"), F.col("calls").alias("__calls"))
    joined = chunks.withColumn("__function", F.col("metadata.function")).join(named, ["document_id", "__function"], "left")
    return joined.withColumn("metadata", F.col("metadata").withField("calls", F.coalesce("__calls", "metadata.calls"))).drop("__function", "__calls"), graph


def calls_of(edges: DataFrame, function: str) -> DataFrame:
    """(document_id, calls) of one function, its first definition in each document."""
    own = edges.where(F.col("caller") == function).groupBy("document_id", "pos").agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    return own.groupBy("document_id").agg(F.min_by("calls", "pos").alias("calls"))


def summary_text(filename: Column, components: Column, signals: Column) -> Column:
    """A searchable summary of a schematic: components (designator, value, lib), sorted signals.

    KiCad files list the library of each component and the number of nets.
    """
    kicad = extension(filename) == "kicad_sch"
    plain = F.array_join(F.transform(components, lambda c: F.concat(F.lit("  "), c["designator"], F.lit(": "), c["value"])), "\n")
    with_lib = F.array_join(F.transform(components, lambda c: F.concat(F.lit("  "), c["designator"], F.lit(": "), c["value"], F.lit(" ("), c["lib"], F.lit(")"))), "\n")
    nets = F.when(kicad, F.concat(F.lit("## Nets/Signals ("), F.size(signals).cast("string"), F.lit("):\n"))).otherwise(F.lit("## Signals:\n"))
    return F.concat(F.lit("# Schematic: "), filename, F.lit("\n\n## Components ("), F.size(components).cast("string"), F.lit("):\n"), F.when(kicad, with_lib).otherwise(plain), F.lit("\n\n"), nets, F.array_join(signals, ", "), F.lit("\n"))


def schematic_summary(components: DataFrame, signals: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, content, components_count, nets_count, components, signals) of every file: its summary."""
    item = F.struct("pos", "designator", "value", "lib")
    cs = components.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("cs"))
    ns = signals.groupBy("document_id").agg(F.array_sort(F.collect_set("signal")).alias("ns"))
    rows = files.select("document_id", "filename").join(cs, "document_id", "left").join(ns, "document_id", "left")
    rows = rows.select("document_id", "filename", F.coalesce("cs", F.array().cast("array<struct<pos:int,designator:string,value:string,lib:string>>")).alias("cs"), F.coalesce("ns", F.array().cast("array<string>")).alias("ns"))
    return rows.select("document_id", summary_text(F.col("filename"), F.col("cs"), F.col("ns")).alias("content"), F.size("cs").alias("components_count"), F.size("ns").alias("nets_count"), F.transform("cs", lambda c: c["designator"]).alias("components"), F.col("ns").alias("signals"))
