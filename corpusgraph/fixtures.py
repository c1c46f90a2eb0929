"""Views that turn the driver's tables into files with code, headings, links and parts: one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"

CODE = f"""
select 'c' || cast(p_partkey as string) as id, 'mod_' || cast(p_partkey as string) || '.c' as title, 'source_code' as doc_type,
  '#include <stdio.h>' || {_NL} || '#include "mod_' || cast((7 * p_partkey + 3) % 200 as string) || '.h"' || {_NL} || {_NL} || '// ' || p_name || {_NL}
  || 'int mod_' || cast(p_partkey as string) || '_init(int a) {{' || {_NL} || '    return mod_' || cast((7 * p_partkey + 3) % 200 as string) || '_init(a + ' || cast(p_size as string) || ');' || {_NL} || '}}' || {_NL} || {_NL}
  || 'int spi' || cast(p_partkey % 4 as string) || '_send(int a) {{' || {_NL} || '    return ' || case when p_partkey % 3 = 0 then 'gpio_write(a)' else 'log_note(a)' end || ';' || {_NL} || '}}' || {_NL} as content,
  p_partkey as n
from part
"""
HEADERS = f"""
select 'h' || cast(p_partkey as string) as id, 'mod_' || cast(p_partkey as string) || '.h' as title, 'source_code' as doc_type,
  'int mod_' || cast(p_partkey as string) || '_init(int a);' || {_NL} as content, p_partkey + 1000000 as n
from part
"""
CPP = f"""
select 'k' || cast(p_partkey as string) as id, 'tank_' || cast(p_partkey as string) || '.cpp' as title, 'source_code' as doc_type,
  '#include <vector>' || {_NL} || '#include "mod_' || cast(p_partkey % 50 as string) || '.hpp"' || {_NL} || {_NL} || '// ' || p_name || {_NL}
  || 'int Tank' || cast(p_partkey % 7 as string) || '::fill(int a) const {{' || {_NL} || '    return pump_' || cast(p_size as string) || '(a);' || {_NL} || '}}' || {_NL} || {_NL}
  || 'void drain_' || cast(p_partkey as string) || '(std::vector<int>& a) {{' || {_NL} || '    close_all(a);' || {_NL} || '}}' || {_NL} as content, p_partkey as n
from part
"""
JAVA = f"""
select 'j' || cast(p_partkey as string) as id, 'Tank' || cast(p_partkey as string) || '.java' as title, 'source_code' as doc_type,
  'import java.util.List;' || {_NL} || 'import parts.mod_' || cast(p_partkey % 50 as string) || ';' || {_NL} || {_NL} || '// ' || p_name || {_NL}
  || 'public static int fill_' || cast(p_partkey as string) || '(int a) {{' || {_NL} || '    return pump_' || cast(p_size as string) || '(a);' || {_NL} || '}}' || {_NL}
  || 'private List<String> names(int a) {{' || {_NL} || '    return read_all(a);' || {_NL} || '}}' || {_NL} as content, p_partkey as n
from part
"""
KICAD = f"""
select 'y' || cast(s_suppkey as string) as id, 'main_' || cast(s_suppkey as string) || '.kicad_sch' as title, 'schematic' as doc_type,
  '(kicad_sch' || {_NL} || '(symbol "Device:R" (property "Reference" "R' || cast(s_suppkey % 9 as string) || '") (property "Value" "' || cast(s_nationkey as string) || 'K"))' || {_NL}
  || '(symbol "MCU:STM32" (property "Reference" "U' || cast(s_suppkey as string) || '") (property "Value" "STM32F' || cast(s_nationkey as string) || '"))' || {_NL}
  || '(label "NET_' || cast(s_suppkey % 5 as string) || '")' || {_NL} || '(global_label "SPI1_CS' || cast(s_nationkey as string) || '"))' || {_NL} as content, s_suppkey as n
from supplier
"""
NOTES = f"""
select 'n' || cast(doc_id as string) as id, 'note_' || cast(doc_id as string) || '.md' as title, 'document' as doc_type,
  '# Note ' || cast(doc_id as string) || {_NL} || {_NL} || '## Overview' || {_NL} || replace(text, {_NL}, {_NL} || {_NL}) || {_NL} || {_NL} || '## Links' || {_NL}
  || 'See `mod_' || cast(doc_id % 200 as string) || '.c` and [peer](notes/note_' || cast((3 * doc_id + 1) % 200 as string) || '.md)' || {_NL} as content,
  doc_id as n, lang, source
from documents
"""
BOARDS = f"""
select 'b' || cast(s_suppkey as string) as id, 'board_' || cast(s_suppkey as string) || '.sch' as title, 'schematic' as doc_type,
  'Designator=R' || cast(s_suppkey % 7 + 1 as string) || '|Value=10K' || {_NL} || 'Designator=U' || cast(s_suppkey as string) || '|Value=STM32F' || cast(s_suppkey as string) || {_NL}
  || 'NetName=SPI' || cast(s_suppkey % 4 as string) || '_MOSI' || {_NL} || 'NetName=GPIO_WRITE' || {_NL} as content, s_suppkey as n
from supplier
"""
#: Vectors as chunks of documents, ten to each.
CHUNKS = "select 'v' || cast(label * 5 + vec_id % 5 as string) as document_id, cast(vec_id as int) as chunk_index, 'chunk ' || cast(vec_id as string) as content, embedding from embeddings"
PIECES = "select cast(conv_id as string) as document_id, cast(turn as int) as pos, text, role = 'user' as is_heading from conversations"
CORPUS = f"select id, title, doc_type, content, n from ({CODE}) a union all select id, title, doc_type, content, n from ({HEADERS}) b union all select id, title, doc_type, content, n from ({NOTES}) c union all select id, title, doc_type, content, n from ({BOARDS}) d"
#: Relations by rule of arithmetic, some of them with themselves and both ways.
EDGES = """
select 'n' || cast(doc_id as string) as source_id, 'n' || cast((doc_id * 7 + doc_id % 3) % 200 as string) as target_id, case doc_id % 4 when 0 then 'references' when 1 then 'depends_on' else 'related_to' end as relation_type,
  'edge ' || cast(doc_id as string) as description, cast(doc_id % 10 as double) / 10 as confidence
from documents
union all select 'n' || cast((doc_id * 7 + doc_id % 3) % 200 as string), 'n' || cast(doc_id as string), 'references', 'back ' || cast(doc_id as string), cast(0.5 as double) from documents where doc_id % 8 = 0
"""
TAGS = "select 'n' || cast(doc_id as string) as document_id, lang as tag from documents where lang is not null union all select 'n' || cast(doc_id as string), source from documents where source is not null"

#: Tables whose short rows become whole files, and how many rows of them a task has at most.
DEALT, ROWS_AT_ONCE = frozenset({"part", "supplier"}), 10_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the rows of a short one are dealt to tasks by number, as few bytes of it are many files' work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in DEALT:
        return df
    n = df.count()  # of the files' footers
    parts = max(-(-n // ROWS_AT_ONCE), min(n // 1000, spark.sparkContext.defaultParallelism))
    return df.repartition(parts) if parts > 1 else df


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a view over the driver's tables."""
    names = [t for t in ("part", "supplier", "documents", "embeddings", "conversations", "benchmark", "pages", "labels") if t in sql.replace("(", " ").replace(")", " ").split()]
    return spark.sql(_bound(sql, names), **{t: _read(spark, sf_dir, t) for t in names})


def _bound(sql: str, names: list[str]) -> str:
    import re

    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in names:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    return sql
