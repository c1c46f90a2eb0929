"""Chunks, references, calls and titles of small files, worked out by hand."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators import chunking, codetext, extract

C = """
#include <math.h>
#include "valve.h"

struct tank level_of(struct tank *t, double inflow) {
    t->height = inflow / area(t->radius);
    open_valve(t->outlet);
}

static double area(double radius) {
    while (radius < 0) {
        radius += 1;
    }
    return pow(radius, 2);
}
"""
PYTHON = """
from csv import reader
import time

def totals(path):
    rows = reader(open(path))
    return {month: sum(days) for month, days in rows}

class Gauge:
    def __init__(self, name):
        self.name = name

    def report(self, path):
        self.check(path)
        print(totals(path).items())
"""
MARKDOWN = """# Rain gauges

Where they stand and how they are read.

## Reading
Every hour, by `totals.py`, see [the plan](docs/plan.txt).

### At night
Twice.

## Repair
Ask first.
"""
INI = "[gauge]\ninterval = 3600\n; spare\n[tank]\nradius = 2.5\n"
KICAD = """
(kicad_sch (version 1)
  (symbol "Sensor:Rain" (property "Reference" "U7" (property "Value" "MAX31865")))
  (symbol "Device:C" (property "Footprint" "x") (property "Reference" "C3" (property "Value" "100n")))
  (symbol "Device:C" (property "Reference" "C4" (property "Value" "1u")))
  (global_label "ADC2_RAIN")
  (label "VALVE_OPEN")
)
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("c", "tank.c", C), ("p", "totals.py", PYTHON), ("m", "gauges.md", MARKDOWN), ("i", "station.ini", INI), ("k", "station.kicad_sch", KICAD), ("x", "unknown.xyz", "text"), ("n", "empty.md", None)]
    return text.classify_files(spark.createDataFrame(rows, "document_id string, filename string, content string"))


def test_classify(files):
    got = {r["document_id"]: (r["doc_type"], r["language"], r["parser"]) for r in files.collect()}
    assert got["c"] == ("source_code", "c", "code")
    assert got["p"] == ("source_code", "python", "code")
    assert got["k"][0] == "schematic"
    assert got["x"] == ("document", "c", None)


def test_corpus_chunks(files):
    by = {}
    for r in chunking.chunk_corpus(files).orderBy("document_id", "chunk_index").collect():
        by.setdefault(r["document_id"], []).append(r)
    assert set(by) == {"c", "p", "m", "i", "k"}
    assert [(r["metadata"]["type"], r["metadata"]["function"], r["metadata"]["start_line"], r["metadata"]["end_line"]) for r in by["c"]] == [("header", None, None, None), ("function", "level_of", 5, 9), ("function", "area", 10, 16)]
    assert by["c"][0]["content"] == '#include <math.h>\n#include "valve.h"'
    assert by["c"][2]["content"].startswith('// File: tank.c\n#include <math.h>\n#include "valve.h"\n\nstatic double area(double radius) {\n')
    assert [r["metadata"]["function"] for r in by["p"]] == ["totals", "__init__", "report"]
    assert [r["metadata"]["heading_chain"] for r in by["m"]] == [["Rain gauges"], ["Rain gauges", "Reading"], ["Rain gauges", "Reading", "At night"], ["Rain gauges", "Repair"]]
    assert by["m"][3]["content"] == "[Rain gauges > Repair]\n\n## Repair\nAsk first."
    assert [r["content"] for r in by["i"]] == ["# Configuration file: station.ini\n\n" + INI]
    assert [(r["metadata"]["group"], r["metadata"]["designators"]) for r in by["k"]] == [("U", ["U7"]), ("C", ["C3", "C4"]), (None, None)]
    assert by["k"][1]["content"] == "## Capacitors (2 components)\n  C3: 100n\n  C4: 1u"
    assert by["k"][2]["content"] == "## Signals and Nets\nADC2_RAIN, VALVE_OPEN"


def test_references(files):
    refs = {(r["document_id"], r["ref"]) for r in extract.code_references(files.where("parser = 'code'")).collect()}
    assert refs == {("c", "math.h"), ("c", "valve.h"), ("p", "csv")}
    assert [r["ref"] for r in extract.link_references(files.where("document_id = 'm'")).orderBy("pos").collect()] == ["docs/plan.txt", "totals.py"]
    board = files.where("document_id = 'k'")
    components, signals = extract.schematic_components(board), extract.schematic_signals(board)
    assert [(r["designator"], r["value"]) for r in components.orderBy("pos").collect()] == [("U7", "MAX31865"), ("C3", "100n"), ("C4", "1u")]
    assert {r["ref"] for r in extract.schematic_references(components, signals).collect()} == {"max31865", "adc2_rain"}


def test_calls(files):
    edges = extract.call_edges(files.where("parser = 'code'"))
    got = {(r["document_id"], r["caller"], r["callee"], r["is_complete"]) for r in edges.collect()}
    python = {("totals", "reader"), ("totals", "open"), ("totals", "sum"), ("report", "print"), ("report", "totals"), ("report", "items"), ("__init__", None)}
    assert got == {("p", a, b, True) for a, b in python} | {("c", "level_of", "area", False), ("c", "level_of", "open_valve", False), ("c", "area", "pow", False)}
    assert [r["calls"] for r in extract.calls_of(edges, "report").collect()] == [["items", "print", "totals"]]


def test_title(files):
    got = {r["document_id"]: r["title"] for r in text.extract_title(files).collect()}
    assert got["m"] == "Rain gauges" and got["c"] == "tank.c" and got["n"] == "empty.md"


#: What the scans by offset must find, as patterns that are slow on long texts.
PATTERNS = {
    "c": r"^(?:\w[\w\s\*]+)\s+(\w+)\s*\([^)]*\)\s*\{",
    "cpp": r"^(?:\w[\w\s\*:&<>]+)\s+(\w+(?:::\w+)?)\s*\([^)]*\)\s*(?:const\s*)?\{",
    "java": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",
}
PIECES = ["int ", "void ", "f", "g1", "(", ")", "{", "}", "\n", "\n\n", " ", "  ", "*", "&", "::", "<", ">", "A<B>", "static ", "public ", "const ", "for ", ";", ",", "\t", "\r\n", "\u00e9", "_"]


@pytest.mark.parametrize("language", sorted(PATTERNS))
def test_function_starts_equal_patterns(language):
    rng = random.Random(3)
    for _ in range(5000):
        code = "".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
        want = [(m.start(), m[1]) for m in re.finditer(PATTERNS[language], code, re.M)]
        assert list(codetext.FUNCTION_STARTS[language](code)) == want, code


@pytest.mark.parametrize("piece", ["plain words only here\n", "int f(int a) {\n    go(a);\n}\n", "f((((", "List<int foo\n", "\n", '(symbol "a" (property "Reference" "R1"\n', "Designator=R{}\n", "# a\n", "foo (\n"])
def test_time_grows_with_the_text(piece):
    def took(size):
        code = "".join(piece.replace("{}", str(i)) for i in range(size // len(piece)))
        began = time.process_time()
        for language in ("c", "cpp", "java"):
            codetext.functions(code, language, "f")
        for one in (codetext.sections, codetext.paragraphs, codetext.calls_by_pattern, codetext.kicad_components, codetext.listed_components):
            one(code)
        return time.process_time() - began

    took(1 << 16)
    assert took(1 << 18) < 12 * took(1 << 16) + 1


def test_control_words_start_no_function():
    code = "int f(int a) {\n    for (i = 0; i < a; i++) {\n        go(i);\n    }\n}\n"
    assert codetext.calls_by_pattern(code) == [("f", ["go"], False)]
    assert [x[0] for x in codetext.calls_by_pattern(code, reference_spans=True)] == ["for"]


def test_value_of_the_first_designator_that_starts_alike():
    assert codetext.listed_components("Designator=R10|Value=1K\nDesignator=R1|Value=2K\n") == [("R10", "1K", None), ("R1", "1K", None)]


def test_packed_paragraphs_rejoin():
    rng = random.Random(1)
    paras = ["x" * rng.randint(1, 900) for _ in range(50)]
    chunks = codetext.paragraphs("\n\n".join(paras))
    assert "\n\n".join(c for c, _ in chunks).split("\n\n") == paras
    assert all(len(c.replace("\n\n", "")) <= 2000 for c, _ in chunks)


def test_line_blocks_rejoin():
    rng = random.Random(2)
    lines = [rng.choice(["", "a", "b c"]) for _ in range(500)]
    chunks = codetext.blocks("\n".join(lines), "c", "f.c")
    assert [x for c, _ in chunks for x in c.split("\n") if x] == [x for x in lines if x]


def test_empty_tables(spark, files):
    none = files.where("1 = 0")
    assert chunking.chunk_corpus(none).count() == 0
    assert extract.call_edges(none).count() == 0
    assert text.assemble_text(none.withColumn("pos", F.lit(1)), "document_id", "pos", "content").count() == 0


def test_filename_mentions_query_reads_whole_notes(spark, tmp_path):
    from corpusgraph.queries import QUERIES

    rows = [(1, "Start in src/main.py,\nthen drv\\uart.h and src/main.py; see example.com", "en", "web"), (2, "nothing", "en", "web"), (3, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["document_id"], r["pos"], r["ref"]) for r in QUERIES["x3_filename_mentions"](spark, str(tmp_path)).collect())
    assert got == [("n1", 0, "src/main.py"), ("n1", 1, "drv\\uart.h"), ("n1", 2, "mod_1.c"), ("n2", 0, "mod_2.c")]
