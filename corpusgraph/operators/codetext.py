"""Structure of one text: where functions, sections, paragraphs and components are. Small helpers for tasks.

Everything works on character offsets: positions are found by scans that go forward only, turned into line numbers by
binary search, and cut out of the text as slices, so that the time grows with the text and not with its square.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate, groupby, islice

Chunk = tuple[str, dict]

#: What an import line begins with, in code other than Python, and in Python.
IMPORT_LINE = re.compile(r"^(?:#include|import|from .+ import).*", re.M)
PYTHON_IMPORT_LINE = re.compile(r"^(?:from .+ import|import ).*", re.M)
#: A Python and a script function's start, and what a call looks like.
PYTHON_START = re.compile(r"^(?:async\s+)?def\s+(\w+)\s*\(", re.M)
SCRIPT_START = re.compile(r"^function\s+(\w+)\s*\(", re.M)
CALL = re.compile(r"\b([a-zA-Z_][a-zA-Z0-9_]{1,64})\s*\(")
#: Names that look like calls or functions and are none.
NO_CALLS = frozenset({
    "if", "while", "for", "switch", "return", "sizeof", "defined", "include", "define", "undef", "error", "pragma",
    "line", "printf", "print", "puts", "scanf", "sprintf", "malloc", "calloc", "realloc", "free", "memcpy", "memset",
    "memmove", "strlen", "strcpy", "strncpy", "strcat", "strcmp", "strncmp", "true", "false", "nullptr", "NULL",
})
#: A Markdown heading.
HEADING = re.compile(r"^(#{1,6})[^\S\n]+(.+)$", re.M)
#: Symbols and properties of KiCad files; designators and values of other schematics. The first three are the parts of
#: one pattern, looked for one behind the other, since as one it takes time with the square of the text.
SYMBOL = re.compile(r'\(symbol\s+"([^"]+)"')
REFERENCE = re.compile(r'\(property\s+"Reference"\s+"([^"]+)"')
VALUE = re.compile(r'\(property\s+"Value"\s+"([^"]+)"')
DESIGNATOR = re.compile(r"Designator=(\w+)", re.I)
LISTED_VALUE = re.compile(r"(?:Value|Comment)=([^\n|]+)", re.I)


class Lines:
    """Line numbers of offsets, and offsets of lines."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def cut(self, a: int, b: int) -> str:
        """Lines a to b, without the last line feed."""
        return self.text[self.starts[a] : self.starts[b] - 1 if b < len(self.starts) else len(self.text)] if a < b else ""

    def first_from(self, offset: int) -> int:
        """The first start of a line at an offset or behind it; the text's length where there is none."""
        at = bisect_left(self.starts, offset)
        return self.starts[at] if at < len(self.starts) else len(self.text)


# --- definitions with a body in braces ---------------------------------------------------------------


def _braced(run: re.Pattern, name: re.Pattern, first: re.Pattern, tail: re.Pattern, least: int, text: str) -> Iterator[tuple[int, str]]:
    """(offset, name) of `words name(...) {`: all definitions that start at the start of a line.

    A definition's words before the bracket are one unbroken run of signs (`run`), and its name is the last of them. So each
    run before a bracket is looked at once: whether the brackets close before a brace, whether its last word is a `name`
    behind at least `least` signs and white space, and at which line start it may begin (`first`).
    """
    closing = [m.start() for m in re.finditer(r"\)", text)]
    opens: dict[int, int] = {}
    done = 0
    for m in run.finditer(text):
        a, q = m.span()
        if not text.startswith("(", q) or q < done:
            continue
        nth = bisect_right(closing, q)
        if nth == len(closing):
            return
        at = closing[nth]
        if at not in opens:
            brace = tail.match(text, at + 1)
            opens[at] = brace.end() if brace else -1
        if opens[at] < 0:
            continue
        words = text[a:q].rstrip()
        word = re.search(r"\S*\Z", words)
        if not name.fullmatch(word[0]):
            continue
        start = first.search(text, max(a, done), q)
        if start and start.start() <= a + word.start() - 1 - least:
            yield start.start(), word[0]
            done = opens[at]


# fixed values: signs of the words before a name, the name, what a line starts with, and what stands before the brace
_C = partial(_braced, re.compile(r"[\w\s*]++"), re.compile(r"\w+"), re.compile(r"^\w", re.M), re.compile(r"\s*\{"), 2)
_CPP = partial(_braced, re.compile(r"[\w\s*:&<>]++"), re.compile(r"\w+(?:::\w+)?"), re.compile(r"^\w", re.M), re.compile(r"\s*(?:const\s*)?\{"), 2)
_ANY = partial(_braced, re.compile(r"[\w*\s&]++"), re.compile(r"\w+"), re.compile(r"^[\w*\s&]", re.M), re.compile(r"\s*\{"), 1)

#: Words before a type in Java, in the order in which they are tried. They are the beginnings that one pattern with
#: optional parts allows, which on long texts takes time with the square of them; tests hold both to the same finds.
_JAVA_HEADS = [re.compile(p + r"(\w+)") for p in (r"(?:public|private|protected)\s*static\s+", r"(?:public|private|protected)\s*", r"static\s+", "")]
_JAVA_NAME = re.compile(r"\s+(\w++)\s*+\(")


def _java(text: str) -> Iterator[tuple[int, str]]:
    """(offset, name) of `type name(` at the start of a line, blank lines before it included."""
    lines, angles = Lines(text), [m.start() for m in re.finditer(">", text)]
    done, before = 0, -1  # the end of the last one, and the last sign before this line's first
    for m in re.finditer(r"^[^\S\n]*+(\S).*", text, re.M):
        f, previous, before = m.start(1), before, m.start() + len(m[0].rstrip()) - 1
        if f < done:
            continue
        for head in _JAVA_HEADS:
            own = head.match(text, f)
            if not own:
                continue
            found = _JAVA_NAME.match(text, own.end())
            if not found and text.startswith("<", own.end()):
                nth = bisect_left(angles, own.end() + 1)
                inner = nth < len(angles) and angles[nth] > own.end() + 1
                found = _JAVA_NAME.match(text, angles[nth] + 1) if inner else None
            if found:
                start = lines.first_from(max(previous + 1, done))
                if start <= f:
                    yield start, found[1]
                    done = found.end()
                break


def _matches(pattern: re.Pattern, text: str) -> Iterator[tuple[int, str]]:
    return ((m.start(), m[1]) for m in pattern.finditer(text))


#: Where functions start, by language.
FUNCTION_STARTS: dict[str, Callable[[str], Iterator[tuple[int, str]]]] = {"c": _C, "cpp": _CPP, "java": _java, "python": partial(_matches, PYTHON_START)}


# --- chunks of code ----------------------------------------------------------------------------------


def _from_starts(text: str, starts: list[tuple[int, str]], language: str, file: str, imports: re.Pattern, comment: str) -> list[Chunk]:
    """A chunk from each start to the next, under the file's first imports; and what stands before, if it is over two lines."""
    lines, own = Lines(text), {"language": language, "file": file}
    first = [lines.of(offset) for offset, _ in starts]
    head = lines.cut(0, first[0])
    context = "\n".join(m[0] for m in islice(imports.finditer(head), 10))
    prefix = f"{comment} File: {file}\n{context}\n\n" if context else ""
    chunks = [(prefix + lines.cut(a, b).rstrip(), own | {"type": "function", "function": name, "start_line": a + 1, "end_line": b}) for (_, name), a, b in zip(starts, first, [*first[1:], len(lines.starts)], strict=True)]
    return [(head.strip(), own | {"type": "header"})] * (first[0] > 2 and bool(head.strip())) + chunks


def blocks(text: str, language: str, file: str, least: int = 80) -> list[Chunk]:
    """Runs of lines that end at the first blank line at which they hold `least`."""
    lines = Lines(text)
    blank = [lines.of(m.start()) for m in re.finditer(r"^[^\S\n]*$", text, re.M)]
    ends, n = [0], len(lines.starts)
    while ends[-1] < n:
        nth = bisect_left(blank, ends[-1] + least - 1)
        ends.append(blank[nth] + 1 if nth < len(blank) else n)
    bodies = (lines.cut(a, b).strip() for a, b in zip(ends, ends[1:], strict=False))
    return [(body, {"type": "block", "language": language, "file": file}) for body in bodies if body]


def functions(text: str, language: str, file: str) -> list[Chunk]:
    """Chunks of C-like code by functions; line blocks where no function starts."""
    starts = list(FUNCTION_STARTS[language](text))
    return _from_starts(text, starts, language, file, IMPORT_LINE, "//") if starts else blocks(text, language, file)


class _Tree:
    """Functions of Python code, breadth first, with the names that each calls, in inner functions as well."""

    def __init__(self, text: str):
        self.nodes: list[ast.FunctionDef | ast.AsyncFunctionDef] = []
        self.calls: dict[int, set[str]] = defaultdict(set)
        outer: dict[int, int] = {}
        try:
            open_ = deque([(ast.parse(text), -1)])
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        while open_:
            node, inside = open_.popleft()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                outer[len(self.nodes)], inside = inside, len(self.nodes)
                self.nodes.append(node)
            elif isinstance(node, ast.Call) and (name := self._called(node.func)):
                at = inside
                while at >= 0 and name not in self.calls[at]:
                    self.calls[at].add(name)
                    at = outer[at]
            open_.extend((child, inside) for child in ast.iter_child_nodes(node))

    @staticmethod
    def _called(f: ast.expr) -> str | None:
        """The name a call goes by; none for calls on the object or class itself."""
        if isinstance(f, ast.Attribute):
            return None if isinstance(f.value, ast.Name) and f.value.id in {"self", "cls", "super"} else f.attr
        return f.id if isinstance(f, ast.Name) else None


def python_functions(text: str, file: str) -> list[Chunk]:
    """Chunks of Python code: every function of the syntax tree, breadth first; else functions at line starts."""
    if found := _Tree(text).nodes:
        lines = Lines(text)
        spans = [(d.lineno, d.end_lineno or d.lineno, d.name) for d in found]
        return [(lines.cut(a - 1, b), {"type": "function", "language": "python", "file": file, "function": name, "start_line": a, "end_line": b}) for a, b, name in spans]
    starts = list(FUNCTION_STARTS["python"](text))
    return _from_starts(text, starts, "python", file, PYTHON_IMPORT_LINE, "#") if starts else []


# --- chunks of prose ---------------------------------------------------------------------------------


def sections(text: str) -> list[Chunk]:
    """Chunks by Markdown heading, each under its chain of headings: paragraphs of a text that is blank."""
    found = list(HEADING.finditer(text))
    levels = [len(m[1]) for m in found]
    # how long each chain is: a level not above the last one's cuts it back first
    sizes = list(accumulate(zip([0, *levels], levels, strict=False), lambda n, x: (min(n, x[1] - 1) if x[1] <= x[0] else n) + 1, initial=0))[1:]
    latest: dict[int, str] = {}  # by place in the chain
    out = [(text[: found[0].start() if found else len(text)].strip(), [])]
    ends = [m.start() for m in found[1:]] + [len(text)]
    for m, size, end in zip(found, sizes, ends, strict=False):
        latest[size] = m[2].strip()
        out.append((text[m.start() : end].strip(), [latest[k] for k in range(1, size + 1)]))
    chunks = [((f"[{' > '.join(chain)}]\n\n" if any(chain) or len(chain) > 1 else "") + body, {"type": "section", "heading_chain": chain, "section": (chain or [""])[-1]}) for body, chain in out if body]
    return chunks or paragraphs(text)


def paragraphs(text: str, most: int = 2000) -> list[Chunk]:
    """Paragraphs packed in order up to `most` characters; a longer one stays whole."""
    runs = ("\n".join(lines).strip() for blank, lines in groupby(text.split("\n"), lambda line: not line.strip()) if not blank)
    parts = list(runs)
    ends = list(accumulate(map(len, parts), initial=0))
    cuts = [0]
    while cuts[-1] < len(parts):  # as many as fit, one at least
        cuts.append(max(cuts[-1] + 1, bisect_right(ends, ends[cuts[-1]] + most) - 1))
    return [("\n\n".join(parts[a:b]), {"type": "paragraph"}) for a, b in zip(cuts, cuts[1:], strict=False)]


# --- calls -------------------------------------------------------------------------------------------


def calls_by_tree(text: str) -> list[tuple[str, list[str], bool]]:
    """(function, sorted calls, complete) of each plain function of the syntax tree; calls on self, cls and super are left out."""
    tree = _Tree(text)
    return [(d.name, sorted(tree.calls[i]), True) for i, d in enumerate(tree.nodes) if isinstance(d, ast.FunctionDef)]


def calls_by_pattern(text: str, reference_spans: bool = False) -> list[tuple[str, list[str], bool]]:
    """The same by patterns, for any language; functions that call nothing are left out.

    A control word that looks like a definition starts no function, unless reference_spans is set.
    """
    found = sorted([*_ANY(text), *_matches(PYTHON_START, text), *_matches(SCRIPT_START, text)])
    starts = [s for s in found if reference_spans or s[1] not in NO_CALLS]
    offsets = [offset for offset, _ in starts]
    called: dict[int, set[str]] = defaultdict(set)
    for m in CALL.finditer(text, offsets[0]) if starts else ():
        span = bisect_right(offsets, m.start()) - 1
        if span + 1 == len(offsets) or m.end() <= offsets[span + 1]:
            called[span].add(m[1])
    own = ((name, called[i] - NO_CALLS - {name}) for i, (_, name) in enumerate(starts))
    return [(name, sorted(names), False) for name, names in own if names]


# --- components --------------------------------------------------------------------------------------


def kicad_components(text: str) -> list[tuple[str, str, str | None]]:
    """(designator, value, lib): each symbol with the first reference behind it, and the first value behind that."""
    out, at = [], 0
    while True:
        found = []
        for pattern in (SYMBOL, REFERENCE, VALUE):
            m = pattern.search(text, at)
            if not m:
                return out
            found.append(m[1])
            at = m.end()
        out.append((found[1], found[2], found[0]))


def _first_alike(names: list[tuple[int, str]]) -> dict[str, int]:
    """For each name the least offset of a name that starts with it: in reverse order these come right before it."""
    least, open_ = {}, []
    for name, offset in sorted(((name, offset) for offset, name in names), reverse=True):
        while open_ and open_[-1].startswith(name):
            offset = min(offset, least[open_.pop()])
        least[name] = offset
        open_.append(name)
    return least


def listed_components(text: str) -> list[tuple[str, str, str | None]]:
    """(designator, value, none): the value is the first one after the first entry whose designator starts alike."""
    least = _first_alike([(m.start(), m[1].lower()) for m in re.finditer(rf"(?={DESIGNATOR.pattern})", text, re.I)])
    values = [m.start() for m in re.finditer(rf"(?={LISTED_VALUE.pattern})", text, re.I)]
    out = []
    for m in DESIGNATOR.finditer(text):
        nth = bisect_left(values, least[m[1].lower()] + len(m[0]))
        out.append((m[1], LISTED_VALUE.match(text, values[nth])[1].strip() if nth < len(values) else "?", None))
    return out
