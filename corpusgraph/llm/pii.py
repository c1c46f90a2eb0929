"""Personal data: spans found by fixed rules, and further candidates chosen by gradient-boosted trees.

High-recall generators propose overlapping spans, in the forms that the rules take and in disguised ones. Each becomes a
vector of small integers (its format, what stands around it). Trees are boosted on half of all texts: positives are the
rules' finds, each rewritten in its place as people write to escape rules ("(at)" for "@", dots in brackets or in cards, no
plus before a phone), so that no rule takes it any more; negatives are the candidates of the texts as they are that no
rule of their kind confirms, and so are those that lie on another rule's find. So the trees learn what the rules cannot see.
A threshold for each kind, calibrated on the other half of the texts, selects.

Only DataFrame functions touch texts; the trees are compiled into one column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import table, uniform_key

KINDS = ("email", "ip", "card", "phone")
#: What the rules take, leftmost and not overlapping by kind. The forms here match the same spans as
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ , [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ,
#: [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9] , but never go back over long runs.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no span of the kind.
TRIGGERS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[\x20._/-]?[0-9]{4}+){2,3}[0-9]{0,3}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: How a rule's find is rewritten to be a positive example: (pattern, replacement) in turn, of two ways one by a hash.
DISGUISES = {
    "email": [[("@", " (at) "), (r"\.(?=[A-Za-z0-9-]+$)", " (dot) ")], [("@", "[at]"), (r"\.(?=[A-Za-z0-9-]+$)", ".")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", "(.)")]],
    "card": [[(r"[\x20-]", ""), ("([0-9]{4})(?=[0-9])", "$1.")], [(r"[\x20-]", ""), ("([0-9]{4})(?=[0-9])", "$1/")]],
    "phone": [[(r"^\+", "")], [(r"^\+", ""), (r"[()]", ""), (r"[\x20-]+", ".")]],
}
GENERATOR_TRIGGER = r"[0-9@]|\(at\)|\[at\]"
CONTEXT_CHARS = 24
CONTEXT_WORDS = r"(?i)\b(?:mail|e-mail|email|contact|phone|tel|call|mobile|fax|card|visa|credit|ip|host|address|server)\b"

#: The generators bound the parts of a candidate (64 and 63 characters of an address, 8 labels), not of a rule's find.
ROUNDS, LEARNING_RATE, LEAST_ROWS = 40, 0.3, 5
MIN_PRECISION = 0.95
FEATURES = ("kind", "digits", "separators", "letters", "valid", "before", "after", "context", "quad")

_SPAN = "array<struct<kind:int,s:int,e:int,t:string>>"


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, r"[^0-9]+", "")


def _octets_fit(t: Column) -> Column:
    parts = F.transform(F.split(t, r"[^0-9]+"), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def _passes(kind: str, t: Column) -> Column:
    """The rule's further condition on what its pattern matched."""
    if kind == "ip":
        return _octets_fit(t)
    if kind == "card":
        return F.length(_digits(t)).between(12, 19) & F.call_function("luhn_check", _digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches that are placed at a time: appending one by one to a long array would copy it each time.
_AT_ONCE = 256


def _found(kind: str, text: Column, pattern: str) -> Column:
    """All matches with their places in code points: what lies between matches and the matches themselves, added up."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    both = F.filter(both, lambda z: z["h"].isNotNull())

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["p"])
        end = start + F.length(z["h"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("s"), end.alias("e"), z["h"].alias("t"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(zs: Column) -> Column:
        def some(acc: Column, first: Column) -> Column:
            part = F.aggregate(F.slice(zs, first, F.lit(_AT_ONCE)), F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
            return _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        firsts = F.when(F.size(zs) > 0, F.sequence(F.lit(1), F.size(zs), F.lit(_AT_ONCE))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(firsts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), some, lambda acc: F.flatten(acc["out"]))

    return _let(both, run)


def _none() -> Column:
    return F.array().cast(_SPAN)


def rule_spans(text: Column, kind: str) -> Column:
    """The rule's spans of one kind: array of (kind, s, e, t)."""
    found = F.filter(_found(kind, text, RULES[kind]), lambda x: _passes(kind, x["t"]))
    return F.when(text.rlike(TRIGGERS[kind]), found).otherwise(_none())


def candidates(text: Column) -> Column:
    """All generators' proposals; they may overlap."""
    return F.when(text.rlike(GENERATOR_TRIGGER), F.concat(*(_found(k, text, GENERATORS[k]) for k in KINDS))).otherwise(_none())


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[A-Za-z0-9]"), 2).otherwise(3)


def candidate_features(text: Column, c: Column) -> list[Column]:
    """FEATURES of a candidate, small integers."""
    t, s, e = c["t"], c["s"], c["e"]
    left = F.when(s > 0, F.substr(text, F.greatest(s - (CONTEXT_CHARS - 1), F.lit(1)), F.least(F.lit(CONTEXT_CHARS), s))).otherwise("")
    before = F.when(s > 0, F.substr(text, s, F.lit(1))).otherwise("")
    valid = F.when(c["kind"] == 0, t.rlike(r"[A-Za-z]{2,}$")).when(c["kind"] == 1, _octets_fit(t)).when(c["kind"] == 2, _passes("card", t)).otherwise(_passes("phone", t))
    return [
        c["kind"],
        F.least(F.length(_digits(t)), F.lit(20)),
        F.least(F.length(F.regexp_replace(t, r"[^\x20.()\[\]-]+", "")), F.lit(9)),
        F.least(F.length(F.regexp_replace(t, r"[^A-Za-z]+", "")) / 4, F.lit(5)).cast("int"),
        valid.cast("int"),
        F.when(before == "+", 1).otherwise(_char_class(before)),
        _char_class(F.substr(text, e + 1, F.lit(1))),
        left.rlike(CONTEXT_WORDS).cast("int"),
        (t.rlike(r"^[0-9]{1,3}(?:[^0-9][0-9]{1,3}){3}$") & _octets_fit(t)).cast("int"),
    ]


@dataclass(frozen=True)
class Tree:
    """A leaf (value), or a split: feature at most `at`."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def score(self, x: tuple) -> float:
        if self.low is None:
            return self.value
        return (self.low if x[self.feature] <= self.at else self.high).score(x)

    def column(self, x: list[Column]) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.at, self.low.column(x)).otherwise(self.high.column(x))


def _grow(rows: list[tuple], grads: list[tuple[float, float]], depth: int) -> Tree:
    """rows: feature vectors; grads: gradient and hessian sums of each. Newton steps, the split with the most gain."""
    g, h = sum(x for x, _ in grads), sum(x for _, x in grads)
    leaf = Tree(value=LEARNING_RATE * g / (h + 1.0))
    if depth == 0 or len(rows) < 2:
        return leaf
    best, gain = None, 1e-6
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for x, (gi, hi) in zip(rows, grads, strict=True):
            sums = by.setdefault(x[f], [0.0, 0.0])
            sums[0] += gi
            sums[1] += hi
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            new = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
            if new > gain:
                best, gain = (f, v), new
    if best is None:
        return leaf
    sides = [[i for i, x in enumerate(rows) if (x[best[0]] <= best[1]) == low] for low in (True, False)]
    low, high = (_grow([rows[i] for i in s], [grads[i] for i in s], depth - 1) for s in sides)
    return Tree(feature=best[0], at=best[1], low=low, high=high)


@dataclass(frozen=True)
class Boosted:
    """The trees, and by kind the score from which on a candidate is a span (above 1 for a kind that gets none)."""

    base: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]

    def score(self, x: tuple) -> float:
        return _sigmoid(self.base + sum(t.score(x) for t in self.trees))

    def column(self, x: list[Column]) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def selects(self, x: list[Column]) -> Column:
        return self.column(x) >= F.get(F.array(*map(F.lit, self.thresholds)), x[0])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))  # exp of more would not be a float


def boost(rows: list[tuple[tuple, int, int]], depth: int = 3) -> tuple[float, tuple[Tree, ...]]:
    """Logistic boosting on (features, rows, positives)."""
    n, p = sum(r[1] for r in rows), sum(r[2] for r in rows)
    base = math.log((p + 0.5) / (n - p + 0.5))
    scores, trees = [base] * len(rows), []
    for _ in range(ROUNDS):
        prob = [_sigmoid(s) for s in scores]
        grads = [(pos - n * q, n * q * (1 - q)) for (_, n, pos), q in zip(rows, prob, strict=True)]
        tree = _grow([r[0] for r in rows], grads, depth)
        trees.append(tree)
        scores = [s + tree.score(r[0]) for s, r in zip(scores, rows, strict=True)]
    return base, tuple(trees)


def disguised(span: Column, which: Column) -> Column:
    """A rule's find rewritten so that the rule does not take it; which (0 or 1) is the way."""
    out = F.lit(None).cast("string")
    for kind, ways in DISGUISES.items():
        forms = []
        for way in ways:
            t = span["t"]
            for pattern, by in way:
                t = F.regexp_replace(t, pattern, by)
            forms.append(t)
        out = F.when(span["kind"] == KINDS.index(kind), F.when(which == 0, forms[0]).otherwise(forms[1])).otherwise(out)
    return out


def _touches(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _overlap(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & _touches(a, b)


def examples(texts: DataFrame) -> DataFrame:
    """(fits, y, FEATURES) of the candidates of texts (text, fits): positives in texts around disguised finds,
    negatives in the texts as they are."""
    text = F.col("text")
    found = texts.select("text", "fits", F.concat(*(rule_spans(text, k) for k in KINDS)).alias("found"))
    told = found.select("text", "fits", F.explode("found").alias("r"))
    which = F.pmod(F.xxhash64("text", "r.s"), F.lit(2))
    left = F.when(F.col("r.s") > 0, F.substr(text, F.greatest(F.col("r.s") - (2 * CONTEXT_CHARS - 1), F.lit(1)), F.least(F.lit(2 * CONTEXT_CHARS), F.col("r.s")))).otherwise("")
    told = told.select("fits", left.alias("left"), disguised(F.col("r"), which).alias("t"), F.substr(text, F.col("r.e") + 1, F.lit(2 * CONTEXT_CHARS)).alias("right"), F.col("r.kind").alias("kind"))
    place = F.struct(F.col("kind"), F.length("left").alias("s"), (F.length("left") + F.length("t")).alias("e"))
    told = told.select("fits", F.concat("left", "t", "right").alias("text"), place.alias("place"))
    told = told.select("*", F.concat(*(rule_spans(text, k) for k in KINDS)).alias("found"), F.explode(candidates(text)).alias("c"))
    yes = told.where(_overlap(F.col("c"), F.col("place")) & ~F.exists("found", lambda r: _touches(F.col("c"), r)))
    no = found.select("*", F.explode(candidates(text)).alias("c")).where(~F.exists("found", lambda r: _overlap(F.col("c"), r)))
    both = yes.select("text", "fits", "c", F.lit(1).alias("y")).unionByName(no.select("text", "fits", "c", F.lit(0).alias("y")))
    return both.select("fits", "y", *(x.alias(n) for n, x in zip(FEATURES, candidate_features(text, F.col("c")), strict=True)))


def fit(docs: DataFrame) -> Boosted | None:
    """Trees from the candidates of all documents; None without positives.

    The driver gets counts by feature vector. Features are few small integers, so their number does not grow with the
    documents.
    """
    text = F.col("text")
    texts = docs.where(text.isNotNull() & text.rlike(GENERATOR_TRIGGER)).select("text", (F.pmod(uniform_key("doc_id", "text", seed=11), F.lit(2)) == 0).alias("fits"))
    rows = examples(texts)
    counted = rows.groupBy("fits", *FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    sides = {side: [(tuple(r[f] for f in FEATURES), r["n"], r["p"]) for r in counted if r["fits"] == side] for side in (True, False)}
    if not sum(r[2] for r in sides[True]):
        return None
    base, trees = boost(sides[True])
    model = Boosted(base, trees, ())
    return Boosted(base, trees, tuple(_threshold([(model.score(x), n, p) for x, n, p in sides[False] if x[0] == k]) for k in range(len(KINDS))))


def _threshold(scored: list[tuple[float, int, int]]) -> float:
    """The lowest score (0.5 at least) from which on the kept-out candidates of a kind are as precise as asked.

    scored: score, candidates, right ones. 2 where there is none, so that the kind gets no further spans.
    """
    best, n, p = 2.0, 0, 0
    for score, ni, pi in sorted(scored, reverse=True):
        n, p = n + ni, p + pi
        if n >= LEAST_ROWS and p / n >= MIN_PRECISION:
            best = score
    return max(0.5, best)


def with_spans(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, s, e, t) by start, then kind. A null text counts as empty.

    The rules' spans are all in spans; a candidate joins them if no rule's span of any kind overlaps it and the trees' score
    reaches the threshold of its kind. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("base", "spans")]
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(*names, text.alias("__text"))
    docs = docs.select("*", F.concat(*(rule_spans(F.col("__text"), k) for k in KINDS)).alias("base"))
    by_place = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["t"].alias("t")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))
    if model is None:
        return docs.select(*names, by_place(F.col("base")).alias("base"), by_place(F.col("base")).alias("spans"))
    docs = docs.select("*", F.filter(candidates(F.col("__text")), lambda c: ~F.exists("base", lambda r: _touches(c, r))).alias("__open"))
    added = F.filter("__open", lambda c: model.selects(candidate_features(F.col("__text"), c)))
    return docs.select(*names, by_place(F.col("base")).alias("base"), by_place(F.concat("base", F.when(F.size("__open") > 0, added).otherwise(_none()))).alias("spans"))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [kind]; of overlapping spans the first counts."""
    kinds = F.array(*(F.lit(k) for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.get(kinds, x["kind"]), F.lit("]"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], piece).alias("out"))).otherwise(acc)

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit(docs))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
