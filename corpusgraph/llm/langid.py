"""Language identification by interpolated Kneser-Ney character models in sorted arrays.

A text becomes letters of a learned alphabet, lower-cased, with one boundary between words. For each language, a model of
order 4 gives the probability of each letter after three others. The language with the lowest cross-entropy for each
letter wins; a text whose cross-entropy is far above what its language shows on texts kept out of the fit is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import cut, table, uniform_key

#: Bound of the fit: so many labelled documents of each language, the ones with the smallest hashes.
TRAIN_DOCS_PER_LANG = 1000
#: Of these, one in so many is kept out of the counts and calibrates the rejection.
CALIBRATE_ONE_IN = 5
#: Languages with fewer texts to calibrate with are scored by cross-validation, and share the deviations of all languages
#: if even so they have fewer. With fewer in all languages together nothing is rejected for its cross-entropy.
ENOUGH_TEXTS = 20
ORDER, LETTER_BITS = 4, 16
#: Class of letters that the fit has not seen; it sees at most one less.
OTHER_LETTER = (1 << LETTER_BITS) - 1
UNDETERMINED = "und"
#: The posterior counts at most so many letters: further letters of one text are no independent evidence.
LETTERS_OF_EVIDENCE = 50
#: Rejected: above the largest calibrated excess by this factor.
SLACK = 2.5
#: Letters from which a text's cross-entropy shows how much texts differ, not how much letters do.
LONG_TEXT = 1000
#: Shorter texts say nothing about how high a cross-entropy may be.
SHORT_TEXT = 20
#: Rows of log probabilities that a task keeps, and bits of the table that finds them.
_MOST_MEMO, _MEMO_BITS = 1 << 17, 18

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str | None], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ORDER letters for each letter or boundary of every text; their number by text; which texts have letters.

    alphabet: letter class of every code point, 0 for what is no letter. Before its first letter a text has boundaries.
    """
    lower = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    ids = alphabet[_points(lower)]
    of = np.repeat(np.arange(len(texts)), sizes)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = True
    if len(first):
        first[0] = True
    before = np.concatenate([[0], ids[:-1]]).astype(ids.dtype)
    before[first] = 0
    keep = (ids != 0) | (before != 0)
    ids, of = ids[keep], of[keep]
    counts = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    padded = np.zeros(len(ids) + (ORDER - 1) * len(texts), np.uint64)
    at = np.arange(len(ids)) + (ORDER - 1) * (of + 1)
    padded[at] = ids
    codes = np.zeros(len(ids), np.uint64)
    for back in range(ORDER):
        codes |= padded[at - back] << np.uint64(LETTER_BITS * back)
    letters = np.bincount(of, weights=ids != 0, minlength=len(texts)) > 0
    return codes, np.diff(np.append(starts, len(ids))), letters


@dataclass
class Model:
    """Sorted arrays for each order: keys of n-grams with their discounted share, keys of contexts with their back-off weight.

    classes: how many letter classes there are, the boundary and OTHER_LETTER included; below order 1 all are alike.
    """

    classes: int
    shares: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    backoffs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    mean: float = 0.0
    spread: float = 1.0
    between: float = 0.0
    most: float = float("inf")
    ceiling: float = 0.0

    @staticmethod
    def fit(codes: np.ndarray, counts: np.ndarray, classes: int) -> Model:
        """From the distinct codes of ORDER letters and their counts; lower orders use continuation counts."""
        m, counts = Model(classes), counts.astype(np.float64)
        for n in range(ORDER, 0, -1):
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            contexts = codes >> np.uint64(LETTER_BITS)
            names, at, kinds = np.unique(contexts, return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, at) if len(counts) else np.zeros(0)
            share = (counts - discount) / np.repeat(totals, kinds)
            m.shares.insert(0, (codes, share))
            m.backoffs.insert(0, (names, discount * kinds / totals))
            if n > 1:  # the next lower order counts the different letters that stand before
                codes, counts = np.unique(codes & np.uint64((1 << LETTER_BITS * (n - 1)) - 1), return_counts=True)
                counts = counts.astype(np.float64)
        return m

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        names, values = table
        if not len(names):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[at] == keys, values[at], default)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1.0 / self.classes)
        for n in range(1, ORDER + 1):
            keys = codes & np.uint64((1 << LETTER_BITS * n) - 1)
            p = self._get(self.shares[n - 1], keys, 0.0) + self._get(self.backoffs[n - 1], keys >> np.uint64(LETTER_BITS), 1.0) * p
        return np.log(p)


@dataclass
class Identifier:
    """The models by language (sorted) and the alphabet as code points of the letter classes 1, 2, ..."""

    letters: list[int]
    models: dict[str, Model]

    def prepare(self) -> None:
        self.langs = sorted(self.models)
        self.alphabet = np.where(letter_table(), np.uint16(OTHER_LETTER), np.uint16(0))
        self.alphabet[np.array(self.letters, np.int64)] = np.arange(1, len(self.letters) + 1, dtype=np.uint16)
        self._forget()

    def _forget(self) -> None:
        self.names = np.zeros(1 << _MEMO_BITS, np.uint64)
        self.row_of = np.full(1 << _MEMO_BITS, -1, np.int32)
        self.rows = np.zeros((0, len(self.langs)))

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of log probabilities by language; what was looked up in the sorted arrays lately is found by a hash of the code."""
        with np.errstate(over="ignore"):
            place = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
            at = np.where(self.names[place] == codes, self.row_of[place], -1)
            if (at < 0).any():
                if len(self.rows) > _MOST_MEMO:
                    self._forget()
                    at[:] = -1
                new, whose = np.unique(codes[at < 0], return_inverse=True)
                at[at < 0] = len(self.rows) + whose
                place = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
                self.names[place], self.row_of[place] = new, len(self.rows) + np.arange(len(new), dtype=np.int32)
                self.rows = np.concatenate([self.rows, np.stack([self.models[lang].log_prob(new) for lang in self.langs], axis=1)])
        return at

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy for each letter (texts x languages), number of letters and boundaries, which texts have letters."""
        codes, counts, letters = grams(texts, self.alphabet)
        at = self._rows(codes)
        sums = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        for k in range(len(self.langs)):
            if len(full):
                sums[full, k] = np.add.reduceat(self.rows[:, k][at], starts)
        return -sums / np.maximum(counts, 1)[:, None], counts, letters

    def excess(self, entropy: np.ndarray, counts: np.ndarray, lang: int) -> np.ndarray:
        """How far above the language's mean, in deviations of a text of that length."""
        m = self.models[self.langs[lang]]
        return (entropy - m.mean) / np.sqrt(m.spread**2 / np.maximum(counts, 1) + m.between**2)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropy, counts, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        weight = np.exp(-(entropy - low[:, None]) * np.minimum(counts, LETTERS_OF_EVIDENCE)[:, None])
        score = np.where(letters, 1.0 / weight.sum(axis=1), 0.0)
        excess = np.array([self.excess(low[i], counts[i], best[i]) for i in range(len(texts))]) if len(texts) else np.zeros(0)
        most = np.array([self.models[lang].most for lang in self.langs])[best]
        ceiling = np.array([self.models[lang].ceiling for lang in self.langs])[best]
        langs = np.where(letters, np.array(self.langs, object)[best], UNDETERMINED)
        return pd.DataFrame({"lang_pred": langs, "score": score, "cross_entropy": np.where(letters, low, np.nan), "rejected": ~letters | (excess > most) & (low > ceiling)})


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _alphabet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        points, counts = np.unique(_points([t.lower() for t in batch["text"]]), return_counts=True)
        keep = letter_table()[points]
        if keep.any():
            yield pd.DataFrame({"point": points[keep].astype(np.int64), "n": counts[keep].astype(np.int64)})


def _counted(letters: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who = Identifier(letters, {})
        who.prepare()
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                codes, counts = np.unique(grams(rows["text"].tolist(), who.alphabet)[0], return_counts=True)
                if len(codes):
                    yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": counts.astype(np.int64)})

    return run


def fit(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS_PER_LANG) -> Identifier | None:
    """Models from (doc_id, text, lang), at most docs_per_lang documents of each language; None without any text.

    Rows with a null text or lang are left out. The driver gets the n-gram counts of this bounded sample alone. The sample
    goes by hashes of doc_id and text, so repeated and null ids are no burden. A language whose texts have no letters has no
    model.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return None
    key = F.shiftrightunsigned(uniform_key("doc_id", "text", seed=5), 33).cast("double") / float(1 << 31)
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * docs_per_lang / n)).otherwise(share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", F.xxhash64("text")))
    sample = cut(rows.withColumn("key", key).where(F.col("key") < share).withColumn("nth", nth).where(F.col("nth") <= docs_per_lang))
    counted = sample.where(F.col("nth") % CALIBRATE_ONE_IN != 0)
    if counted.isEmpty():
        counted = sample
    top = counted.select("text").mapInPandas(_alphabet, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(OTHER_LETTER - 1)
    letters = [r["point"] for r in top.collect()]
    counts = counted.select("lang", "text").mapInPandas(_counted(letters), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    who = Identifier(letters, {lang: Model.fit(g["code"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(), len(letters) + 2) for lang, g in counts.groupby("lang")})
    if not who.models:
        return None
    rare = [lang for lang, n in totals.items() if min(n, docs_per_lang) // CALIBRATE_ONE_IN < ENOUGH_TEXTS]
    judged_by = F.when(F.col("lang").isin(rare), _fold_name(F.col("lang"), F.col("nth"))).otherwise(F.col("lang"))
    judged = sample.where(F.col("lang").isin(rare) | (F.col("nth") % CALIBRATE_ONE_IN == 0)).select("lang", "text", judged_by.alias("judge"))
    _calibrate(who, Identifier(letters, who.models | _fold_models(sample, rare, letters)), judged)
    return who


def _fold_name(lang: Column, nth: Column) -> Column:
    return F.concat(lang, F.lit("\n"), (nth % CALIBRATE_ONE_IN).cast("string"))


def _fold_models(sample: DataFrame, rare: list[str], letters: list[int]) -> dict[str, Model]:
    """For each fold of a language with few texts, the model of its other folds."""
    if not rare:
        return {}
    few = sample.where(F.col("lang").isin(rare)).select(_fold_name(F.col("lang"), F.col("nth")).alias("lang"), "text")
    counts = few.mapInPandas(_counted(letters), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    folds, models = dict(list(counts.groupby("lang"))), {}
    for lang in rare:
        names = [f"{lang}\n{k}" for k in range(CALIBRATE_ONE_IN)]
        for name in names:
            rest = [folds[x] for x in names if x != name and x in folds]
            if rest:
                n = pd.concat(rest).groupby("code")["n"].sum()
                models[name] = Model.fit(n.index.to_numpy(np.int64).view(np.uint64), n.to_numpy(), len(letters) + 2)
    return models


def _calibrate(who: Identifier, judges: Identifier, judged: DataFrame) -> None:
    """Mean of the own language's cross-entropy, its spread by letter and between long texts, and the largest excess, over
    texts (lang, text, judge) that are kept out of the counts of their judge."""
    shared = judged.sparkSession.sparkContext.broadcast(judges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        model.prepare()
        for batch in batches:
            batch = batch[batch["judge"].isin(model.langs)]
            if not len(batch):
                continue
            entropy, counts, letters = model.entropies(batch["text"].tolist())
            own = entropy[np.arange(len(batch)), [model.langs.index(x) for x in batch["judge"]]]
            if letters.any():
                yield pd.DataFrame({"lang": batch["lang"].tolist(), "entropy": own, "n": counts})[letters]

    seen = judged.mapInPandas(run, "lang string, entropy double, n long").toPandas()
    means = {lang: float(np.average(g["entropy"], weights=g["n"])) for lang, g in seen.groupby("lang")}
    seen["away"] = seen["entropy"] - seen["lang"].map(means)
    texts = seen.groupby("lang")["n"].transform("size")
    pooled = seen[texts > 1]
    for lang, m in who.models.items():
        own = seen[seen["lang"] == lang]
        g = own if len(own) >= ENOUGH_TEXTS else pooled
        if len(g) < ENOUGH_TEXTS:
            continue
        away = g["away"]
        m.mean = means[lang] if len(own) else float(np.average(seen["entropy"], weights=seen["n"]))
        m.spread = float(max(1e-6, np.sqrt(np.mean(away**2 * g["n"]))))
        long = away[g["n"] >= LONG_TEXT]
        m.between = float(np.sqrt(np.mean(long**2))) if len(long) else 0.0
        m.most = SLACK * float(max(3.0, (away / np.sqrt(m.spread**2 / g["n"] + m.between**2)).max()))
        m.ceiling = m.mean + SLACK * float(away[g["n"] >= SHORT_TEXT].max()) if (g["n"] >= SHORT_TEXT).any() else m.mean


def identify(docs: DataFrame, who: Identifier | None) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected; columns of these names are replaced.

    A null text and one without letters get `und`, score 0, a null cross_entropy, and are rejected; so is every text
    where no language could be learned. The whole text counts. Repeated rows get the same answer each.
    """
    out = ["lang_pred", "score", "cross_entropy", "rejected"]
    docs = docs.drop(*(c for c in docs.columns if c in out))
    if who is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(who)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        model.prepare()
        for texts in batches:
            parts, part, size = [], [], 0
            for t in texts:  # some hundred thousand letters at a time
                part.append(t)
                size += len(t or "")
                if size > 1 << 18:
                    parts.append(model.predict(part))
                    part, size = [], 0
            if part or not parts:
                parts.append(model.predict(part))
            yield pd.concat(parts, ignore_index=True)

    return docs.withColumn("__said", predict("text")).select(*docs.columns, *(F.col("__said")[c].alias(c) for c in out))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the models are learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    who = fit(docs.where(~held_out(F.col("doc_id"))))
    said = identify(docs.select("doc_id", "text"), who)
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
