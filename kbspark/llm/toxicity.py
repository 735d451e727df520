"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved

#: Labelled rows that the lexicon is learnt from, at most; hash order picks them.
SAMPLE = 20_000
#: Entries of the lexicon, at most: the most telling ones.
ENTRIES = 5_000
#: Least log-likelihood ratio of an entry, and share of its labelled documents that are toxic.
EVIDENCE = 25.0
PURITY = 0.6
#: Lengths of word beginnings that are entries of their own.
STEMS = range(4, 9)
#: Harmless documents that hold a phrase, and no toxic one, before it is an exception.
EXCEPTION_DOCS = 5
THRESHOLD = 0.7

# Letters that look like a Latin one, and digits or signs that stand for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_GAP = re.compile(r"[^a-z]+")


class _Fold(dict):
    """Code point to folded letters; each is worked out once."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char).lower()
        base = "".join(c for c in base if not unicodedata.combining(c))
        value = "".join(HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c)) for c in base)
        self[code] = value
        return value


FOLD = _Fold()


def folded(text: str) -> str:
    """Words of Latin letters between single spaces: case, accents, look-alike
    letters and digit substitutions are folded, anything else separates words."""
    return f" {_GAP.sub(' ', text.translate(FOLD)).strip()} "


def features(text: str) -> set[str]:
    """Entries that a folded text could match: its words and their beginnings."""
    out = set()
    for word in set(text.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if n <= len(word))
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def _counted(batches: Iterable[pa.RecordBatch], of, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, harmless) with document counts, summed within a task as far as memory allows."""
    counts = (Counter(), Counter())

    def flush():
        for side, held in enumerate(counts):
            entries = list(held.items())
            held.clear()
            for i in range(0, len(entries), 10_000):
                n = [v for _, v in entries[i:i + 10_000]]
                zero = [0] * len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in entries[i:i + 10_000]], pa.string()),
                     pa.array(n if side else zero, pa.int64()), pa.array(zero if side else n, pa.int64())],
                    names=["entry", "toxic", "harmless"])

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            counts[toxic].update(of(folded(text or "")))
            if len(counts[0]) + len(counts[1]) > most:
                yield from flush()
    yield from flush()


COUNTS = "entry string, toxic long, harmless long"


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about ``sample`` labelled documents outside the
    held-out fold. The label side is bounded by ``sample`` and broadcast."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, evidence: float = EVIDENCE,
                  purity: float = PURITY) -> dict[str, float]:
    """Weight (smoothed log-odds) of each telling entry, from (text, toxic).

    An entry is kept if its log-likelihood ratio and the share of toxic
    documents among those that hold it are high enough, and if no shorter
    beginning of it is kept that says as much."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    t, h = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not h:
        return {}
    counts = (rows.mapInArrow(lambda batches: _counted(batches, features), COUNTS)
              .groupBy("entry").agg(F.sum("toxic").alias("k"), F.sum("harmless").alias("m")))
    k, m = F.col("k"), F.col("m")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, both = float(t + h), k + m
    ratio = 2 * (term(k, both * t / n) + term(m, both * h / n)
                 + term(t - k, (n - both) * t / n) + term(h - m, (n - both) * h / n))
    weight = F.log((k + 0.5) / (t + 1.0)) - F.log((m + 0.5) / (h + 1.0))
    best = (counts.where((weight > 0) & (k >= purity * both)).withColumn("ratio", ratio).where(F.col("ratio") >= evidence)
            .withColumn("weight", weight).orderBy(F.desc("ratio"), "entry").limit(entries))
    found = {r["entry"]: (r["weight"], r["k"]) for r in best.collect()}
    kept: dict[str, float] = {}
    for entry in sorted(found, key=len):
        shorter = [entry[:n] for n in range(len(entry)) if entry[:n] in kept]
        if not any(kept[s] >= 0.8 * found[entry][0] for s in shorter):
            kept[entry] = found[entry][0]
    return kept


class Matcher:
    """The automaton of a lexicon and its exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str] = ()):
        self.lexicon, self.exceptions = lexicon, tuple(exceptions)
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, float]]:
        """(start, weight) of matched words of a folded text, the heaviest entry
        of each word, none inside an exception phrase."""
        if not len(self.automaton):
            return []
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(text):
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        return [(s, w) for s, w in sorted(found.items()) if not any(a <= s < b for a, b in spared)]

    def rate(self, text: str) -> tuple[float, int]:
        """Weight of all hits for each hundred words, and the number of words."""
        text = folded(text)
        words = text.count(" ") - 1 if len(text) > 2 else 0
        return (100.0 * sum(w for _, w in self.hits(text)) / max(words, 20) if words else 0.0), words


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], docs: int = EXCEPTION_DOCS,
                     entries: int = ENTRIES) -> list[str]:
    """Phrases of a matched word and its neighbour that only harmless documents hold."""
    if not lexicon:
        return []
    matcher = Matcher(lexicon)

    def phrases(text: str) -> set[str]:
        out = set()
        for start, _ in matcher.hits(text):
            end = text.index(" ", start + 1)
            if start > 0:
                out.add(text[text.rindex(" ", 0, start):end + 1])
            if end + 1 < len(text):
                out.add(text[start:text.index(" ", end + 1) + 1])
        return out

    counts = (rows.mapInArrow(lambda batches: _counted(batches, phrases), COUNTS)
              .groupBy("entry").agg(F.sum("toxic").alias("k"), F.sum("harmless").alias("m")))
    found = counts.where((F.col("k") == 0) & (F.col("m") >= docs)).orderBy(F.desc("m"), "entry").limit(entries)
    return [r["entry"] for r in found.collect()]


def scale(rows: DataFrame, matcher: Matcher) -> tuple[float, float]:
    """Intercept and slope that turn the logarithm of a rate into a score: a
    logistic curve through the two classes of the labelled sample."""
    def rates(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([math.log1p(matcher.rate(t or "")[0]) for t in b["text"].to_pylist()], pa.float64()),
                 b["toxic"].cast(pa.int64())], names=["x", "toxic"])

    cells = rows.mapInArrow(rates, "x double, toxic long").groupBy(F.round("x", 2).alias("x"), "toxic").count().collect()
    if len({c["toxic"] for c in cells}) < 2:
        return -4.0, 4.0
    x = np.array([c["x"] for c in cells])
    y = np.array([c["toxic"] for c in cells], float)
    n = np.array([c["count"] for c in cells], float)
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-3, 1e-1])
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """A matcher with the scale of its scores; small, sent to the tasks."""

    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str], intercept: float, slope: float):
        self.lexicon, self.exceptions = lexicon, tuple(exceptions)
        self.intercept, self.slope = intercept, slope

    def __reduce__(self):
        return Model, (self.lexicon, self.exceptions, self.intercept, self.slope)

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        matcher = Matcher(self.lexicon, self.exceptions)
        out = []
        for text in texts:
            z = self.intercept + self.slope * math.log1p(matcher.rate(text or "")[0])
            out.append(1 / (1 + math.exp(-min(max(z, -60.0), 60.0))))
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **lexicon) -> Model:
    """Lexicon, exceptions and scale from labelled documents outside the held-out fold."""
    rows = saved(labelled_sample(docs, labels, sample), "toxic-sample")
    weights = learn_lexicon(rows, **lexicon)
    exceptions = learn_exceptions(rows, weights)
    return Model(weights, exceptions, *scale(rows, Matcher(weights, exceptions)))


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; only the text is read.

    Missing, empty and wordless texts have rate 0 and so the lowest score; equal texts have
    equal scores; an empty table gives no rows. A column called as the score is replaced."""
    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.scores(texts), index=texts.index, dtype="float64")

    return docs.withColumn(score, scored(F.col(text)))
