"""Toxicity by a weighted lexicon.

Texts are folded: lower case, homoglyphs of other scripts to Latin letters, digits and signs that stand for letters to
those letters, all else that isn't a letter to a space, and runs of spaces to one. An Aho-Corasick automaton finds the
lexicon's stems and words in one pass over the whole text, along with exception phrases; a stem inside an exception phrase
does not count. The sum of the weights found, divided by a power of the text's length in words, goes through a logistic curve.

The lexicon is learned from labelled texts: word stems and whole words of any length whose texts are almost always toxic and
too many for chance, first among all toxic texts and then among those that no stem explains yet. Their weights are smoothed
log odds. Exception phrases are two-word phrases with a stem in the second word that only occur in clean texts; callers can
give more. Learning uses at most ``sample`` labelled rows (a bound on rows; their texts are read whole), picked by a hash of
doc_id; the score of a text never depends on labels or its id.

Defined results: null and empty texts get the score of a text without any stem; with no toxic label to learn from, every
text gets score 0; texts of any length are scored whole; of stems that tell equally well the longest is taken, then the
last in order; rows are scored one by one, so repeated rows get equal scores; an empty table gives an empty result; other
columns are not read and stay as they are.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.base import drop_materialized, materialize

#: Letters of other scripts that look like Latin ones, and what stands for them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l"}
#: Lengths of the stems that are tried, besides whole words.
STEM_LENGTHS = (4, 5, 6, 7, 8)


class _Fold(dict):
    """A table for str.translate, filled in as characters come up."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full width
            c = chr(code - 0xFEE0).lower()
        c = HOMOGLYPHS.get(c) or SUBSTITUTES.get(c) or (c if c.isalpha() else " ")
        self[code] = ord(c[0])
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """The folded text, of the same length as ``text.lower()``."""
    return text.lower().translate(_FOLD)


def line(folded: str) -> tuple[str, int]:
    """The words with one space around each, and their number."""
    words = folded.split()
    return f" {' '.join(words)} ", len(words)


def stems(folded: str) -> set[str]:
    """Stems, and whole words with a space at the end; both match at word starts only."""
    words = set(folded.split())
    return {word[:k] for word in words for k in STEM_LENGTHS if len(word) >= k} | {word + " " for word in words}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -40.0
    #: The power of the length in words that a sum of weights is divided by.
    power: float = 0.25

    def automaton(self):
        """Pattern -> (weight, length without a space at the end, length of that space, whether it is an exception)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(" " + stem, (weight, len(stem.rstrip()) + 1, stem.endswith(" "), False))
        for phrase in self.exceptions:
            words = " ".join(fold(phrase).split())
            found.add_word(" " + words + " " * phrase.endswith(" "), (0.0, len(words) + 1, phrase.endswith(" "), True))
        found.make_automaton()
        return found

    def measure(self, text: str | None, automaton) -> float:
        """The length-normalised sum of weights."""
        if not text or not self.weights:
            return 0.0
        folded, words = line(fold(text))
        hits, covered = [], []
        for end, (weight, size, space, exception) in automaton.iter(folded):
            end += 1 - space
            (covered if exception else hits).append((end - size, end, weight))
        if not hits:
            return 0.0
        covered.sort()
        starts, reach = [x[0] for x in covered], list(accumulate((x[1] for x in covered), max))
        total = 0.0
        for start, end, weight in hits:
            at = bisect_right(starts, start)
            if not at or reach[at - 1] < end:
                total += weight
        return total / max(1, words) ** self.power

    def probability(self, measure: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * measure + self.offset))))


def score(text: Column, lexicon: Lexicon) -> Column:
    """The score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton() if lexicon.weights else None
        for texts in batches:
            yield pd.Series([lexicon.probability(lexicon.measure(t, automaton)) for t in texts], dtype="float64")

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def bounded_sample(labelled: DataFrame, sample: int) -> DataFrame:
    """labelled (doc_id, label) cut to ``sample`` rows by a hash of doc_id."""
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def learn(docs: DataFrame, labelled: DataFrame, sample: int = 20_000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """docs (doc_id, text) and labelled (doc_id, label 0 or 1) -> lexicon. Uses at most ``sample`` labelled texts."""
    chosen = F.broadcast(bounded_sample(labelled, sample))  # at most ``sample`` rows of two numbers
    # Read three times below.
    texts = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").filter("text is not null").select("label", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a task: stems by number of clean texts; for each toxic text its stems."""
        clean: Counter[str] = Counter()
        number = 0
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = stems(fold(text.as_py()))
                if label:
                    yield rows([-1], [sorted(found)])
                else:
                    number += 1
                    clean.update(found)
        yield rows([0], [[str(number)]])
        by_count: dict[int, list[str]] = {}
        for stem, n in clean.items():
            by_count.setdefault(n, []).append(stem)
        if by_count:
            yield rows(list(by_count), list(by_count.values()))

    def rows(n: list[int], found: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["n", "stems"])

    counted = materialize(texts.mapInArrow(count, "n long, stems array<string>"))
    toxic_texts = counted.filter("n = -1")
    toxic_number = toxic_texts.count()
    clean_number = sum(int(r["stems"][0]) for r in counted.filter("n = 0").collect())  # a row for each task
    if not toxic_number:
        return Lexicon(exceptions=exceptions)
    toxic = toxic_texts.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("toxic")).filter("toxic >= 3")
    clean = counted.filter("n > 0").select("n", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("n").alias("clean"))
    table = toxic.join(clean, "stem", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    candidates = {r["stem"]: (r["toxic"], r["clean"]) for r in table.filter("toxic >= 19 * clean").collect()}  # bounded by the sample
    if not candidates:
        return Lexicon(exceptions=exceptions)
    names = F.broadcast(candidates_frame(docs, candidates))
    held = toxic_texts.withColumn("at", F.monotonically_increasing_id()).select("at", F.explode("stems").alias("stem")).join(names, "stem").groupBy("at").agg(F.collect_list("stem").alias("stems"))
    texts_by_stem: dict[str, set[int]] = {}
    for k, r in enumerate(held.collect()):  # a row for each toxic text of the sample at most
        for stem in r["stems"]:
            texts_by_stem.setdefault(stem, set()).add(k)
    weights: dict[str, float] = {}
    open_texts, total = set().union(*texts_by_stem.values()), toxic_number + clean_number
    unexplained = toxic_number
    while True:
        # Chance that n texts with a stem are all among the unexplained toxic ones, over all candidates.
        least = max(3.0, (math.log(len(candidates)) + 2.3) / max(0.5, math.log(total / max(1, unexplained))))
        best = max(((len(held_by & open_texts), not stem.endswith(" "), -len(stem), stem) for stem, held_by in texts_by_stem.items() if stem not in weights), default=None)
        if not best or best[0] < least:
            break
        stem = best[-1]
        # The longest stem with the same texts is the most specific; its shorter forms add nothing.
        longer = [s for s in texts_by_stem if s == stem or s.startswith(stem) and s[-1] != " " and len(texts_by_stem[s]) >= 0.98 * len(texts_by_stem[stem])]
        stem = max(longer, key=lambda s: (len(s), s))
        t, c = candidates[stem]
        weights[stem] = math.log((t + 0.5) / (toxic_number + 1)) - math.log((c + 0.5) / (clean_number + 1))
        covered = texts_by_stem[stem] & open_texts
        open_texts -= covered
        unexplained -= len(covered)
        texts_by_stem.pop(stem)
    # Stems that pass the same test on all toxic texts join too, so that each hit counts.
    least = max(3.0, (math.log(len(candidates)) + 2.3) / max(0.5, math.log(total / toxic_number)))
    for stem, (t, c) in sorted(candidates.items(), key=lambda x: (len(x[0]), x[0])):
        if t >= least and t >= 19 * c and not any(stem.startswith(w) or w.startswith(stem) for w in weights):
            weights[stem] = math.log((t + 0.5) / (toxic_number + 1)) - math.log((c + 0.5) / (clean_number + 1))
    lexicon = Lexicon(weights, exceptions)
    if not weights:
        return lexicon
    lexicon.exceptions = exceptions + _learned_exceptions(texts, lexicon)
    _calibrate(lexicon, texts)
    drop_materialized(texts, counted)
    return lexicon


def candidates_frame(docs: DataFrame, candidates: dict) -> DataFrame:
    return docs.sparkSession.createDataFrame([(s,) for s in candidates], "stem string")


def _learned_exceptions(texts: DataFrame, lexicon: Lexicon, least: int = 5) -> tuple[str, ...]:
    """Phrases of a word and a stem that at least ``least`` clean texts and no toxic text hold."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = set()
            for k, (label, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                folded, _ = line(fold(text.as_py()))
                for end, (_, size, space, exception) in automaton.iter(folded):
                    at = end - space - size + 1  # of the space before the stem
                    if at and not exception:
                        out.add((k, label, folded[folded.rfind(" ", 0, at) + 1 : end + 1]))
            found = [x[1:] for x in out]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], ["label", "phrase"])

    table = texts.mapInArrow(phrases, "label int, phrase string").groupBy("phrase").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    return tuple(sorted(r["phrase"] for r in table.filter(f"toxic = 0 and clean >= {least}").collect()))  # bounded by the sample


def _calibrate(lexicon: Lexicon, texts: DataFrame) -> None:
    """Fit slope and offset of the logistic curve on the sample's measures, with a small penalty."""

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [round(lexicon.measure(t.as_py(), automaton), 2) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["label", "measure"])

    import numpy as np

    rows = texts.mapInArrow(measures, "label int, measure double").groupBy("label", "measure").count().collect()  # at most a row for each text of the sample
    y, x, n = (np.array([r[k] for r in rows], float) for k in ("label", "measure", "count"))
    scale = max(1e-9, float(np.abs(x).max()))
    features = np.stack([np.minimum(x / scale, 1), np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (n * (p - y)) + np.array([1e-3, 1e-3]) * w
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    lexicon.slope, lexicon.offset = max(0.0, float(w[0])) / scale, float(w[1])
