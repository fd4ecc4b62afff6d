"""Weak supervision of text quality.

Rules vote good (1), bad (-1) or abstain (0) on measures of a whole text.  Nobody labels
anything: expectation-maximisation over the counts of vote patterns estimates how common
good texts are and how each rule votes, rightly or wrongly, on good and on bad ones.  The posterior
probability that a text is good then decides, in place of a demand that every rule pass.

Patterns are counted over all rows; there are ``3 ** rules`` at most, whatever the
corpus, so only that many counts reach the driver.

Defined cases: a null, empty or wordless text has zero for every measure and fails the
base check; rows are judged one by one, so repeated rows, ties and null ids need no
rule; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.llm.words import byte_words
from foreledger.sources.stored import stored

# Fixed values of the base check.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts",
    "n_bare_words")
KEEP_FROM = 0.5
_SMALL_IDS = 1 << 21


def _repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words covered by a three-word window that occurs twice or more."""
    if len(ids) < 4:
        return 0
    first = ids[:-2] * distinct + ids[1:-1]
    if distinct > _SMALL_IDS:
        first = np.unique(first, return_inverse=True)[1]
    keys = first * distinct + ids[2:]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= hit
    return int(covered.sum())


def measures_of(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    blocks = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in byte_words(text)]
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    without = lambda chars: len(data) - len(data.translate(None, chars))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    bare = np.fromiter((not w.translate(None, _MARKS) for w in number), bool, len(number))
    letters = len(text) - without(_NOT_LETTERS)
    return (len(ids), len(text) - without(_SPACES), without(SYMBOLS), dups, _repeated_words(ids, len(number)), lines,
            without(_UPPER), letters, data.count(b"!"), int(bare[ids].sum()))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measures_of(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=[key, *MEASURES])

    rows = docs.select(F.col(key), F.col(text))
    kinds = ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {kinds}")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(measure: Column, good: tuple[float, float], bad_below: float | None, bad_above: float | None) -> Column:
    """1 inside the range ``good``, -1 beyond the bad bounds, 0 between."""
    out = F.when(measure.between(*good), 1)
    if bad_below is not None:
        out = out.when(measure < bad_below, -1)
    if bad_above is not None:
        out = out.when(measure > bad_above, -1)
    return out.otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes on the measures; each names its range of good values and its bad bounds."""
    return {
        "r_length": _vote(F.col("n_words"), (80, 10**12), 30, None),
        "r_word_size": _vote(_share("word_chars", "n_words"), (3.0, 8.5), 2.0, 12.0),
        "r_symbols": _vote(_share("n_symbols", "n_words"), (0.0, 0.02), None, 0.1),
        "r_lines": _vote(_share("n_dup_lines", "n_lines"), (0.0, 0.05), None, 0.5),
        "r_repeats": _vote(_share("n_repeat_words", "n_words"), (0.0, 0.15), None, 0.4),
        "r_capitals": _vote(_share("n_upper", "n_letters"), (0.0, 0.15), None, 0.3),
        "r_letters": _vote(_share("n_letters", "word_chars"), (0.8, 1.0), 0.72, None),
        "r_bare_words": _vote(_share("n_bare_words", "n_words"), (0.0, 0.02), None, 0.1),
        "r_shouts": _vote(_share("n_shouts", "n_words"), (0.0, 0.02), None, 0.15),
    }


# Prior rates of the votes (bad, abstain, good) on bad and on good texts, and their weight
# in votes: a rule is rarely wrong about a good text and misses most kinds of bad ones.
PRIOR_ON_BAD, PRIOR_ON_GOOD = (0.15, 0.35, 0.5), (0.005, 0.095, 0.9)
PRIOR_GOOD, PRIOR_VOTES = 0.8, 10.0


@dataclass
class LabelModel:
    """Share of good texts, and the rates of each rule's votes on bad and on good ones.

    ``on_bad`` and ``on_good`` are (rules, 3): votes -1, 0 and 1.
    """

    good: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def weights(self) -> np.ndarray:
        """(rules, 3) log odds of a good text; a bad vote never speaks for it, a good one never against."""
        out = np.log(self.on_good / self.on_bad)
        out[:, 0] = np.minimum(out[:, 0], 0)
        out[:, 2] = np.maximum(out[:, 2], 0)
        return out

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        w = self.weights()
        return np.log(self.good / (1 - self.good)) + w[np.arange(votes.shape[1]), votes + 1].sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """Share of each rule's votes, abstentions left out, that are right."""
        right = self.good * self.on_good[:, 2] + (1 - self.good) * self.on_bad[:, 0]
        wrong = self.good * self.on_good[:, 0] + (1 - self.good) * self.on_bad[:, 2]
        return right / (right + wrong)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 1000, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation on vote patterns (-1, 0, 1) and their counts."""
    n_rules = votes.shape[1]
    prior_bad, prior_good = np.array(PRIOR_ON_BAD), np.array(PRIOR_ON_GOOD)
    model = LabelModel(PRIOR_GOOD, np.tile(prior_bad, (n_rules, 1)), np.tile(prior_good, (n_rules, 1)))
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(model.log_odds(votes), -500, 500)))
        good, bad = counts * p, counts * (1 - p)
        fresh = LabelModel(
            float((good.sum() + PRIOR_GOOD * PRIOR_VOTES) / (counts.sum() + PRIOR_VOTES)),
            (np.einsum("p,prv->rv", bad, cast) + PRIOR_VOTES * prior_bad) / (bad.sum() + PRIOR_VOTES),
            (np.einsum("p,prv->rv", good, cast) + PRIOR_VOTES * prior_good) / (good.sum() + PRIOR_VOTES))
        moved = max(abs(fresh.good - model.good), np.abs(fresh.on_good - model.on_good).max(),
                    np.abs(fresh.on_bad - model.on_bad).max())
        model = fresh
        if moved < tolerance:
            break
    return model


def posterior(model: LabelModel, names: list[str]) -> Column:
    """Probability of a good text from the votes, as a Spark expression."""
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for name, (bad, none, good) in zip(names, model.weights().tolist()):
        odds = odds + F.when(F.col(name) == 1, good).when(F.col(name) == -1, bad).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """(key, measures, votes, base_failed, quality, kept) of every row."""
    votes = rules()
    names = list(votes)
    marked = stored(measured(docs, key, text).withColumns(votes), "votes")
    patterns = marked.groupBy(*names).agg(F.count("*").alias("rows")).toPandas().sort_values(names)
    model = fit_label_model(patterns[names].to_numpy(int), patterns["rows"].to_numpy(float))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return marked.withColumn("base_failed", failed).withColumn("quality", posterior(model, names)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
