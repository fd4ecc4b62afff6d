"""Language identification with interpolated Kneser-Ney character models.

Each language has one model of order four.  Raw counts of the highest order come from
every labelled training text; lower orders use continuation counts.  All languages share
sorted arrays of n-gram hashes, each with a matrix of fully interpolated log
probabilities, so one binary search scores a position for every language; what is
missing backs off through sorted arrays of context hashes.  The language of least
cross-entropy per character wins.  A calibration fold, not used for the counts, gives the
probability that the winner is right and the excess of cross-entropy beyond which a text
is rejected as none of the languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; null labels are not learned; rows with a null id are scored, not learned;
repeated rows count as often as they stand; ties go to the first label by name; with no
training text every row is ``und``; other columns are ignored; texts of any length are
scored in blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreledger.sources.stored import stored

ORDER = 4
UNKNOWN = "und"
# Default bound of most_frequent(), which fit() does not use: a cut list changes discounts
# and continuation counts, so the arrays hold every n-gram and grow with them.
MODEL_GRAMS = 400_000
BLOCK_CHARS = 1 << 17
FLUSH_GRAMS = 400_000
FOLDS, HELD_FOLD, CALIBRATION_FOLD = 4, 2, 3
REJECT_SHARE = 1e-4
REJECT_SLACK = 1.5
# Distinct calibration texts at which a language's own values weigh as much as the pooled
# ones; share of the pooled spread below which none falls.
SHRINK_TEXTS, LEAST_SPREAD = 10, 0.5
# A language learned from few texts is badly predicted: its mean is unsure by this share
# at least, in variance divided by one more than its distinct calibration texts.
UNSURE_SHARE = 0.5
# Spreads a normal value exceeds at the rate of REJECT_SHARE; few texts do not show their tail.
LEAST_LIMIT = 3.72
_EVIDENCE_STEP, _EVIDENCE_BINS = 0.25, 256
_LENGTH_CAP = 400
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded code point, a space where it is no letter or mark; and whether it is a letter."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            fold[c] = ord(chr(c).lower()[0])
            letter[c] = kind == "L"
    return fold, letter


def folded(text: str | None) -> np.ndarray | None:
    """Lower-case letters with single spaces between, padded; None without a letter."""
    if not text:
        return None
    fold, letter = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[codes].any():
        return None
    flat = fold[codes]
    space = flat == 32
    space[1:] &= space[:-1]
    flat = flat[~space]
    head = np.full(ORDER - 1, 32, np.uint32)
    return np.concatenate([head, flat[int(flat[0] == 32):], [32] * int(flat[-1] != 32)]).astype(np.uint32)


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each code, for n from 1 to ``order``.

    The first ``n - 1`` of each array lack their context and mean nothing.
    """
    one = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    one ^= one >> np.uint64(32)
    out = [one]
    for _ in range(order - 1):
        longer = out[0] + np.uint64(0)
        longer[1:] += out[-1][:-1] * _ODD
        out.append(longer)
    return out


@dataclass
class Table:
    """Sorted hashes with a row of log probabilities or weights for every language."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], values[order].astype(np.float32))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of every wanted hash."""
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == wanted


@dataclass
class Model:
    langs: list[str]
    grams: list[Table] = field(default_factory=list)
    contexts: list[Table] = field(default_factory=list)
    floor: np.ndarray | None = None
    slope: float = 1.0
    bias: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf

    def log2(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """log2 P of the code at each place, one column per language."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            table = self.grams[n - 1]
            place, found = table.find(hashes[n - 1][at[todo]])
            out[todo[found]] += table.values[place[found]]
            todo = todo[~found]
            if not len(todo):
                return out
            if n > 1:
                weights = self.contexts[n - 2]
                place, found = weights.find(hashes[n - 2][at[todo] - 1])
                out[todo[found]] += weights.values[place[found]]
        out[todo] += self.floor
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits per character of folded texts, one column per language."""
        out = np.zeros((len(texts), len(self.langs)))
        for k, codes in enumerate(texts):
            hashes = gram_hashes(codes, ORDER)
            for a in range(ORDER - 1, len(codes), BLOCK_CHARS):
                at = np.arange(a, min(a + BLOCK_CHARS, len(codes)))
                out[k] -= self.log2(hashes, at).sum(axis=0, dtype=np.float64)
            out[k] /= len(codes) - ORDER + 1
        return out

    def decide(self, texts: list[str | None]) -> pd.DataFrame:
        """(pred, best, second, n, score, rejected) of raw texts."""
        codes = [folded(t) if self.langs else None for t in texts]
        rows = [k for k, c in enumerate(codes) if c is not None]
        out = pd.DataFrame({
            "pred": np.full(len(texts), UNKNOWN, object), "best": np.nan, "second": np.nan, "n": 0,
            "score": 0.0, "rejected": True})
        if not rows:
            return out
        h = self.entropies([codes[k] for k in rows])
        first = h.argmin(axis=1)
        best = h.min(axis=1)
        second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else np.full(len(h), np.inf)
        n = np.array([len(codes[k]) - ORDER + 1 for k in rows])
        x = evidence(best, second, n)
        score = 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -40, 40)))
        rejected = np.zeros(len(rows), bool)
        if self.mean is not None:
            rejected = excess(best, n, self.mean[first], self.spread[first]) > self.limit
        found = pd.DataFrame({
            "pred": np.array(self.langs, object)[first], "best": best, "second": second, "n": n, "score": score,
            "rejected": rejected}, index=rows)
        out.loc[rows] = found.astype(out.dtypes.to_dict())
        return out


def evidence(best: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    top = _EVIDENCE_STEP * _EVIDENCE_BINS
    return np.minimum((np.minimum(second, 1e6) - best) * np.sqrt(n), top)


def excess(best: np.ndarray, n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Cross-entropy above a language's mean, in spreads of texts of that length."""
    return (best - mean) * np.sqrt(np.minimum(n, _LENGTH_CAP)) / spread


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over a task, given out whenever the sums grow large."""
    sums: dict[tuple[str, str], int] = {}

    def given() -> pa.RecordBatch:
        lang, gram = zip(*sums) if sums else ((), ())
        out = pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(sums.values(), pa.int64())],
            names=["lang", "gram", "n"])
        sums.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            codes = folded(text.as_py())
            if codes is None:
                continue
            label = lang.as_py()
            ends = gram_hashes(codes, ORDER)[-1][ORDER - 1:]
            for a in range(0, len(ends), 1 << 20):
                _, first, n = np.unique(ends[a:a + (1 << 20)], return_index=True, return_counts=True)
                grams = np.ascontiguousarray(codes[(first + a)[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()
                for gram, k in zip(grams.tolist(), n.tolist()):
                    sums[label, gram] = sums.get((label, gram), 0) + k
            if len(sums) > FLUSH_GRAMS:
                yield given()
    yield given()


def fold_of(key: str) -> Column:
    """crc32 of the id as text, modulo four; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def gram_counts(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all texts of the counting folds, summed in the tasks first."""
    learn = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~fold_of(key).isin(
        HELD_FOLD, CALIBRATION_FOLD))
    partial = learn.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(
        _count_rows, "lang string, gram string, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, total: int = MODEL_GRAMS) -> DataFrame:
    """The most frequent n-grams of each language, ``total`` over all languages at most.

    The cut is a count found from the number of n-grams by count; ties at it all go.
    """
    langs = max(counts.agg(F.count_distinct("lang")).first()[0], 1)
    by_count = counts.groupBy("lang", "n").agg(F.count("*").alias("grams"))
    running = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    cuts = by_count.withColumn("upto", running).filter(F.col("upto") <= total // langs).groupBy("lang").agg(
        F.min("n").alias("cut"))
    return counts.join(cuts, "lang").filter("n >= cut").select("lang", "gram", "n")


def _hash_strings(grams: np.ndarray, n: int) -> np.ndarray:
    """Hashes of strings of n characters, as :func:`gram_hashes` gives them at the last one."""
    codes = np.ascontiguousarray(grams.astype(f"<U{n}")).view(np.uint32).reshape(-1, n)
    one = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    one ^= one >> np.uint64(32)
    out = one[:, 0]
    for k in range(1, n):
        out = one[:, k] + out * _ODD
    return out


def build_model(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney from (lang, gram, n) of the highest order."""
    langs = sorted(counts["lang"].unique())
    model = Model(langs)
    if not langs:
        return model
    column = {lang: k for k, lang in enumerate(langs)}
    levels = [counts[["lang", "gram", "n"]]]
    for _ in range(ORDER - 1):
        upper = levels[0]
        lower = upper.assign(gram=upper["gram"].str[1:]).groupby(["lang", "gram"], as_index=False).size()
        levels.insert(0, lower.rename(columns={"size": "n"}))
    symbols = levels[0]["gram"].nunique() + 1
    base_index, base = pd.Index([""]), np.full((1, len(langs)), 1.0 / symbols)
    for n, level in enumerate(levels, 1):
        ones = level[level["n"] == 1].groupby("lang").size().reindex(langs, fill_value=0)
        twos = level[level["n"] == 2].groupby("lang").size().reindex(langs, fill_value=0)
        discount = (ones / (ones + 2 * twos)).fillna(0.5).clip(0.1, 0.9)
        level = level.assign(ctx=level["gram"].str[:-1], d=level["lang"].map(discount))
        stats = level.groupby(["lang", "ctx"]).agg(total=("n", "sum"), kinds=("n", "size"), d=("d", "first"))
        weight = (stats["d"] * stats["kinds"] / stats["total"]).rename("w").reset_index()
        ctx_index = pd.Index(weight["ctx"].unique())
        gamma = np.ones((len(ctx_index), len(langs)))
        gamma[ctx_index.get_indexer(weight["ctx"]), weight["lang"].map(column)] = weight["w"]
        index = pd.Index(level["gram"].unique())
        total = stats["total"].reindex(pd.MultiIndex.from_frame(level[["lang", "ctx"]])).to_numpy()
        probs = np.zeros((len(index), len(langs)))
        probs[index.get_indexer(level["gram"]), level["lang"].map(column)] = (level["n"] - level["d"]) / total
        suffix = base_index.get_indexer(index.str[1:] if n > 1 else pd.Index([""] * len(index)))
        probs += gamma[ctx_index.get_indexer(index.str[:-1])] * base[suffix]
        model.grams.append(Table.of(_hash_strings(index.to_numpy(), n), np.log2(probs)))
        if n == 1:
            model.floor = np.log2(gamma[0] / symbols).astype(np.float32)
        else:
            model.contexts.append(Table.of(_hash_strings(ctx_index.to_numpy(), n - 1), np.log2(gamma)))
        base_index, base = index, probs
    return model


def _decisions(docs: DataFrame, model, text: str, keep: list[Column], names: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with the model's decision."""
    rows = docs.select(*[c.alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"))
    told = "pred string, best double, second double, n long, score double, rejected boolean"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.RecordBatch.from_pandas(model.value.decide(batch.column("__text").to_pylist()), preserve_index=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[found.column(k).cast(t) for k, t in enumerate(
                    (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()))]],
                names=[*names, *found.schema.names])

    return rows.mapInArrow(run, f"{kept}, {told}")


def _platt(x: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic map, with Platt's targets, by Newton steps."""
    good, bad = (right.sum() + 1) / (right.sum() + 2), 1 / (wrong.sum() + 2)
    n, y = right + wrong, right * good + wrong * bad
    if not n.sum():
        return 1.0, 0.0
    w = np.array([0.1, np.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5))])
    design = np.stack([x, np.ones_like(x)], axis=1)
    ridge = 1e-3 * np.eye(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (y - n * p) - ridge @ w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _shrunk(own: np.ndarray, kinds: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of every language, drawn to pooled values where it has few distinct texts.

    ``own`` is the mean of ``kinds`` distinct texts, ``squares`` the sum of their squared
    offsets times length.  A mean is only ever raised, and what is unknown of it widens
    the spread: a text is not rejected because its language is rare.
    """
    known = kinds > 0
    within = squares.sum() / max(kinds.sum() - known.sum(), 1)
    between = own[known].var(ddof=1) if known.sum() > 1 else 0.0
    between = max(between, within / _LENGTH_CAP, (UNSURE_SHARE * own[known].mean()) ** 2)
    weight = kinds / (kinds + SHRINK_TEXTS)
    mean = np.where(known, np.maximum(own, weight * own + (1 - weight) * own[known].mean()), own[known].mean())
    single = np.where(kinds > 1, squares / np.maximum(kinds - 1, 1), within)
    spread = np.sqrt(weight * single + (1 - weight) * within + _LENGTH_CAP * between / (1 + kinds))
    return mean, np.maximum(spread, LEAST_SPREAD * np.sqrt(within) + 1e-3)


def calibrate(model: Model, docs: DataFrame, key: str, text: str, lang: str) -> Model:
    """Fit the score and the rejection limit on the calibration fold.

    Only sums per language and histograms of fixed size reach the driver.
    """
    if not model.langs:
        return model
    share = docs.sparkSession.sparkContext.broadcast(model)
    fold = docs.filter(F.col(lang).isNotNull() & (fold_of(key) == CALIBRATION_FOLD))
    told = stored(_decisions(
        fold, share, text, [F.col(lang).cast("string"), F.xxhash64(F.col(text))], ["lang", "tx"]).filter("n > 0"), "calibration")
    x = F.least((F.least("second", F.lit(1e6)) - F.col("best")) * F.sqrt("n"), F.lit(_EVIDENCE_STEP * _EVIDENCE_BINS))
    bins = told.groupBy(F.floor(x / _EVIDENCE_STEP).alias("b")).agg(
        F.count_if(F.col("lang") == F.col("pred")).alias("right"),
        F.count_if(F.col("lang") != F.col("pred")).alias("wrong")).toPandas().sort_values("b")
    model.slope, model.bias = _platt(
        (bins["b"].to_numpy(float) + 0.5) * _EVIDENCE_STEP, bins["right"].to_numpy(float), bins["wrong"].to_numpy(float))
    right = told.filter(F.col("lang") == F.col("pred"))
    length = F.sqrt(F.least("n", F.lit(_LENGTH_CAP)))
    texts = right.groupBy("lang", "tx").agg(F.first("best").alias("best"), F.first("n").alias("n"))
    seen = {r["lang"]: r for r in texts.groupBy("lang").agg(F.avg("best").alias("m"), F.count("*").alias("k")).collect()}
    own = np.array([seen[k]["m"] if k in seen else 0.0 for k in model.langs])
    kinds = np.array([seen[k]["k"] if k in seen else 0 for k in model.langs])
    own_pairs = [F.lit(v) for k, m in zip(model.langs, own) for v in (k, float(m))]
    near = (F.col("best") - F.element_at(F.create_map(*own_pairs), F.col("lang"))) * length
    squares = {r["lang"]: r["s"] for r in texts.groupBy("lang").agg(F.sum(near * near).alias("s")).collect()}
    if (kinds > 1).any():
        model.mean, model.spread = _shrunk(own, kinds, np.array([squares.get(k, 0.0) for k in model.langs]))
    else:
        return model
    pairs = [F.lit(v) for k, m in zip(model.langs, model.mean) for v in (k, float(m))]
    off = (F.col("best") - F.element_at(F.create_map(*pairs), F.col("lang"))) * length
    widths = [F.lit(v) for k, s in zip(model.langs, model.spread) for v in (k, float(s))]
    z = F.floor(off / F.element_at(F.create_map(*widths), F.col("lang")) * 10)
    tail = right.groupBy(F.greatest(F.least(z, F.lit(10_000)), F.lit(0)).alias("z")).agg(
        F.count("*").alias("k")).toPandas().sort_values("z", ascending=False)
    if len(tail):
        allowed = REJECT_SHARE * tail["k"].sum()
        inside = tail[tail["k"].cumsum() > allowed]
        model.limit = REJECT_SLACK * max((float(inside["z"].iloc[0]) + 1) / 10, LEAST_LIMIT)
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from labelled rows outside the held-out fold; every n-gram counts."""
    counts = stored(gram_counts(docs, key, text, lang), "grams")
    model = build_model(counts.toPandas())
    return calibrate(model, docs, key, text, lang)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected, bits_per_char) of every row."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold_of(key) == HELD_FOLD, F.lit(False))
    told = _decisions(docs, share, text, [F.col(key), held], [key, "held_out"])
    return told.select(
        key, "held_out", F.col("pred").alias("lang_pred"), "score", "rejected", F.col("best").alias("bits_per_char"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is in one of the model's languages; no shuffle."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = share.value.decide(batch.column(text).to_pylist())
            yield batch.filter(pa.array(~found["rejected"].to_numpy(bool)))

    return docs.mapInArrow(run, docs.schema)
