"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, one of the labelled toxic texts and one of the ordinary ones, of two orders. As in Kneser-Ney's
orders below the highest, a pair of words counts by how many different words it follows, and a word by how many
different words it follows, not by how often they occur, so a passage that is copied or a line that is repeated counts
once. In each class the counts of pairs are discounted, and what that frees goes to the second word's own estimate; its
counts are discounted, and what that frees goes to the word's stem, of which the word gets the share that it has in the
counts of both classes; the stem's counts are discounted and smoothed by those of both classes in turn. So a rare
expression says no more than the words that look alike, and one that a class prefers says much. Discounts follow from
the counts of counts, as in modified Kneser-Ney; what occurs in one or two contexts only is discounted whole.

A text is compared by the difference of its two log-likelihoods per word, under either order, as a whole and in windows: a long
text with a few toxic sentences is ordinary on average, and its worst window isn't. A logistic regression on
these differences, fitted on labelled rows that the models were not trained on, turns them into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release

#: Bounds of the sample of labelled rows on which the models are fitted: rows and bytes of text, half of either for each class.
MOST_ROWS = 12_000
MOST_BYTES = 16_000_000
#: A labelled text that would take more than this share of the bytes is passed over in the sample.
MOST_OF_BYTES = 1 / 32
FOLDS = 2
#: Bytes of a word's stem, to which it backs off.
STEM = 4
#: Words of the windows whose most toxic is compared, beside the whole text, by words and by pairs.
WINDOWS, PAIR_WINDOWS = (1, 4, 20), (20,)
FEATURES = 1 + 1 + len(WINDOWS) + 1 + len(PAIR_WINDOWS)
RIDGE = 0.3
#: Words, stems and pairs with less than so many contexts in the sample, both classes together, are left to the backoff. So
#: the model has one of each for so many words of the sample at most, and its size is bounded by the sample's.
LEAST_COUNT = 5
STRIP = b".,;:!?\"'()[]*%$&#|"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without punctuation at their ends."""
    return [w for w in (x.strip(STRIP) for x in (text or b"").lower().split()) if w]


def _windows(r: np.ndarray, sizes: tuple[int, ...]) -> list[float]:
    """The mean, and the largest of each size of window over its size; 0 of no words."""
    if not len(r):
        return [0.0] * (1 + len(sizes))
    sums = np.r_[0.0, np.cumsum(r)]
    out = [sums[-1] / len(r)]
    for size in sizes:
        k = min(size, len(r))
        out.append(float((sums[k:] - sums[:-k]).max()) / size)
    return out


def discount(counts: np.ndarray) -> float:
    """Modified Kneser-Ney's discount of counts of 3 or more, 3 - 4 Y n4 / n3 with Y = n1 / (n1 + 2 n2); 2 at least, as
    counts of 1 and 2 are discounted whole."""
    n1, n2, n3, n4 = ((counts == k).sum() for k in (1, 2, 3, 4))
    if not n1 or not n3:
        return 2.0
    return float(max(2.0, 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3))


def _smoothed(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P of each column in each class (row) from ``counts``, discounted, and what is freed times ``lower``; and what is freed."""
    d = np.array([[discount(c)] for c in counts])
    total = np.maximum(counts.sum(1), 1)[:, None]
    freed = np.maximum(np.minimum(counts, d).sum(1), 0.5)[:, None] / total
    return np.maximum(counts - d, 0) / total + freed * lower, freed


@dataclass
class Ratios:
    """log P(. | toxic) - log P(. | ordinary): of words by number (their stems' where they aren't kept), of stems, of what is
    unseen, of kept pairs (their keys are sorted), and of what a context frees."""

    words: np.ndarray
    stems: np.ndarray
    unseen: float
    keys: np.ndarray
    pairs: np.ndarray
    freed: np.ndarray
    kept: np.ndarray

    def features(self, number: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """1, and the differences of a text; its words and their stems by number, -1 if unknown."""
        one = np.where(number >= 0, self.words[number], np.where(stem >= 0, self.stems[stem], self.unseen))
        before = np.r_[0, number[:-1]] if len(number) else number
        two = one + np.where(before >= 0, self.freed[before], 0.0)
        if len(self.keys):
            key = before * len(self.words) + number
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            two = np.where((self.keys[at] == key) & (before >= 0) & (number >= 0), self.pairs[at], two)
        return np.array([1.0, *_windows(one, WINDOWS), *_windows(two, PAIR_WINDOWS)])


def fit_ratios(texts: list[np.ndarray], toxic: list[int], stem_of: np.ndarray) -> Ratios:
    """Kneser-Ney models of both classes. Texts are numbers of words; 0 is no word but what stands before the first."""
    n = len(stem_of)
    words, pairs = np.zeros((2, n)), []
    for y in (0, 1):
        own = [t for t, z in zip(texts, toxic) if z == y and len(t)]
        if not own:
            pairs.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        key = np.concatenate([np.r_[0, t[:-1]] * n + t for t in own])
        before = np.concatenate([np.r_[0, 0, t[:-2]][: len(t)] for t in own])
        distinct, at = np.unique(key, return_inverse=True)
        words[y] = np.bincount(distinct % n, minlength=n)
        pairs.append((distinct, np.bincount(np.unique(at * n + before) // n, minlength=len(distinct))))
    stems = np.stack([np.bincount(stem_of, c) for c in words])
    both, both_stems = words.sum(0), stems.sum(0)
    p_stem, freed_stems = _smoothed(stems, (both_stems + 1) / (both_stems.sum() + len(both_stems) + 1))
    p_word, freed = _smoothed(words, (both + 1) / (both_stems[stem_of] + 1) * p_stem[:, stem_of])
    log_ratio = lambda p: np.log(p[1] / p[0])
    unseen = float(log_ratio(freed)[0])
    lowest = unseen + float(log_ratio(freed_stems)[0])
    stem_ratio = np.where(both_stems >= LEAST_COUNT, unseen + log_ratio(p_stem), lowest)
    kept = both >= LEAST_COUNT
    # Pairs: a count that is discounted whole, or of a pair that isn't kept, is freed.
    keys = np.unique(np.concatenate([k for k, _ in pairs]))
    counts = np.zeros((2, len(keys)))
    for y, (k, c) in enumerate(pairs):
        counts[y][np.searchsorted(keys, k)] = c
    stay = counts.sum(0) >= LEAST_COUNT
    gain = np.where(stay, np.maximum(counts - np.array([[discount(c)] for c in counts]), 0), 0)
    context, left = (np.stack([np.bincount(keys // n, x, n) for x in z]) for z in (counts, gain))
    free = np.where(context > 0, (context - left) / np.maximum(context, 1), 1.0)
    keys, gain = keys[stay], gain[:, stay]
    p_pair = gain / np.maximum(context[:, keys // n], 1) + free[:, keys // n] * p_word[:, keys % n]
    return Ratios(np.where(kept, log_ratio(p_word), stem_ratio[stem_of]), stem_ratio, lowest, keys, log_ratio(p_pair), log_ratio(free), kept)


@dataclass
class Model:
    """The numbers of the words and stems that are kept, their ratios, and the scale."""

    words: dict[bytes, int]
    stems: dict[bytes, int]
    ratios: Ratios
    weights: np.ndarray

    def features(self, words: list[bytes]) -> np.ndarray:
        find, stem = self.words.get, self.stems.get
        return self.ratios.features(np.fromiter((find(w, -1) for w in words), np.int64, len(words)), np.fromiter((stem(w[:STEM], -1) for w in words), np.int64, len(words)))

    def score(self, text: bytes | None) -> float:
        z = float(self.features(words_of(text)) @ self.weights) if text else float(self.weights[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def packed(r: Ratios, known: dict[bytes, int], stem_number: dict[bytes, int], weights: np.ndarray) -> Model:
    """Without the words and stems that say nothing of their own."""
    n = len(r.words)
    wanted = r.kept.copy()
    wanted[0] = True
    wanted[np.r_[r.keys // n, r.keys % n]] = True
    wanted[r.freed != 0] = True
    number = np.cumsum(wanted) - 1
    told = r.stems != r.unseen
    told[0] = True
    stem = np.cumsum(told) - 1
    small = Ratios(r.words[wanted], r.stems[told], r.unseen, number[r.keys // n] * int(wanted.sum()) + number[r.keys % n], r.pairs, r.freed[wanted], r.kept[wanted])
    return Model({w: int(number[k]) for w, k in known.items() if wanted[k]}, {w: int(stem[k]) for w, k in stem_number.items() if told[k]}, small, weights)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 100) -> np.ndarray:
    """Newton's method, halving steps that don't help, on scaled features with a ridge on all but the first weight."""
    mean, scale = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.c_[x[:, 0], (x[:, 1:] - mean) / scale]
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale]


def fit(texts: list[bytes | None], toxic: list[int], share: float | None = None) -> Model:
    """The scale is learned on rows whose words were left out of the models, in ``FOLDS`` folds. ``share`` of all
    labels is toxic; the rows are weighed so that they are, too."""
    known: dict[bytes, int] = {b"": 0}
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int64) for t in texts]
    stem_number: dict[bytes, int] = {}
    stem_of = np.fromiter((stem_number.setdefault(w[:STEM], len(stem_number)) for w in known), np.int64, len(known))
    x, y = [], []
    for k in range(FOLDS):
        rest = [i for i in range(len(texts)) if i % FOLDS != k]
        r = fit_ratios([numbers[i] for i in rest], [toxic[i] for i in rest], stem_of)
        for i in range(k, len(texts), FOLDS):
            if len(numbers[i]):
                x.append(r.features(numbers[i], stem_of[numbers[i]]))
                y.append(toxic[i])
    own = sum(y) / max(1, len(y))
    weigh = lambda v: 1.0 if share is None else share / own if v else (1 - share) / (1 - own)
    weights = logistic(np.array(x).reshape(-1, FEATURES), np.array(y, float), np.array([weigh(v) for v in y])) if 0 < sum(y) < len(y) else np.r_[-3.0 if not sum(y) else 3.0, np.zeros(FEATURES - 1)]
    model = packed(fit_ratios(numbers, toxic, stem_of), known, stem_number, weights)
    del numbers, known, stem_number, stem_of, x
    release()  # the driver lives on
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES,
) -> tuple[list[bytes | None], list[int], float | None]:
    """At most ``most_rows`` labelled rows of ``most_bytes`` of text, at most half of either from each class, in the order of
    their ids' hashes; only rows for which ``held_out`` is not true, and whose label is 0 or 1. An id with both labels is toxic.
    Texts of more than ``MOST_OF_BYTES`` of the bytes are passed over. Third, the share of toxic among all such rows."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    if held_out is not None:
        rows = rows.withColumnRenamed("id", id_col).where(~F.coalesce(held_out, F.lit(False))).withColumnRenamed(id_col, "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    share = rows.agg(F.avg("y")).head()[0]
    order = F.xxhash64("id", F.lit(5))
    picked = [rows.where(F.col("y") == y).orderBy(order, "id").limit(most_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most most_rows rows of two numbers
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    found = docs.where(size <= int(most_bytes * MOST_OF_BYTES)).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), size.alias("size")).join(chosen, "id")
    found = checkpointed(found.select("text", "y", order.alias("o"), "size", F.xxhash64("text").alias("h")))
    # Bounded before it is sent: the window covers the sample's sizes, not its texts.
    ahead = Window.partitionBy("y").orderBy("o", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("y", "o", "size", "h").withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    last = {r["y"]: r["last"] for r in sizes.where((F.col("ahead") + F.col("size")) <= most_bytes // 2).groupBy("y").agg(F.max(F.struct("o", "size", "h")).alias("last")).collect()}
    key = lambda v: F.struct(*[F.lit(x).cast(t) for x, t in zip(v, ("long", "int", "long"))])
    bounded = [found.where((F.col("y") == y) & (F.struct("o", "size", "h") <= key(v))) for y, v in last.items()]
    got = sorted((r for f in bounded for r in f.select("o", "size", "h", "text", "y").collect()), key=lambda r: r[:3])
    return [None if r["text"] is None else bytes(r["text"]) for r in got], [int(r["y"]) for r in got], share


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """One row per row of ``docs``: id_col, score (named ``score_col``), and ``keep``.

    score is 0 to 1, higher: a toxic label is likelier. It depends on the text alone, and on the whole of it.
    Null and empty texts have the score that no evidence gives. Rows with equal or null ids stay apart; an
    empty table gives an empty result. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: see LEAST_COUNT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = [m.score(t.as_py()) for t in batch.column("__text")]
            kept = [batch.column(c) for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], [*(c for c in batch.schema.names if c != "__text"), "__score"])
        release()

    extra = [c for c in keep if c != id_col]
    slim = docs.select(F.col(id_col), *[F.col(c) for c in extra], F.col(text_col).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "__text")
    return slim.mapInArrow(run, f"{schema}, __score double").withColumnRenamed("__score", score_col)
