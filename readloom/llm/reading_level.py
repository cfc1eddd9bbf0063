"""Problem 10: reading level by a Rasch-style latent difficulty model.

A document has a latent level, every word a latent difficulty: the log-odds of a word's occurrence grow with level times difficulty,
    log P(word | document) = base(word) + level(document) * difficulty(word) - log Z(level(document)).
Both are estimated by alternating likelihood steps over the whole corpus until the difficulties settle:
  level step       the level at which the model expects the mean difficulty that the document's words have (the exact
                   maximum: the model is an exponential family in the level); every task solves it for its own documents;
  difficulty step  two Newton parameters a word (base, difficulty, the latter with a small ridge) from the word's total, its sum of
                   levels and the number of words at each level; tasks send these sums, never anything per document.
Words are hashed to 2^18 items, so what travels has a fixed size.

Two more facets are continuation items, whose document parameter has a closed form: the log-odds that a word goes on for another
syllable, and that a sentence goes on for another word. The three facets' expected scores (mean difficulty, syllables
a word, words a sentence) are linked to the four levels by one ordered logistic model fitted to the graders' labels (many-facet Rasch
linking). Every document's level comes from that model; no readability formula is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.prose import Tokens, counts
from readloom.session import written

ITEMS = 1 << 18
LEVELS = 4
GRID = np.linspace(-6.0, 6.0, 121)  # levels, standardised over documents, at which the model is tabulated
ENGLISH = r"(?i)^\s*en(g|glish)?([-_ ].*)?\s*$"
FACETS = "doc_id bigint, words bigint, sentences bigint, syllables bigint"


def _features(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(ITEMS)
    for b in batches:
        ids, rows, items, ns = [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w, s, y, found = counts(text.as_py(), tokens)
            if w >= least_words:
                each, n = np.unique(found.astype(np.int32), return_counts=True)
                ids.append(doc)
                rows.append((w, s, y))
                items.append(each)
                ns.append(n.astype(np.int32))
        if not ids:
            continue
        n = np.array(rows, np.int64)
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (items, ns)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(n[:, i].copy()) for i in range(3)], *lists], names=["doc_id", "words", "sentences", "syllables", "items", "ns"])


def _expected(base: np.ndarray, difficulty: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Expected occurrences of every item at every grid level, given the number of words there."""
    e = base[:, None] + difficulty[:, None] * GRID
    p = np.exp(e - e.max(axis=0))
    return p * (words / p.sum(axis=0))


class Model:
    """base and difficulty of every item, with the model's expected difficulty tabulated over GRID."""

    def __init__(self, base: np.ndarray, difficulty: np.ndarray):
        self.base, self.difficulty = base, difficulty
        self.mean = _expected(base, difficulty, np.ones(len(GRID))).T @ difficulty

    def moved(self, n: np.ndarray, levels: np.ndarray, words: np.ndarray, ridge: float, steps: int = 3) -> Model:
        """One difficulty step: n occurrences of and summed levels at the occurrences of every item, number of words at every grid level."""
        base, d = self.base.copy(), self.difficulty.copy()
        for _ in range(steps):
            p = _expected(base, d, words)
            a, b, c = p.sum(axis=1), p @ GRID, p @ GRID**2 + ridge
            g0, g1 = n - a, levels - b - ridge * d
            det = np.maximum(a * c - b * b, 1e-9)
            base = base + np.clip((c * g0 - b * g1) / det, -1, 1)
            d = d + np.clip((a * g1 - b * g0) / det, -0.5, 0.5)
        return Model(base, d - np.average(d, weights=n))

    def rescaled(self, centre: float, spread: float) -> Model:
        """The same model on levels less centre, over spread."""
        return Model(self.base + centre * self.difficulty, self.difficulty * spread)


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy()


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of all documents with their occurrences, and the document of each."""
    items, ns = (b.column(b.schema.get_field_index(c)) for c in ("items", "ns"))
    lengths = items.value_lengths().to_numpy()
    return items.flatten().to_numpy(), ns.flatten().to_numpy().astype(float), np.repeat(np.arange(b.num_rows), lengths)


def _facets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Expected syllables of a word and words of a sentence."""
    w, s, y = (_column(b, c).astype(float) for c in ("words", "sentences", "syllables"))
    return y / w, w / s


def _scores(b: pa.RecordBatch, difficulty: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Mean difficulty of each document's word occurrences."""
    items, n, doc = _flat(b)
    return np.bincount(doc, n * difficulty[slot[items]], b.num_rows) / np.bincount(doc, n, b.num_rows)


def _split(level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights spread over the two grid levels around each level."""
    x = np.clip((level - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1 - 1e-9)
    cell = x.astype(int)
    return np.bincount(cell, weight * (1 - (x - cell)), len(GRID)) + np.bincount(cell + 1, weight * (x - cell), len(GRID))


def _level_sums(batches: Iterator[pa.RecordBatch], state: tuple | None, begin: tuple) -> Iterator[pa.RecordBatch]:
    """The level step of every document, and the sums it leaves: occurrences and levels by item, then (negative keys) words by grid level and the moments of the levels."""
    n, total, words, moments = np.zeros(ITEMS), np.zeros(ITEMS), np.zeros(len(GRID)), np.zeros(3)
    for b in batches:
        if not b.num_rows:
            continue
        items, k, doc = _flat(b)
        if state is None:
            level = sum((x - m) / s for x, (m, s) in zip(_facets(b), begin, strict=True))
        else:
            difficulty, slot, mean = state
            level = np.interp(_scores(b, difficulty, slot), mean, GRID)
        n += np.bincount(items, k, ITEMS)
        total += np.bincount(items, k * level[doc], ITEMS)
        words += _split(level, np.bincount(doc, k, b.num_rows))
        moments += [len(level), level.sum(), (level**2).sum()]
    at, rest = np.flatnonzero(n), np.concatenate([words, moments])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([at, -1 - np.arange(len(rest))]).astype(np.int64)), pa.array(np.concatenate([n[at], rest])), pa.array(np.concatenate([total[at], np.zeros(len(rest))]))],
        names=["key", "n", "total"],
    )


def _summed(features: DataFrame, state: tuple | None, begin: tuple) -> tuple:
    """(items, occurrences, levels, words) after a level step, on levels of mean 0 and variance 1, then their centre and spread: at most ITEMS + 124 rows, whatever the corpus."""
    sums = features.mapInArrow(lambda it: _level_sums(it, state, begin), "key bigint, n double, total double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas().set_index("key").sort_index()
    items, rest = sums[sums.index >= 0], sums[sums.index < 0]["n"].to_numpy()[::-1]
    words, moments = rest[: len(GRID)], rest[len(GRID) :]
    centre = moments[1] / moments[0]
    spread = max(np.sqrt(max(moments[2] / moments[0] - centre**2, 0.0)), 1e-6)
    n = items["n"].to_numpy()
    return items.index.to_numpy(), n, (items["total"].to_numpy() - centre * n) / spread, _split((GRID - centre) / spread, words), centre, spread


def ordered_link(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bounds) of the ordered logistic model P(level > k) = 1 / (1 + exp(bounds[k] - x @ weights)), by Newton steps.

    x: standardised facets of labelled documents, y: their labels 1..LEVELS. A weak prior (equal weights, even bounds) settles what
    the labels leave open, so that few or no labels give a defined link.
    """
    m = x.shape[1]
    prior = np.concatenate([np.ones(m), np.arange(LEVELS - 1) * 2.0 - (LEVELS - 2)])
    p = prior.copy()
    sides = [np.column_stack([x, -np.tile(np.eye(LEVELS - 1)[k], (len(x), 1))]) for k in range(LEVELS - 1)]
    for _ in range(50):
        gradient, curvature = -ridge * (p - prior), ridge * np.eye(len(p))
        for k, side in enumerate(sides):
            q = 1 / (1 + np.exp(-np.clip(side @ p, -30, 30)))
            gradient = gradient + side.T @ ((y > k + 1) - q)
            curvature = curvature + (side * (q * (1 - q))[:, None]).T @ side
        move = np.linalg.solve(curvature, gradient)
        p = p + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return p[:m], np.sort(p[m:])


def _scored(batches: Iterator[pa.RecordBatch], state: tuple) -> Iterator[pa.RecordBatch]:
    difficulty, slot, mean = state
    for b in batches:
        if b.num_rows:
            score = _scores(b, difficulty, slot)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.interp(score, mean, GRID)), pa.array(score), *map(pa.array, _facets(b))], names=["doc_id", "latent", "f0", "f1", "f2"])


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = 80, most_labels: int = 200_000, ridge: float = 5.0, tolerance: float = 0.01, most_rounds: int = 60) -> DataFrame:
    """(doc_id, reading_level, latent, linked) of every English document with enough running prose.

    documents: rows with doc_id, text, lang (other columns are ignored). English is lang en, eng or english in any case, with or without a
    region; null is not. Null, blank and short texts (fewer than least_words words of running prose) are left out. An empty table gives an empty result.
    labels: doc_id, reading_level (1..4) by graders, any number a document; nulls, other values and labels of documents not judged count nothing. If there are
    more than most_labels labels, those of lowest hash set the link (a bound on the labelled sample alone: all documents shape the model and get their level from it).
    The alternation ends when a round changes the difficulties by less than tolerance (root mean square over word occurrences); after most_rounds it raises.
    """
    spark = documents.sparkSession
    english = documents.where(F.col("lang").rlike(ENGLISH) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    features, _ = written(english.select("doc_id", "text").mapInArrow(lambda it: _features(it, least_words), f"{FACETS}, items array<int>, ns array<int>"), "prose")
    y, w = F.col("syllables") / F.col("words"), F.col("words") / F.col("sentences")
    one = features.agg(F.count("*"), F.avg(y), F.stddev_pop(y), F.avg(w), F.stddev_pop(w)).first()
    if not one[0]:
        return spark.createDataFrame([], "doc_id bigint, reading_level bigint, latent double, linked double")
    begin = tuple((one[i], max(one[i + 1], 1e-9)) for i in (1, 3))  # the first levels are the standardised closed-form facets, summed

    items, n, total, words, *_ = _summed(features, None, begin)
    slot = np.zeros(ITEMS, np.int32)
    slot[items] = np.arange(len(items))
    model = Model(np.log(n / n.sum()), np.zeros(len(items)))
    for _ in range(most_rounds):
        new = model.moved(n, total, words, ridge)
        change = np.sqrt(np.average((new.difficulty - model.difficulty) ** 2, weights=n))
        if change < tolerance:
            break
        _, n, total, words, centre, spread = _summed(features, (new.difficulty, slot, new.mean), begin)
        model = new.rescaled(centre, spread)
    else:
        raise RuntimeError(f"difficulties still change by {change:.3g} after {most_rounds} rounds")
    state = (new.difficulty, slot, new.mean)
    scored, _ = written(features.mapInArrow(lambda it: _scored(it, state), "doc_id bigint, latent double, f0 double, f1 double, f2 double"), "scored")

    named = ["f0", "f1", "f2"]
    stats = scored.agg(*[f(c) for c in named for f in (F.avg, F.stddev_pop)]).first()
    means, spreads = np.array(stats[0::2]), np.maximum(np.array(stats[1::2]), 1e-9)
    good = labels.where(F.col("reading_level").between(1, LEVELS)).select("doc_id", F.col("reading_level").cast("int").alias("y"))
    sample = good.orderBy(F.xxhash64("doc_id", "y")).limit(most_labels).join(scored.select("doc_id", *named), "doc_id").select("y", *named).toPandas()
    weights, bounds = ordered_link((sample[named].to_numpy(float) - means) / spreads, sample["y"].to_numpy())
    linked = sum(((F.col(c) - float(m)) / float(s) * float(v) for c, m, s, v in zip(named, means, spreads, weights, strict=True)), F.lit(0.0))
    level = F.lit(1) + sum(((F.col("linked") > float(k)).cast("int") for k in bounds), F.lit(0))
    return scored.withColumn("linked", linked).select("doc_id", level.cast("bigint").alias("reading_level"), "latent", "linked")
