"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Learning, from a bounded sample of labelled rows (``bound``): each token's log-odds ratio
between toxic and clean documents under an informative Dirichlet prior, whose weights are
the token's share in the whole corpus. The tokens with a z-score of ``MIN_Z`` and log-odds of
``MIN_ODDS`` form the model, however many they are; all other words have one common
weight. The sample's bound is the only bound: it limits the tokens that can be told apart.

Scoring is one linear scan: the words' scores, each less what makes the mean
negative, are cut into all maximal scoring segments (disjoint, each the best of its
place). In random text the best score of n words follows an extreme-value law,
P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves the words' moment equation
and K comes from clean training rows. A segment is significant if its expected
number by chance in the text is small; the text's evidence is the sum of the
significant segments' log-likelihoods beyond chance, or that of its best segment.

The map from evidence to probability is fitted out of fold: the labelled rows are dealt
into ``FOLDS`` by a hash of the id, each fold is scored by a model learned from the others,
and the histogram of that evidence gives the map, by isotonic regression.

Defined results: null and empty texts have no segment and the lowest evidence's
probability; a null doc_id isn't held out; labels of other values than 0 and 1 and
null labels are left out; several labels of one document count as its largest; rows of one
doc_id with different texts each count with its label; a token on a threshold is in the model;
rows of equal evidence have equal scores; without labelled rows of both kinds every score is 0;
very long texts are read whole, word by word; an empty table gives an empty table; other
columns are not read, so no name clashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import Scratch, ascii_lower, materialise

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of UTF-8 bytes: A to Z become a to z, what lies between words becomes a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BINS = 2048
FOLDS = 4
#: Pseudo-documents of the prior; what a token of the model has at least.
PRIOR, MIN_Z, MIN_ODDS = 200.0, 3.0, 1.5
#: Tokens are counted in the corpus if their document shares differ by so many standard errors in a fold's training rows.
ROUGH = 2.0
#: Lengths of the word beginnings that are tokens too: inflected and compound forms share them.
STEMS = (5, 7)


@dataclass
class ToxicModel:
    """Weights of words, the law of chance, and the map from evidence to probability."""

    weights: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    lam: float = 1.0
    k: float = 0.1
    expect: float = 0.05
    low: float = -20.0  # the evidence of texts without any segment
    probability: list[float] = field(default_factory=lambda: [0.0] * BINS)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time.

    Runs of one sign are summed first. Then each positive run begins a segment; a
    segment is joined to the nearest one before it with a smaller sum to its left, if
    that one's sum to its right isn't larger, and looked at again.
    """
    n = len(scores)
    if not n:
        return []
    up = scores > 0
    cut = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    sums = np.add.reduceat(scores, cut)
    ends = np.append(cut[1:], n)
    total, segments = 0.0, []  # of a segment: start, end, sum before it, sum up to its end, where the nearest smaller is
    for a, b, s, positive in zip(cut.tolist(), ends.tolist(), sums.tolist(), up[cut].tolist(), strict=True):
        before, total = total, total + s
        if not positive:
            continue
        start, end, left, right = a, b, before, total
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= left:
                j = segments[j][4]
            if j < 0 or segments[j][3] >= right:
                segments.append((start, end, left, right, j))
                break
            start, left = segments[j][0], segments[j][2]
            del segments[j:]
    return [(a, b, r - lft) for a, b, lft, r, _ in segments]


def begun(word: bytes) -> list[str]:
    """The tokens of a word: itself and its marked beginnings."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:n] + "*" for n in STEMS if len(text) > n)]


class WordCache(dict):
    """What is known of each word, found once while the cache has room."""

    def __init__(self, find, room: int = 200_000):
        super().__init__()
        self.find, self.room = find, room

    def __missing__(self, word: bytes):
        found = self.find(word)
        if len(self) < self.room:
            self[word] = found
        return found


class WordScores:
    """Scores of words by several models at once. Words of like scores are one kind: kind 0 has no token in any model."""

    def __init__(self, models: list[ToxicModel]):
        self.models = models
        self.kinds = {tuple(m.other for m in models): 0}
        self.table = np.array([[m.other] for m in models])
        self.tokens = set().union(*(m.weights for m in models))
        self.kind_of = WordCache(self._find)

    def _find(self, word: bytes) -> int:
        """A word's score is the largest of its own weight and those of its beginnings."""
        own = [t for t in begun(word) if t in self.tokens]
        if not own:
            return 0
        scores = tuple(max((m.weights[t] for t in own if t in m.weights), default=m.other) for m in self.models)
        if scores not in self.kinds:
            self.kinds[scores] = len(self.kinds)
            self.table = np.concatenate([self.table, np.array(scores)[:, None]], axis=1)
        return self.kinds[scores]

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' kinds; ``table[k]`` of them are their scores by the model k."""
        return np.fromiter(map(self.kind_of.__getitem__, words), dtype=np.int64, count=len(words))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _beyond_chance(model: ToxicModel, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments with their log-likelihoods beyond chance."""
    chance = math.log(model.k * len(scores))
    return [(a, b, model.lam * s - chance) for a, b, s in maximal_segments(scores)]


def passages(model: ToxicModel, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Significant segments: (first word, end, log-likelihood beyond chance)."""
    return [x for x in _beyond_chance(model, scores) if x[2] >= -math.log(model.expect)] if len(scores) else []


def evidence(model: ToxicModel, scores: np.ndarray) -> tuple[float, int]:
    """Sum over significant segments, or the best one's if none is; and how many are significant."""
    if not len(scores):
        return model.low, 0
    own = [x for *_, x in _beyond_chance(model, scores)]
    strong = [x for x in own if x >= -math.log(model.expect)]
    return (sum(strong) if strong else max(own, default=model.low)), len(strong)


def moment_root(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive lambda with mean(exp(lambda * score)) = 1; scores have a negative mean and some are positive."""
    low, high = 1e-6, 1.0
    value = lambda x: float((weight * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def isotonic(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Rising probabilities per bin from counts of label 1 and 0, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for g, b in zip(good.tolist(), bad.tolist(), strict=True):
        blocks.append([g, g + b, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-12) >= blocks[-1][0] * max(blocks[-2][1], 1e-12):
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n if n else 0.0) for g, n, k in blocks])


def text_tokens(text) -> Column:
    """The distinct tokens of a text: its words, and the beginnings of longer words, marked by a star."""
    words = F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), ""))

    def stems(n: int):
        return F.transform(F.filter(words, lambda w: F.char_length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *[stems(n) for n in STEMS]))


def known_labels(labels: DataFrame, bound: int = 200_000, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``doc_id, y, fold`` of at most ``bound`` labelled documents that aren't held out, chosen by a hash of the id.

    Fitting uses this bounded sample; being bounded, it may be broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.filter("doc_id IS NOT NULL").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int"))
    return materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labels")


def _training(docs: DataFrame, known: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text, y, fold``: no text is shuffled, the labels' bound lets them be broadcast."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")


@dataclass
class TokenCounts:
    """Of each token in how many toxic and in how many training documents of each fold it stands, and in how many of the corpus."""

    words: list[str]
    bad: np.ndarray  # (tokens, folds)
    all: np.ndarray
    seen: np.ndarray
    n_docs: int
    n_bad: np.ndarray  # (folds,) training documents
    n_all: np.ndarray
    clean: np.ndarray  # (folds,) sum over all tokens of the clean documents that hold them


def _apart(bad, all_, n1, n0):
    """How many standard errors a token's shares in toxic and clean documents differ by."""
    return F.when(all_ > 0, F.abs(bad / n1 - (all_ - bad) / n0) / F.sqrt(F.greatest(all_, F.lit(1)) / (n1 + n0) * (1 / n1 + 1 / n0))).otherwise(0.0)


def token_counts(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> TokenCounts | None:
    """Counts of the tokens that may tell; None without training rows of both kinds in the training part of every fold."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id")).join(F.broadcast(known), "doc_id")  # labels without a document don't count
    sums = rows.groupBy("fold").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("all")).collect()  # a row per fold
    n_bad, n_all = np.zeros(FOLDS), np.zeros(FOLDS)
    for r in sums:
        n_bad[r["fold"]], n_all[r["fold"]] = r["bad"], r["all"]
    n_good = n_all - n_bad
    if min((n_bad.sum() - n_bad).min(), (n_good.sum() - n_good).min()) <= 0:
        return None
    # a token counts once a document: repeats of it in one text say no more about the label
    train = _training(docs, known, doc_id, text).select("y", "fold", F.explode(text_tokens(F.col("text"))).alias("w"))
    each = [x for f in range(FOLDS) for x in (F.sum(F.when(F.col("fold") == f, F.col("y")).otherwise(0)).alias(f"bad{f}"), F.sum((F.col("fold") == f).cast("long")).alias(f"all{f}"))]
    scratch = Scratch()
    counts = scratch(train.groupBy("w").agg(*each), "counts")
    total = lambda kind: sum((F.col(f"{kind}{f}") for f in range(FOLDS)), F.lit(0))
    several = counts.filter(total("all") > 1)
    clean = several.agg(*[F.sum(F.col(f"all{f}") - F.col(f"bad{f}")).alias(f"c{f}") for f in range(FOLDS)]).first()
    parts = [(total("bad"), total("all"), n_bad.sum(), n_good.sum())] + [(total("bad") - F.col(f"bad{f}"), total("all") - F.col(f"all{f}"), n_bad.sum() - n_bad[f], n_good.sum() - n_good[f]) for f in range(FOLDS)]
    clear = [_apart(b, a, float(n1), float(n0)) >= ROUGH for b, a, n1, n0 in parts]
    likely = scratch(several.filter(F.greatest(*clear)), "likely")
    found = likely.orderBy("w").collect()  # no more than the bounded sample's distinct tokens
    scratch.drop()
    words = [r["w"] for r in found]
    seen = dict.fromkeys(words, 0) | {r["w"]: r["seen"] for r in documents_with(docs, words, text).collect()}
    column = lambda kind: np.array([[r[f"{kind}{f}"] for f in range(FOLDS)] for r in found], dtype=float).reshape(len(found), FOLDS)
    return TokenCounts(words, column("bad"), column("all"), np.array([seen[w] for w in words], dtype=float), docs.count(), n_bad, n_all, np.array([clean[f"c{f}"] or 0 for f in range(FOLDS)], dtype=float))


def fit_weights(counts: TokenCounts, without: int | None = None) -> ToxicModel:
    """Log-odds of the tokens with a clear difference, and lambda; ``without`` leaves out a fold's rows."""
    use = np.array([f != without for f in range(FOLDS)])
    bad, all_ = counts.bad[:, use].sum(axis=1), counts.all[:, use].sum(axis=1)
    n1 = counts.n_bad[use].sum()
    n0, clean = counts.n_all[use].sum() - n1, max(1.0, counts.clean[use].sum())
    # informative prior: pseudo-documents that hold a token as often as the corpus does
    a = PRIOR * counts.seen / max(1, counts.n_docs) + 0.01
    y1, y0 = bad + a, all_ - bad + a
    odds = np.log(y1 / (n1 + PRIOR + 1 - y1)) - np.log(y0 / (n0 + PRIOR + 1 - y0))
    z = odds / np.sqrt(1 / y1 + 1 / y0)
    chosen = np.flatnonzero((all_ > 1) & (np.abs(z) >= MIN_Z) & (np.abs(odds) >= MIN_ODDS))
    d, p = odds[chosen], (all_ - bad)[chosen] / clean
    rest = max(0.05, 1 - float(p.sum()))
    # what all other words weigh keeps the mean of clean text well below zero
    model = ToxicModel(weights=dict(zip([counts.words[k] for k in chosen], d.tolist(), strict=True)), other=-max(0.15, 2 * float((p * np.maximum(d, 0)).sum()) / rest))
    if (d > 0).any():
        weight = np.append(np.maximum(p, 0.5 / clean), rest)
        model.lam = moment_root(np.append(d, model.other), weight / weight.sum())
    return model


def documents_with(docs: DataFrame, tokens: list[str], text: str = "text") -> DataFrame:
    """``w, seen``: in how many documents each of the given tokens stands, over all of ``docs``."""

    def run(batches):
        place = {w: k for k, w in enumerate(tokens)}
        known = WordCache(lambda word: tuple(place[t] for t in begun(word) if t in place))
        seen, met = np.zeros(len(tokens), dtype=np.int64), []
        for batch in batches:
            for t in batch.column(0):
                met.extend(set().union(*map(known.__getitem__, set(words_of(t.as_py())))))
                if len(met) > 1_000_000:
                    seen += np.bincount(met, minlength=len(tokens))
                    met = []
        seen += np.bincount(np.array(met, dtype=np.int64), minlength=len(tokens))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([tokens[k] for k in some], pa.string()), pa.array(seen[some])], names=["w", "seen"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "w string, seen long")
    return counted.groupBy("w").agg(F.sum("seen").alias("seen"))


def score_rows(docs: DataFrame, model: ToxicModel, fold_models: list[ToxicModel] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, evidence, n_passages, apart``: apart is the evidence by the model without the row's ``fold``, null for rows without one."""

    def run(batches):
        known = WordScores([model, *(fold_models or ())])
        for batch in batches:
            found, apart = [], []
            for t, fold in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                kinds = known.of(words_of(t.as_py()))
                found.append(evidence(model, known.table[0][kinds]))
                apart.append(None if fold is None else float(evidence(fold_models[fold], known.table[fold + 1][kinds])[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(x) for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), pa.array(apart, pa.float64())], names=["doc_id", "evidence", "n_passages", "apart"])

    fold = F.col("fold") if fold_models else F.lit(None).cast("int")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), fold.alias("fold")).mapInArrow(run, "doc_id long, evidence double, n_passages long, apart double")


def toxic_passages(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, first_word, end_word, excess, words``: every significant passage of every text."""

    def run(batches):
        known = WordScores([model])
        for batch in batches:
            rows = []
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                kinds = known.of(words)  # may add to the table
                rows += [(id_, a, b, x, b" ".join(words[a:b]).decode("utf-8", "replace")) for a, b, x in passages(model, known.table[0][kinds])]
            names = ["doc_id", "first_word", "end_word", "excess", "words"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, first_word long, end_word long, excess double, words string")


def fit_chance(train: DataFrame, model: ToxicModel, fold_models: list[ToxicModel]) -> None:
    """K of the extreme-value law of each model: clean rows' mean of n exp(-lambda S), as for a Gumbel law of that scale.

    The models of folds are fitted on the rows that they weren't learned from.
    """
    models = [model, *fold_models]
    for m in models:
        m.k = 1.0  # evidence is then lambda S - ln n, or sums of such; its Gumbel location gives ln K

    def run(batches):
        known = WordScores(models)
        total, n = np.zeros(len(models)), np.zeros(len(models))
        for batch in batches:
            for t, fold in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                kinds = known.of(words_of(t.as_py()))
                for k in (0, fold + 1):
                    x, passages_ = evidence(models[k], known.table[k][kinds])
                    if passages_ <= 1 and x > models[k].low:
                        total[k] += math.exp(-x)
                        n[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(total), pa.array(n)], names=["k", "total", "n"])

    clean = train.filter("y = 0").select(F.col("text").cast("binary").alias("text"), "fold").mapInArrow(run, "k long, total double, n double")
    for r in clean.groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row per model
        models[r["k"]].k = float(np.clip(r["n"] / r["total"], 1e-6, 1e3)) if r["total"] else 0.1


def bin_of(value) -> Column:
    """The bin of an evidence: bins are even in asinh(evidence), fine near chance, wide far beyond it."""
    first, last = math.asinh(ToxicModel.low), math.asinh(1e6)
    return F.least(F.greatest(F.floor((F.asinh(value) - first) / ((last - first) / BINS)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, bound: int = 200_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, n_passages`` for each row of ``docs``."""
    known = known_labels(labels, bound, doc_id, label)
    counts = token_counts(docs, known, doc_id, text)
    model, folds = (fit_weights(counts), [fit_weights(counts, f) for f in range(FOLDS)]) if counts else (ToxicModel(), [])
    if model.weights:
        fit_chance(_training(docs, known, doc_id, text), model, folds)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id", "left")
    scored = materialise(score_rows(rows.select("doc_id", "text", "fold"), model, folds), "evidence")
    if model.weights:
        bins = scored.filter("apart IS NOT NULL").join(F.broadcast(known), "doc_id").groupBy(bin_of(F.col("apart")).alias("bin")).agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("all")).collect()  # at most BINS rows
        good, rest = np.zeros(BINS), np.zeros(BINS)
        for r in bins:
            good[r["bin"]], rest[r["bin"]] = r["bad"], r["all"] - r["bad"]
        model.probability = isotonic(good, rest).tolist()
    # equal probabilities keep the order of their evidence
    table, place = F.array(*[F.lit(float(p)) for p in model.probability]), bin_of(F.col("evidence"))
    score = F.least(F.lit(1.0), F.get(table, place) * 0.999 + 0.001 * (place + 1) / (BINS + 1)) if model.weights else F.lit(0.0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "evidence", "n_passages")
