"""Reading level of each document: a Rasch-style latent difficulty model, fitted by alternating optimisation.

Texts are cut into sentences (long ones into pieces), the *units*.  Unit u has a latent level t_u, word w an
easiness a_w and a slope b_w, and the logit of a word against any other is linear in the level, as in the
Rasch family (two parameters a word):

    P(word w stands in u) = exp(a_w + b_w t_u) / Z(t_u),   Z(t) = sum over all words of exp(a_w + b_w t)

A word's difficulty -a_w / b_w is the level at which it begins to outweigh the scale's origin; words of slope
0 tell nothing.  Besides its distinct words a unit holds two shape words, its mean word length and its number
of words, which carry over between languages.  The log-likelihood, penalised by normal priors on slopes and
levels, is raised in turns, each a distributed aggregation:

* words given levels: the sufficient statistics of a word are the number of its units and the sum of their
  levels; with the counts of units per step of the level scale, Newton's method finds each slope, and the
  easiness follows in closed form; then Z is summed anew and the step repeated;
* levels given words: a unit needs only the weighted count and slope sum of its words; its level is the
  posterior mean over the scale.  Units of labelled documents have a prior around the readers' judgement;
* the alternation ends when the log-likelihood gains less than ``TOLERANCE`` of itself;
* linking: as in every Rasch model the scale is free up to a line, so it is tied to the readers' scale by
  regressing the labels on the means of the labelled documents.

Only 41 numbers a step (sums over the scale) come to the driver.  The word table is broadcast only if its
counted size is below ``BROADCAST_WORDS``; else it is joined by a shuffle in which frequent words are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.skew import HOT_ROWS, HOT_SHARE, salted_join
from nearfield.storage import Workspace, metric

UNIT_WORDS = 40
#: The constants below were set by four-fold cross-validation over reading_labels.
#: Steps of the level scale.
SCALE = np.linspace(0.5, 5.5, 41)
#: Precision of the prior on slopes, and deviations of the priors on levels, without and with a judgement.
SLOPE_PRECISION = 1.0
LEVEL_SPREAD = 1.5
LABEL_SPREAD = 0.7
#: Words of this many letters and more count fully for a unit's level, shorter ones by the square of their share of it.
FULL_LENGTH = 7
#: Words in fewer units are left out once all units take part.
LEAST_UNITS = 3
TOLERANCE = 0.1
MOST_ROUNDS = 8
NEWTON_STEPS = 8
HARD = 3.5
BROADCAST_WORDS = 300_000


def _id(word, letters):
    """A word's hash with its number of letters (up to 15) in the lowest four bits."""
    return F.shiftleft(word, 4).bitwiseOR(F.least(F.lit(15), letters).cast("bigint"))


def units(documents: DataFrame) -> DataFrame:
    """``doc_id, unit, n, ids``: the pieces of every text with their distinct words (hashed) and shape words.

    Null and blank texts, and texts without a word, have no units.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower("text"), r"</?[a-z][^<>]*>", " "), "&[a-z]+;|&#x?[0-9a-f]+;", " ")
    sentences = F.split(text, r"(?<=[.?!…])\s+|\n+")
    tokens = F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))

    def cut(ws):
        pieces = F.greatest(F.lit(1), F.ceil(F.size(ws) / F.lit(UNIT_WORDS)).cast("int"))
        step = F.greatest(F.lit(1), F.ceil(F.size(ws) / pieces).cast("int"))
        return F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.slice(ws, k * step + 1, step))

    pieces = F.filter(F.flatten(F.transform(tokens, cut)), lambda ws: F.size(ws) >= 2)
    source = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # one shuffle spreads the texts and brings repeated rows together
    tasks = max(2 * source.sparkSession.sparkContext.defaultParallelism, source.rdd.getNumPartitions())
    rows = source.repartition(tasks, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", F.posexplode(pieces).alias("unit", "ws"))
    letters = F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))
    shape = F.array(
        _id(F.xxhash64(F.lit("#length"), F.least(F.lit(12), F.round(letters / F.size("ws")).cast("int"))), F.lit(15)),
        _id(F.xxhash64(F.lit("#words"), F.least(F.lit(12), F.floor(F.size("ws") / 4).cast("int"))), F.lit(15)),
    )
    return rows.select("doc_id", "unit", F.size("ws").alias("n"), F.concat(F.array_distinct(F.transform("ws", lambda w: _id(F.xxhash64(w), F.length(w)))), shape).alias("ids"))


def doc_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, y``: mean judgement; nulls and judgements off the scale 1..5 are left out."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, 5)).dropDuplicates(["doc_id", "reader", "reading_level"])
    return good.groupBy("doc_id").agg(F.avg("reading_level").alias("y"))


def _weight(ids: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, (ids & 15) / FULL_LENGTH) ** 2


def _sums(units_: DataFrame, mean: float) -> DataFrame:
    """Sufficient statistics from rows ``ids, level, ll``: per word ``k`` units and ``s`` summed levels (from the mean).

    The steps of the scale take part as words -1, -2, ..: their ``size`` is the number of words at that
    level and their ``ll`` the log-likelihood, so that one pass over the units gives all.
    """
    step = F.round((F.col("level") - float(SCALE[0])) / float(SCALE[1] - SCALE[0])).cast("bigint")
    marked = units_.select(F.explode(F.concat("ids", F.array(-1 - step))).alias("word"), (F.col("level") - mean).alias("t"), F.size("ids").alias("size"), "ll")
    return marked.groupBy("word").agg(F.count("*").alias("k"), F.sum("t").alias("s"), F.sum("size").alias("size"), F.sum("ll").alias("ll"))


WORDS = "word bigint, k bigint, s double, easiness double, slope double, weight double"


def _newton(sums: DataFrame, at_level: np.ndarray, log_z: np.ndarray, t: np.ndarray) -> DataFrame:
    """Slope and easiness of every word: Newton steps on the penalised likelihood, all words of a batch at once."""
    mass = at_level * np.exp(-log_z)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k, s = b["k"].to_numpy(dtype=float), b["s"].to_numpy(dtype=float)
            slope = np.zeros(len(b))
            for _ in range(NEWTON_STEPS):
                e = np.exp(np.outer(slope, t)) * mass
                total = e.sum(axis=1)
                first = (e @ t) / total
                second = np.maximum((e @ (t * t)) / total - first * first, 1e-9)
                gain = (s - k * first - SLOPE_PRECISION * slope) / (k * second + SLOPE_PRECISION)
                slope = np.clip(slope + np.clip(gain, -1, 1), -6, 6)
            easiness = np.log(k) - np.log((np.exp(np.outer(slope, t)) * mass).sum(axis=1))
            yield pd.DataFrame({"word": b["word"], "k": b["k"], "s": s, "easiness": easiness, "slope": slope, "weight": _weight(b["word"].to_numpy())})

    return sums.select("word", "k", "s").mapInPandas(run, WORDS)


def _log_z(words: DataFrame, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Z over the scale, of all words and with the words weighted as they are for the levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = np.exp(b["easiness"].to_numpy()[:, None] + np.outer(b["slope"].to_numpy(), t))
            yield pd.DataFrame({"place": range(len(t)), "z": e.sum(axis=0), "weighted": b["weight"].to_numpy() @ e})

    rows = words.mapInPandas(run, "place int, z double, weighted double").groupBy("place").agg(F.sum("z").alias("z"), F.sum("weighted").alias("weighted")).collect()  # 41 rows
    rows.sort(key=lambda r: r["place"])
    return np.log([r["z"] for r in rows]), np.log([max(r["weighted"], 1e-300) for r in rows])


def _word_step(statistics: DataFrame, mean: float, least: int, workspace: Workspace) -> tuple[DataFrame | None, np.ndarray, float]:
    """Words, weighted log Z and log-likelihood from sufficient statistics (see :func:`_sums`); no words without rows."""
    t = SCALE - mean
    sums = workspace.save(statistics, "sums")
    bins = {-1 - r["word"]: r for r in sums.where(F.col("word").between(-len(t), -1)).collect()}  # one row a step of the scale
    if not bins:
        return None, t, 0.0
    at_level = np.array([float(bins[g]["size"]) if g in bins else 0.0 for g in range(len(t))])
    own = sums.where(~F.col("word").between(-len(t), -1) & (F.col("k") >= least))
    log_z, words = np.zeros(len(t)), None
    for _ in range(2):
        workspace.drop(words)
        words = workspace.save(_newton(own, at_level, log_z, t), "words", size=F.count("*"), total=F.sum("k"))
        log_z, weighted = _log_z(words, t)
    workspace.drop(sums)
    return words, weighted, sum(r["ll"] or 0.0 for r in bins.values())


def _posterior(n: np.ndarray, push: np.ndarray, y: np.ndarray, weighted: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean level and log-likelihood of units with these weighted counts, slope sums and labels (NaN: none)."""
    t = SCALE - mean
    level, ll = np.empty(len(n)), np.empty(len(n))
    for at in range(0, len(n), 20_000):
        part = slice(at, at + 20_000)
        fit = np.outer(push[part], t) - np.outer(n[part], weighted)
        label = y[part][:, None]
        prior = np.where(np.isnan(label), -((SCALE - mean) ** 2) / (2 * LEVEL_SPREAD**2), -((SCALE - label) ** 2) / (2 * LABEL_SPREAD**2))
        p = fit + prior
        p = np.exp(p - p.max(axis=1, keepdims=True))
        level[part] = (p @ SCALE) / p.sum(axis=1)
        ll[part] = fit.max(axis=1)
    return level, ll


class Model:
    """A fitted model: ``words``, the weighted log Z, the mean label, the line of the link and the log-likelihood of each round."""

    def __init__(self, words: DataFrame, weighted: np.ndarray, mean: float):
        self.mean, self.slope, self.intercept = mean, 1.0, 0.0
        self.likelihoods: list[float] = []
        self.set(words, weighted)

    def set(self, words: DataFrame, weighted: np.ndarray) -> None:
        self.words, self.weighted, self.shared = words, weighted, None
        if metric(words, "size") <= BROADCAST_WORDS:  # counted: at most so many rows of three numbers
            table = words.select("word", "weight", (F.col("weight") * F.col("slope")).alias("push")).toPandas().sort_values("word")
            self.shared = words.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("word", "weight", "push")))

    def statistics(self, rows: DataFrame) -> DataFrame:
        """The sums of :func:`_sums` with each unit at its level under this model; ``rows`` has ``ids, y``."""
        if self.shared is None:
            return _sums(self._by_shuffle(rows, ["y"], True, True), self.mean)
        shared, weighted, mean = self.shared, self.weighted, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat, owner, n, push = _looked_up(b, *shared.value)
                y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
                level, ll = _posterior(n, push, y, weighted, mean)
                words, where = np.unique(flat, return_inverse=True)
                step = np.round((level - SCALE[0]) / (SCALE[1] - SCALE[0])).astype("int64")
                zeros, bins = np.zeros(len(words)), len(SCALE)
                size = np.bincount(owner, minlength=len(level))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([words, -1 - np.arange(bins)])),
                        pa.array(np.concatenate([np.bincount(where, minlength=len(words)), np.bincount(step, minlength=bins)]).astype("int64")),
                        pa.array(np.concatenate([np.bincount(where, weights=(level - mean)[owner], minlength=len(words)), np.zeros(bins)])),
                        pa.array(np.concatenate([zeros, np.bincount(step, weights=size, minlength=bins)]).astype("int64")),
                        pa.array(np.concatenate([zeros, np.bincount(step, weights=ll, minlength=bins)])),
                    ],
                    names=["word", "k", "s", "size", "ll"],
                )

        parts = rows.select("ids", "y").mapInArrow(run, "word bigint, k bigint, s double, size bigint, ll double")
        return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("k", "s", "size", "ll")])

    def levels(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``doc_id, n, level`` and ``keep`` of each unit, without a look at labels; a unit without a known word has the mean level."""
        if self.shared is None:
            return self._by_shuffle(rows, keep, False, False).select("doc_id", "n", *keep, "level")
        shared, weighted, mean = self.shared, self.weighted, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, _, n, push = _looked_up(b, *shared.value)
                level, _ = _posterior(n, push, np.full(len(n), np.nan), weighted, mean)
                names = ["doc_id", "n", *keep]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(level)], names=[*names, "level"])

        kinds = dict(rows.dtypes)
        return rows.select("doc_id", "n", *keep, "ids").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "n", *keep)) + ", level double")

    def _by_shuffle(self, rows: DataFrame, keep: list[str], with_ids: bool, judged: bool) -> DataFrame:
        """The same for any number of words: an equi-join on the word, salted for frequent ones."""
        weighted, mean = self.weighted, self.mean

        @F.pandas_udf("level double, ll double")
        def posterior(n: pd.Series, push: pd.Series, y: pd.Series) -> pd.DataFrame:
            level, ll = _posterior(*(x.to_numpy(dtype=float, na_value=0.0) for x in (n, push)), y.to_numpy(dtype=float), weighted, mean)
            return pd.DataFrame({"level": level, "ll": ll})

        single = rows.select("doc_id", "unit", "n", *keep, F.explode("ids").alias("word"))
        table = self.words.select("word", "weight", (F.col("weight") * F.col("slope")).alias("push"))
        hot = self.words.where(F.col("k") > max(HOT_ROWS, HOT_SHARE * (metric(self.words, "total") or 0))).select("word")  # at most 1000
        joined = salted_join(single, table, "word", hot, "doc_id", "left")
        sums = [F.sum("weight").alias("__n"), F.sum("push").alias("__b")]
        if with_ids:
            sums.append(F.collect_list("word").alias("ids"))  # at most UNIT_WORDS + 2
        out = joined.groupBy("doc_id", "unit", "n", *keep).agg(*sums)
        y = F.col("y") if judged else F.lit(None).cast("double")
        return out.withColumn("__p", posterior("__n", "__b", y)).select("doc_id", "unit", "n", *keep, *(["ids"] if with_ids else []), "__p.level", "__p.ll")

    def score(self, rows: DataFrame) -> DataFrame:
        """``doc_id, n, level`` of units, on the readers' scale."""
        return self.levels(rows, []).withColumn("level", F.greatest(F.lit(0.5), F.least(F.lit(5.5), F.col("level") * self.slope + self.intercept)))


def _looked_up(batch: pa.RecordBatch, words: np.ndarray, weight: np.ndarray, push: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a batch of units in a row, the unit of each, and per unit the summed weights and pushes of the known words."""
    ids = batch.column("ids")
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
    known = np.flatnonzero(words[at] == flat) if len(words) else np.zeros(0, dtype="int64")
    sums = [np.bincount(owner[known], weights=x[at[known]], minlength=len(lengths)) for x in (weight, push)]
    return flat, owner, *sums


def _link(labelled: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the labels on the documents' mean level."""
    per = labelled.groupBy("doc_id", "y").agg((F.sum(F.col("level") * F.col("n")) / F.sum("n")).alias("x"))
    row = per.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b")).first()
    if row["a"] is None or row["a"] != row["a"] or row["a"] <= 0:
        return 1.0, 0.0
    return float(row["a"]), float(row["b"])


def fit(rows: DataFrame, labels: DataFrame, workspace: Workspace) -> Model | None:
    """The model of units ``rows`` (from :func:`units`, written down) and labels; None without usable labels.

    The first words come from labelled units at their document's label; from then on all units take part.
    """
    y = doc_labels(labels)
    labelled = workspace.save(rows.join(y, "doc_id"), "labelled")
    # the mean over documents, not over their units
    mean = labelled.select("doc_id", "y").distinct().agg(F.avg("y")).first()[0]
    if mean is None:
        return None
    judged = labelled.select("ids", F.col("y").alias("level"), F.lit(0.0).alias("ll"))
    words, weighted, _ = _word_step(_sums(judged, mean), mean, 1, workspace)
    model = Model(words, weighted, mean)
    everything = rows.join(y, "doc_id", "left")
    for _ in range(MOST_ROUNDS):
        words, weighted, ll = _word_step(model.statistics(everything), mean, LEAST_UNITS, workspace)
        last = model.likelihoods[-1] if model.likelihoods else None
        model.likelihoods.append(ll)
        if words is None or not metric(words, "size"):
            break
        model.set(words, weighted)
        if last is not None and ll - last < TOLERANCE * abs(last):
            break
    model.slope, model.intercept = _link(model.levels(labelled, ["y"]))
    return model


def reading_levels(documents: DataFrame, labels: DataFrame, workspace: Workspace) -> DataFrame:
    """``doc_id, level, hard_share, n_words``: estimate on the readers' scale and the share of words in units of level 4 or 5.

    Blank texts are left out; without any label all levels are null and shares 0.  Repeated document rows
    count once; labels of unknown documents are ignored.
    """
    rows = workspace.save(units(documents), "units")
    model = fit(rows, labels, workspace)
    if model is None:
        return rows.groupBy("doc_id").agg(F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("hard_share"), F.sum("n").alias("n_words"))
    scored = model.score(rows)
    n = F.col("n")
    return scored.groupBy("doc_id").agg(
        (F.sum(F.col("level") * n) / F.sum(n)).alias("level"),
        (F.sum(F.when(F.col("level") >= HARD, n).otherwise(0)) / F.sum(n)).alias("hard_share"),
        F.sum(n).alias("n_words"),
    )
