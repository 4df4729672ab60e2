"""Quality classifier from weak labels (operator 10).

Heuristic labellers vote *poor*, *fine* or abstain on each document; they overlap and err.
Documents are counted by vote pattern, and expectation maximisation over the patterns estimates
each labeller's vote probabilities given the true class.  Poor documents are poor in different
ways and labellers that look for the same fault agree, so votes are not independent given just
*poor* and *fine*: the true class is *fine* or one of several faults (a fault per labeller to
begin with), and votes are independent given that.  A labeller whose alarms its fellows don't
share is thus found to be unreliable, and its lone votes count for little.  The posterior of a
pattern (1 - probability of *fine* is *poor*) is the soft label of its documents, and a hashed
linear scorer is trained on them: word shapes and binned statistics hashed to ``2**BITS``
weights, logistic loss.  It generalises the labellers to documents on which they abstain or split.

Vote patterns are counted over all documents.  The scorer is fitted on at most ``FIT_ROWS``
of them, those of least seeded hash (the bound is a parameter); every document is scored.

Nulls and edges: a null or empty text has no words and is scored as such; null ids are kept;
repeated rows get equal scores (the verdict depends on the text alone); ties at 0.5 are kept;
an empty table gives an empty result; without both classes the scorer repeats the prior;
extra columns are ignored (``quality_scores``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.llm import common as C
from gridspark.llm.quality_rules import STATS, text_stats

BITS, FIT_ROWS, SEED = 16, 20_000, 11
#: Labeller, statistic, its base, poor beyond, fine below.
LABELLERS = (
    ("symbols", "n_symbols", "n_words", 0.15, 0.03),
    ("symbol_share", "n_symbols", "word_chars", 0.08, 0.02),
    ("odd", "n_odd", "word_chars", 0.12, 0.06),
    ("capitals", "n_upper", "n_letters", 0.45, 0.25),
    ("marks", "n_marks", "n_words", 0.25, 0.10),
    ("repeats", "n_repeat_words", "n_words", 0.45, 0.25),
    ("same_words", "n_same", "n_words", 0.75, 0.65),
    ("lines", "n_dup_lines", "n_lines", 0.85, 0.50),
    ("long_words", "word_chars", "n_words", 14.0, 9.0),
)
#: A text of fewer words is poor, of so many or more is fine; ratios of shorter texts than ``JUDGED`` words say nothing.
SHORT, ENOUGH, JUDGED = 1, 50, 10
ABSTAIN, POOR, FINE = 0, 1, 2
SHAPE = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
NAMES = [x.split()[0] for x in STATS.split(", ")]


def _ratio(stats: dict[str, np.ndarray], num: str, den: str) -> np.ndarray:
    if num == "n_odd":
        over = stats["word_chars"] - stats["n_letters"] - stats["n_digits"]
    elif num == "n_same":
        over = stats["n_words"] - stats["n_distinct"]
    else:
        over = stats[num]
    return over / np.maximum(stats[den], 1)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One row per labeller, the length rule last."""
    out, n = [], stats["n_words"]
    for _, num, den, poor, fine in LABELLERS:
        ratio = _ratio(stats, num, den)
        out.append(np.where(n < JUDGED, ABSTAIN, np.where(ratio > poor, POOR, np.where(ratio < fine, FINE, ABSTAIN))))
    out.append(np.where(n < SHORT, POOR, np.where(n >= ENOUGH, FINE, ABSTAIN)))
    return np.array(out, np.int64)


def pattern(vote: np.ndarray) -> np.ndarray:
    return (vote * 3 ** np.arange(len(vote))[:, None]).sum(axis=0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS) + 1, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior [pattern, class], vote probabilities [labeller, class, vote] and class shares; the last class is *fine*.

    A document has a fault only if the fault's labeller says so, and no labeller calls a fault fine
    more often than a fine document.  At first a document is of the faults that its labellers name,
    in doubt rather fine if only one does: a lone alarm that all others deny says nothing about
    itself and stays in doubt.
    """
    vote = patterns[:, None] // 3 ** np.arange(labellers) % 3
    poor = (vote == POOR).astype(float)
    named, may = poor.sum(axis=1, keepdims=True), np.concatenate((poor > 0, np.ones((len(poor), 1), bool)), axis=1)
    blame = np.where(named > 1, 0.9, np.where(named == 1, 0.4, 0.0))
    post = np.concatenate((poor / np.maximum(named, 1) * blame, 1 - blame), axis=1)
    theta, shares = np.zeros((labellers, labellers + 1, 3)), np.zeros(labellers + 1)
    for _ in range(rounds):
        weight = post * counts[:, None]
        shares = (weight.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * (labellers + 1))
        for j in range(labellers):
            for v in range(3):
                theta[j, :, v] = weight[vote[:, j] == v].sum(axis=0) + 0.1
        theta /= theta.sum(axis=2, keepdims=True)
        most = np.minimum(theta[:, :, FINE], theta[:, -1:, FINE])
        theta[:, :, :FINE] *= ((1 - most) / (1 - theta[:, :, FINE]))[:, :, None]
        theta[:, :, FINE] = most
        log = np.log(shares) + sum(np.log(theta[j][:, vote[:, j]]).T for j in range(labellers))
        log = np.where(may, log, -np.inf)
        new = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9 if len(post) else True
        post = new
        if done:
            break
    return post, theta, shares


def accuracies(patterns: np.ndarray, counts: np.ndarray, poor: np.ndarray, labellers: int = len(LABELLERS) + 1) -> np.ndarray:
    """Of each labeller's votes the share that is right, by the probability of *poor* of every pattern; NaN without a vote."""
    vote = patterns[:, None] // 3 ** np.arange(labellers) % 3
    right = ((vote == POOR) * poor[:, None] + (vote == FINE) * (1 - poor[:, None])) * counts[:, None]
    cast = (vote != ABSTAIN) * counts[:, None]
    with np.errstate(invalid="ignore"):
        return right.sum(axis=0) / cast.sum(axis=0)


def features(column: pa.Array, stats: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: square roots of word-shape shares, and bins of its statistics."""
    raw, cuts = C.buffer_of(column)
    shaped = np.take(SHAPE, raw)
    # runs of one byte count once; a text's first byte begins a run
    keep = np.ones(len(raw), bool)
    keep[1:] = (shaped[1:] != shaped[:-1]) | C.white(shaped[1:])
    keep[cuts[:-1][cuts[:-1] < len(raw)]] = True
    kept = np.flatnonzero(keep)
    shaped, cuts = shaped[kept], np.searchsorted(kept, cuts)
    first, end = C.word_spans(shaped, cuts)
    starts = np.searchsorted(first, cuts)
    n = len(column)
    doc = np.repeat(np.arange(n), np.diff(starts)).astype(np.uint64)
    seen, counts = C.distinct_counts(doc << np.uint64(BITS) | C.span_hashes(shaped, first, end, False) >> np.uint64(64 - BITS))
    owner = (seen >> np.uint64(BITS)).astype(np.int64)
    ratios = [np.minimum(15, (16 * np.sqrt(_ratio(stats, num, den) / (2 * poor)))).astype(np.uint64) for _, num, den, poor, _ in LABELLERS]
    ratios.append(np.minimum(15, np.log2(1 + stats["n_words"])).astype(np.uint64))
    bins = np.array([C.mix(r + np.uint64(16 * k + 1)) >> np.uint64(64 - BITS) for k, r in enumerate(ratios)]).T.reshape(n, len(ratios))
    values, at = np.sqrt(counts / np.maximum(np.diff(starts), 1)[owner]), (seen & np.uint64((1 << BITS) - 1)).astype(np.int64)
    border = np.searchsorted(owner, np.arange(n + 1))
    return [(np.concatenate((at[a:b], bins[i].astype(np.int64))), np.concatenate((values[a:b], np.ones(len(ratios))))) for i, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by full-gradient Adagrad."""
    weights, bias = np.zeros(1 << BITS), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))) if len(labels) else 0.0
    if not len(labels):
        return weights, bias
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, where = C.distinct_places(at)
    w, power, bias_power = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[where], minlength=len(rows)) + bias, -30, 30)))
        error = (p - labels) / len(rows)
        g = np.bincount(where, value * error[row], minlength=len(used)) + decay * w
        power += g * g
        w -= rate * g / np.sqrt(power)
        bias_power += error.sum() ** 2
        bias -= rate * error.sum() / bias_power**0.5
    weights[used] = w
    return weights, bias


def _measured(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return dict(zip(NAMES, text_stats(batch), strict=True))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Posteriors by pattern, vote probabilities, and the scorer's weights."""
    spark = docs.sparkSession
    C.arrow_batches(spark)
    n = docs.count()
    least = min(1.0, 1.2 * fit_rows / max(1, n))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _measured(batch)
            place = batch.column(0).to_numpy().view(np.uint64)
            chosen = place / 2.0**64 < least
            got = features(batch.column(1).filter(pa.array(chosen)), {k: v[chosen] for k, v in stats.items()})
            found = iter(got)
            pairs = [next(found) if c else None for c in chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pattern(votes(stats))), pa.array([p[0] if p else None for p in pairs], pa.list_(pa.int64())), pa.array([p[1] if p else None for p in pairs], pa.list_(pa.float64()))],
                ["h", "pattern", "at", "value"],
            )

    rows = docs.select(F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"), "text").mapInArrow(measure, "h long, pattern long, at array<long>, value array<double>")
    rows = C.written(spark, rows, "votes")
    seen = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r.pattern for r in seen], np.int64), np.array([r.n for r in seen], np.float64)
    post, theta, shares = expectation_maximisation(patterns, counts)
    poor = 1 - post[:, -1]
    table = dict(zip(patterns.tolist(), poor.tolist(), strict=True))
    sample = rows.filter("at is not null").orderBy("h", "pattern").limit(fit_rows).select("pattern", "at", "value").collect()
    weights, bias = fit([(np.array(r["at"], np.int64), np.array(r["value"])) for r in sample], np.array([table[r.pattern] for r in sample]))
    C.drop_table(spark, rows)
    return {"post": table, "theta": theta, "share": float(1 - shares[-1]), "accuracies": accuracies(patterns, counts, poor), "weights": weights.astype(np.float32), "bias": bias}


def quality_scores(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, posterior, score, kept): probability of *fine* by the labellers and by the scorer."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            stats = _measured(batch)
            post = np.array([1 - m["post"].get(p, m["share"]) for p in pattern(votes(stats)).tolist()], np.float64)
            raw = np.array([float(m["weights"][at] @ value) for at, value in features(batch.column(1), stats)], np.float64) + m["bias"]
            fine = 1 / (1 + np.exp(np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post), pa.array(fine), pa.array(fine >= 0.5)], ["doc_id", "posterior", "score", "kept"])

    schema = StructType([docs.schema["doc_id"]]).add("posterior", "double").add("score", "double").add("kept", "boolean")
    return docs.select("doc_id", "text").mapInArrow(score, schema)
