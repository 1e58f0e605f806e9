"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1; unlabelled text is every
row, whatever its label.  A logistic model over text features minimises the
non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

by Newton steps.  While the second term is negative its own gradient is climbed
instead, so that the model does not profit from fitting positives among the
unlabelled text.  Each step is a pass of sums over the features of all rows,
which are computed once and settled (90 bytes a row): nothing is sampled, and
16 partial sums at most come to the driver.  The class prior is estimated as the
share of positives among the labelled training rows, negatives included.

Null text counts as empty and gets the score of an empty text.  Rows of a null
label teach nothing; repeated rows each get a row.  Rows that share an id share
its label, also where their texts differ.  The order of rows, and so any tie,
does not matter to sums.  Without any positive the score is the prior for every
text.  Columns other than the named are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, column_ddl, pa_schema, scratch, settled, text_batches

THRESHOLD = 0.3
STEPS, RIDGE, SETTLED = 25, 1e-3, 1e-7
#: Partial sums that come to the driver.
SLOTS = 16

_BYTES = np.arange(256)
_GROUPS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "blank": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
    "stop": np.isin(_BYTES, [ord(c) for c in ".,;:?'\"-"]),
    "shout": _BYTES == ord("!"),
    "bar": _BYTES == ord("|"),
    "brace": np.isin(_BYTES, [ord(c) for c in "{}<>[]()=\\/_"]),
    "symbol": np.isin(_BYTES, [ord(c) for c in "#$%&*+@^~`"]),
    "high": _BYTES > 127,
}
_MATRIX = np.stack(list(_GROUPS.values()), 1).astype(float)
NAMES = (*_GROUPS, "log_words", "word_length", "distinct", "top_word", "top_pair", "run", "long_words", "line_words", "line_repeats", "capital_words", "one_letter", "squeeze")


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ _MATRIX / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    by = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    run = sum(k for (a, b), k in pairs.items() if a == b)
    lines = [line for line in text.split("\n") if line.strip()]
    squeezed = len(zlib.compress(data, 1)) / len(data) if data else 1.0
    more = (
        np.log1p(len(words)),
        len(text) / n,
        len(by) / n,
        max(by.values(), default=0) / n,
        max(pairs.values(), default=0) / n,
        run / n,
        sum(k for w, k in by.items() if len(w) > 20) / n,
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(k for w, k in by.items() if w[0].isupper()) / n,
        sum(k for w, k in by.items() if len(w) == 1) / n,
        squeezed,
    )
    return np.concatenate((shares, more))


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.mean, self.spread, self.weights = mean, spread, weights

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, how far each stands out to either side, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate((z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), np.ones((len(z), 1))), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def zero_sums(width: int) -> np.ndarray:
    return np.zeros(4 + 3 * width + width * width)


def risk_sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What the risk at ``w`` is made of, summed over rows of expanded features: numbers of rows and positives, the losses
    of all rows as negatives and of positives as negatives, the gradients of both, the positives' features, the curvature."""
    z = x @ w
    s, loss = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.logaddexp(0, z)
    p = positive.astype(float)
    curve = (x * (s * (1 - s))[:, None]).T @ x
    return np.concatenate(([len(x), p.sum(), loss.sum(), p @ loss], s @ x, (p * s) @ x, p @ x, curve.ravel()))


def risk(sums: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The non-negative risk, its second term before the cut at 0, the gradient to descend, and the curvature."""
    k = len(w)
    n, n_p, loss, loss_p = sums[:4]
    grad, grad_p, mean_p = sums[4 : 4 + k] / n, sums[4 + k : 4 + 2 * k] / n_p, sums[4 + 2 * k : 4 + 3 * k] / n_p
    second = loss / n - prior * loss_p / n_p
    value = prior * (loss_p / n_p - mean_p @ w) + max(0.0, second) + RIDGE / 2 * (w @ w)
    push = grad - prior * grad_p  # of the second term
    down = prior * (grad_p - mean_p) + push + RIDGE * w if second >= 0 else -push
    return value, second, down, sums[4 + 3 * k :].reshape(k, k) / n + RIDGE * np.eye(k)


def minimise(sums_at, prior: float, width: int) -> np.ndarray:
    """Weights of least risk; ``sums_at(w)`` gives ``risk_sums`` over all rows.  A step that raises the risk is halved."""
    w = np.zeros(width)
    w[-1] = np.log(prior / (1 - prior))
    best, at, step, flips = (np.inf, w), w, None, 0
    for _ in range(STEPS):
        value, second, down, curve = risk(sums_at(at), prior, at)
        gain = best[0] - value
        if gain > 0:
            best = (value, at)
        if second < 0:
            flips += 1
        if abs(gain) < SETTLED or flips > 3:
            break
        if gain < 0 and second >= 0:
            step = step / 2
            at = best[1] + step
            continue
        step = -np.linalg.solve(curve, down)
        at = at + (step if second >= 0 else step / 2)
    return best[1]


def held_out(id_col: str = "doc_id", mod: int = 5, rest: int = 0):
    """Whether crc32 of the id as text leaves ``rest``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x``: the features of each row, packed."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"{column_ddl(rows, 'id')}, x binary"
    schema = pa_schema(ddl)

    def run(batches):
        for ids, texts in text_batches(batches):
            yield arrow((ids, [features(t).astype(np.float32).tobytes() for t in texts]), schema)

    return rows.mapInArrow(run, ddl)


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(float)


def _summed(rows: DataFrame, one, width: int) -> np.ndarray:
    """The sum over all batches of ``rows`` of what ``one`` gives for a batch: by task, by slot, and on the driver."""

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += one(batch.slice(at, 4096))
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def together(batches):
        total = np.zeros(width)
        for batch in batches:
            for b in batch.column(1).to_pylist():
                total += np.frombuffer(b)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(partial, "slot int, sums binary").repartition(SLOTS, "slot").mapInArrow(together, "sums binary")
    return np.sum([np.frombuffer(bytes(r["sums"])) for r in parts.collect()], 0)


def fit_features(rows: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id") -> Model:
    """Fits on ``rows`` (id, x) of ``feature_rows`` and the labels of their ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    n_pos, n_all = known.agg(F.count_if(F.col(label_col) == 1), F.count("*")).first()
    prior = min(max(n_pos / n_all if n_all else 0.5, 0.05), 0.95)
    width = len(NAMES)
    flat = np.zeros(3 * width + 1)
    flat[-1] = np.log(prior / (1 - prior))
    trusted = known.where(F.col(label_col) == 1).select(F.col(label_id).alias("p")).distinct()
    with scratch(rows.sparkSession):
        both = settled(rows.join(trusted, F.col("id") == F.col("p"), "left").select("x", F.col("p").isNotNull().alias("pos")))

        def moments(batch):
            x = _matrix(batch.column(0))
            return np.concatenate(([len(x), sum(batch.column(1).to_pylist())], x.sum(0), (x * x).sum(0)))

        got = _summed(both, moments, 2 + 2 * width)
        n, n_p = got[:2] if np.ndim(got) else (0, 0)
        if not n or not n_p:
            return Model(np.zeros(width), np.ones(width), flat)
        mean = got[2 : 2 + width] / n
        spread = np.sqrt(np.maximum(got[2 + width :] / n - mean**2, 0)) + 1e-6
        shape = Model(mean, spread, flat)

        def sums_at(w):
            return _summed(both, lambda batch: risk_sums(shape.expand(_matrix(batch.column(0))), np.array(batch.column(1).to_pylist(), bool), w), len(zero_sums(len(w))))

        return Model(mean, spread, minimise(sums_at, prior, len(flat)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on ``docs`` and the labels of their ids; pass training rows only."""
    with scratch(docs.sparkSession):
        return fit_features(settled(feature_rows(docs, id_col, text_col)), labels, label_col, id_col)


def feature_scores(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``id, score, predicted`` of ``rows`` (id, x)."""
    ddl = f"{column_ddl(rows, 'id')}, score double, predicted int"
    schema = pa_schema(ddl)
    packed = (model.mean, model.spread, model.weights)

    def run(batches):
        own = Model(*packed)
        for batch in batches:
            s = own.score(_matrix(batch.column(1)))
            yield arrow((batch.column(0), s, (s >= threshold).astype(np.int32)), schema)

    return rows.select("id", "x").mapInArrow(run, ddl)


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` and ``predicted`` of each row."""
    return feature_scores(feature_rows(docs, id_col, text_col), model, threshold).withColumnRenamed("id", id_col)
