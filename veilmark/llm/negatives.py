"""Hard negatives by distributed radix selection.

A window belongs to an anchor and, for negatives, to one of its positives: the
rows of the wanted label (the anchor's, or any other) whose score with the anchor
lies between two bounds.  Its best ``k`` rows are found without sorting it: each
task counts the scores of its rows by the leading digit of their distance from
the window's top, the counts are added up, and the bucket that holds the kth row
is located; the next pass counts that bucket alone by its next digit.  A bucket
that is taken whole, or holds at most ``SMALL`` rows, needs no more digits.  Then
the rows before the bucket and those in it are gathered (of rows of one score a
task passes on the ``k`` of smallest id) and ranked.

Anchors are taken in blocks of ``BLOCK`` (by id), each against all rows, which
stay where they are: a block's anchors and windows go to the tasks, counts by
bucket come back.  So the driver and a task hold one block, whatever the table's
size; a task's counts take 4 bytes a window and bucket.

Components become floor(256 * x); scores are their integer inner products, in
float64 where that is exact, else in 64-bit integers.  A row takes part if it has
an id, a label and a vector without a null, non-finite or larger component than
``LARGEST``; rows whose vectors differ in length are not scored with each other.
Rows that share an id are candidates each, never for an anchor of that id; as an
anchor, the one of smallest label, then vector, counts.  An empty table, or one
without anchors, gives no rows.  Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow, pa_schema, scratch, settled, settled_parts

BLOCK = 2048
DIGIT = 10
SMALL = 16
#: Components up to this size, so that a score of 8,192 of them, and a distance of scores, fits in a long.
LARGEST = 1 << 24
#: Scores that a task holds at a time.
PAIRS = 1 << 20
FOUND = "anchor long, part int, id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Beyond all scores.
_NONE = 1 << 62


def mined_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, moved on by one of ten where the id is divisible by 7."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


def vectors(batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integer vectors) of the rows of a batch (id, label, vector) that take part, by vector length."""
    ids, labels, lists = (batch.column(i) for i in range(3))
    whole = np.flatnonzero(np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & np.asarray(lists.is_valid()))
    if not len(whole):
        return
    offsets = lists.offsets.to_numpy()
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
    starts, lengths = offsets[:-1][whole], np.diff(offsets)[whole]
    ids, labels = (np.asarray(c.take(whole).to_numpy(zero_copy_only=False), np.int64) for c in (ids, labels))
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(256 * values[starts[own][:, None] + np.arange(length)])
            good = (np.isfinite(x) & (np.abs(x) <= LARGEST)).all(axis=1)
        if good.any():
            yield ids[own[good]], labels[own[good]], x[good]


def _rows(table: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"))


def anchors_of(rows: DataFrame, every: int) -> DataFrame:
    """``id, label, vector`` (integers) of the rows that are anchors, one for an id."""
    schema = pa_schema(ddl := "id long, label long, vector array<long>")

    def run(batches):
        for batch in batches:
            for ids, labels, x in vectors(batch):
                yield arrow([ids, labels, list(x.astype(np.int64))], schema)

    found = rows.where(F.col("id") % every == 0).mapInArrow(run, ddl)
    return found.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")


class Block:
    """Anchors, and windows on their scores: (anchor's place, part, lowest, highest score), best k, of the anchor's label or of others."""

    def __init__(self, ids, labels, arrays, same: bool, k: int):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.same, self.k = same, k
        self.of_length = {}
        lengths = np.array([len(a) for a in arrays])
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            self.of_length[length] = own, np.array([arrays[i] for i in own.tolist()], np.float64).reshape(len(own), length)

    def windows(self, anchor, part, low, high) -> None:
        """Sets the windows; those of an anchor stand side by side, so that a part is one array over anchors."""
        self.anchor, self.part = np.array(anchor, np.int64), np.array(part, np.int64)
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        n = len(self.anchor)
        self.parts = [np.flatnonzero(self.part == p) for p in np.unique(self.part).tolist()]
        width = int((self.high - self.low).max()) + 1 if n else 1
        self.shift = max(0, width.bit_length() - DIGIT)
        #: Distances [first, last) of the bucket that holds the kth row, and the rows wanted of it; at first the whole window.
        self.first, self.last, self.wanted = np.zeros(n, np.int64), self.high - self.low + 1, np.full(n, self.k, np.int64)
        self.open = np.ones(n, bool)

    def scores(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, places of anchors, scores, wanted) of rows against anchors; scores and wanted are matrices, rows by anchors."""
        for batch in batches:
            for ids, labels, x in vectors(batch):
                if x.shape[1] not in self.of_length:
                    continue
                places, a = self.of_length[x.shape[1]]
                step = max(1, PAIRS // len(places))
                for at in range(0, len(ids), step):
                    i, lab, v = ids[at : at + step], labels[at : at + step], x[at : at + step]
                    bound = x.shape[1] * np.abs(v).max(initial=0) * np.abs(a).max(initial=0)
                    s = v @ a.T if bound < 1 << 53 else v.astype(np.int64) @ a.T.astype(np.int64)
                    equal = lab[:, None] == self.labels[places]
                    yield i, places, s, (equal if self.same else ~equal) & (i[:, None] != self.ids[places])

    def members(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, ids, distances from the top) of the rows that lie in windows."""
        by_anchor = [np.full(len(self.ids), -1, np.int64) for _ in self.parts]
        for own, of in zip(by_anchor, self.parts, strict=True):
            own[self.anchor[of]] = of
        least, most = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        np.minimum.at(least, self.anchor, self.low)
        np.maximum.at(most, self.anchor, self.high)
        for ids, places, s, wanted in self.scores(batches):
            row, col = np.nonzero(wanted & (s >= least[places]) & (s <= most[places]))
            s = s[row, col].astype(np.int64)
            for own in by_anchor:
                w = own[places[col]]
                has = np.flatnonzero(w >= 0)
                has = has[(s[has] >= self.low[w[has]]) & (s[has] <= self.high[w[has]])]
                yield w[has], ids[row[has]], self.high[w[has]] - s[has]


def _bounds(rows: DataFrame, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that have a wanted row, and their lowest and highest score."""
    schema = pa_schema(ddl := "anchor long, low long, high long")

    def run(batches):
        low, high = np.full(len(block.ids), _NONE), np.full(len(block.ids), -_NONE)
        for _, places, s, wanted in block.scores(batches):
            low[places] = np.minimum(low[places], np.where(wanted, s, _NONE).min(axis=0).astype(np.int64))
            high[places] = np.maximum(high[places], np.where(wanted, s, -_NONE).max(axis=0).astype(np.int64))
        some = np.flatnonzero(low < _NONE)
        yield arrow([some, low[some], high[some]], schema)

    got = rows.mapInArrow(run, ddl).groupBy("anchor").agg(F.min("low"), F.max("high")).orderBy("anchor").collect()
    return tuple(np.array(c, np.int64) for c in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 3


def _narrow(rows: DataFrame, block: Block) -> None:
    """One digit: counts of the open windows by bucket, added up over tasks, and the bucket of each that holds the kth row."""
    schema = pa_schema(ddl := "w int, bucket int, n long, k long")
    buckets, shift = 1 << DIGIT, block.shift
    # Windows still open are numbered afresh, so that counts take memory for them alone.
    still = np.flatnonzero(block.open)
    place = np.full(len(block.open), -1, np.int64)
    place[still] = np.arange(len(still))

    def run(batches):
        counts = np.zeros(len(still) * buckets, np.int32)
        for w, _, far in block.members(batches):
            own = np.flatnonzero(block.open[w] & (far >= block.first[w]) & (far < block.last[w]))
            at = place[w[own]] * buckets + ((far[own] - block.first[w[own]]) >> shift)
            some, n = np.unique(at, return_counts=True)
            counts[some] += n.astype(np.int32)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 18):
            own = some[at : at + (1 << 18)]
            yield arrow([own // buckets, own % buckets, counts[own], block.wanted[still[own // buckets]]], schema)

    added = rows.mapInArrow(run, ddl).groupBy("w", "bucket").agg(F.sum("n").alias("n"), F.first("k").alias("k"))
    through = F.sum("n").over(Window.partitionBy("w").orderBy("bucket"))
    # The bucket of the kth row; where fewer rows are left there is none, and all are taken.
    kth = added.withColumn("through", through).where((F.col("through") >= F.col("k")) & (F.col("through") - F.col("n") < F.col("k")))
    block.open[still] = False
    for w, bucket, n, through, k in kth.select("w", "bucket", "n", "through", "k").collect():
        own = still[w]
        block.first[own] += bucket << shift
        block.last[own] = min(block.last[own], block.first[own] + (1 << shift))
        block.wanted[own] = k - (through - n)
        block.open[own] = n > max(SMALL, block.wanted[own]) and shift > 0


def _selected(rows: DataFrame, block: Block) -> DataFrame:
    """``anchor, part, id, score``: the rows up to and in the bucket of the kth, at most k of one score from a task."""
    while block.open.any():
        _narrow(rows, block)
        if block.shift == 0:
            break
        block.shift = max(0, block.shift - DIGIT)
    k, schema = block.k, pa_schema(FOUND)

    def run(batches):
        held = np.empty((0, 3), np.int64)  # window, distance, id

        def best(x):
            """At most k rows of each window and distance, those of smallest id."""
            x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:, :2] != x[:-1, :2]).any(axis=1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            return x[np.arange(len(x)) - first < k]

        for w, ids, far in block.members(batches):
            own = np.flatnonzero(far < block.last[w])
            if len(own):
                held = np.concatenate((held, np.stack((w[own], far[own], ids[own]), axis=1)))
                if len(held) > PAIRS:
                    held = best(held)
                    if len(held) > PAIRS // 2:  # tasks need not hold what cannot shrink
                        yield out(held)
                        held = held[:0]
        if len(held):
            yield out(best(held))

    def out(x):
        w = x[:, 0]
        return arrow([block.ids[block.anchor[w]], block.part[w], x[:, 2], block.high[w] - x[:, 1]], schema)

    return rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each window, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    table: DataFrame, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding",
    every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (the ranks are ints from 1).

    Anchors are the rows whose id is divisible by ``every``; their positives the
    best rows of their label; negatives the best rows of other labels whose score
    is at least ``percent`` of the positive's and not above it.
    """
    rows = _rows(table, id_col, F.col(label) if isinstance(label, str) else label, vector_col)
    spark = table.sparkSession
    with scratch(spark) as keep:
        anchors = settled(anchors_of(rows, every))

        def blocks():
            after = None
            while own := (anchors if after is None else anchors.where(F.col("id") > after)).orderBy("id").limit(block).collect():
                after = own[-1].id
                with scratch(spark):
                    yield _mine_block(rows, own, positives, negatives, percent)

        return keep(settled_parts(spark, blocks(), MINED))


def _mine_block(rows: DataFrame, own: list, positives: int, negatives: int, percent: int) -> DataFrame:
    ids, labels, arrays = ([r[i] for r in own] for i in range(3))
    near = Block(ids, labels, arrays, True, positives)
    anchor, low, high = _bounds(rows, near)
    near.windows(anchor, np.zeros(len(anchor)), low, high)
    best = settled(_ranked(_selected(rows, near), positives).select("anchor", "id", "score", "rank"))
    far = Block(ids, labels, arrays, False, negatives)
    place = {a: i for i, a in enumerate(ids)}
    windows = [(place[p.anchor], p["rank"], -((-percent * p.score) // 100), p.score) for p in best.where("score >= 0").orderBy("anchor", "rank").collect()]
    far.windows(*zip(*windows, strict=True)) if windows else far.windows([], [], [], [])
    hard = _ranked(_selected(rows, far), negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score", "rank": "place"})
    good = best.select("anchor", F.col("rank").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = hard.join(F.broadcast(good), ["anchor", "part"])
    return both.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score")

