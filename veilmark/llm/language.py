"""Language identification by rank-order profiles.

A language's profile is its ``PROFILE`` most frequent n-grams (one to three
letters, words padded with a blank) in the training documents, ranked by count
and then by code points.  A document's own most frequent n-grams are compared
with each profile: an n-gram costs the difference of its two ranks, or
``PROFILE`` where the profile lacks it.  The language with the smallest sum
wins; ties go to the first by code point.  The score is 1 - sum / largest
possible sum.

Null text and text without letters get ``und`` with score 0; so does every
document when there is nothing to learn from.  Rows of a null language are
predicted but never learnt.  Repeated rows each get a row; columns other than
the named ones are not read.
Counting is vectorised over slices of about 256 thousand characters.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column_ddl, pa_schema, text_batches

PROFILE = 300
SLICE = 1 << 18
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if "alpha" not in _TABLES:
        _TABLES["alpha"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _TABLES["local"] = np.zeros(0x110000, np.int64)
    return _TABLES["alpha"]


class Grams:
    """The n-grams of some texts: sorted keys of (text, n-gram), with a numbering of the letters that occur."""

    def __init__(self, texts: list[str]):
        alpha = _letters()
        low = [t.lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        doc = np.concatenate(([0], doc))
        letter = alpha[codes]
        keep = letter | np.concatenate(([True], letter[:-1]))
        codes, letter, doc = codes[keep], letter[keep], doc[keep]
        self.letters = np.unique(codes[letter])
        self.bits = max(1, int(len(self.letters)).bit_length())
        local = _TABLES["local"]
        local[self.letters] = np.arange(1, len(self.letters) + 1)
        x = np.where(letter, local[codes], 0)
        b, top = self.bits, 3 * self.bits
        self.shift = top + 2
        one = letter
        two_doc = np.where(letter[:-1], doc[:-1], doc[1:])
        two = letter[:-1] | letter[1:]
        three = letter[1:-1]
        self.keys = np.concatenate(
            (
                (doc[one] << self.shift) | (1 << top) | x[one],
                (two_doc[two] << self.shift) | (2 << top) | (x[:-1][two] << b) | x[1:][two],
                (doc[1:-1][three] << self.shift) | (3 << top) | (x[:-2][three] << 2 * b) | (x[1:-1][three] << b) | x[2:][three],
            )
        )
        self.keys.sort()

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, n-gram and count, sorted by text and n-gram."""
        k = self.keys
        if not len(k):
            return k, k, k
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        count = np.diff(np.concatenate((first, [len(k)])))
        k = k[first]
        return k >> self.shift, k & ((1 << self.shift) - 1), count

    def encode(self, gram: str) -> int:
        """The number of an n-gram here, -1 if one of its letters does not occur; a blank is the padding."""
        value = 0
        for c in gram:
            at = 0
            if c != " ":
                i = int(np.searchsorted(self.letters, ord(c)))
                if i == len(self.letters) or self.letters[i] != ord(c):
                    return -1
                at = i + 1
            value = value << self.bits | at
        return len(gram) << 3 * self.bits | value

    def decode(self, gram: int) -> str:
        n, mask = gram >> 3 * self.bits, (1 << self.bits) - 1
        parts = [gram >> self.bits * (n - 1 - i) & mask for i in range(n)]
        return "".join(chr(self.letters[p - 1]) if p else " " for p in parts)


def fit_profiles(docs: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The profiles of the languages of ``docs``; all its rows with a language and a text are counted."""

    def partial(batches):
        sums: dict[str, Counter] = {}
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

        def flush():
            for lang, grams in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams.keys())), pa.array(list(grams.values()), pa.int64())], schema=schema)
            sums.clear()

        for langs, texts in text_batches(batches, SLICE):
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                grams = Grams(["\n".join(some)])
                _, gram, count = grams.counted()
                into = sums.setdefault(lang, Counter())
                for g, n in zip(gram.tolist(), count.tolist(), strict=True):
                    into[grams.decode(g)] += n
            if sum(map(len, sums.values())) > 500_000:
                yield from flush()
        yield from flush()

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    sums = known.mapInArrow(partial, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[str]] = {}
    for row in sums.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Classifier:
    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.grams = sorted({g for p in profiles.values() for g in p})
        at = {g: i for i, g in enumerate(self.grams)}
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            for r, g in enumerate(profiles[lang]):
                self.ranks[at[g], j] = r

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n = len(texts)
        grams = Grams(texts)
        doc, gram, count = grams.counted()
        if not len(doc) or not self.langs:
            return ["und"] * n, [0.0] * n
        order = np.argsort((doc << 32) | ((1 << 32) - 1 - np.minimum(count, (1 << 32) - 1)), kind="stable")
        doc, gram = doc[order], gram[order]
        starts = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(doc)) - starts[doc]
        top = rank < self.size
        doc, gram, rank = doc[top], gram[top], rank[top]
        here = np.array([grams.encode(g) for g in self.grams], np.int64)
        by = np.argsort(here)
        at = np.minimum(np.searchsorted(here[by], gram), len(by) - 1)
        row = np.where(here[by][at] == gram, by[at], len(self.grams))
        theirs = self.ranks[row]
        cost = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        total = np.stack([np.bincount(doc, cost[:, j], n) for j in range(len(self.langs))], 1)
        most = np.bincount(doc, minlength=n) * float(self.size)
        best = total.argmin(1)
        langs = [self.langs[b] if m else "und" for b, m in zip(best, most, strict=True)]
        scores = [float(1 - t / m) if m else 0.0 for t, m in zip(total.min(1), most, strict=True)]
        return langs, scores


def identify(docs: DataFrame, profiles: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` of each row."""
    ddl = f"{column_ddl(docs, id_col)}, lang_pred string, score double"
    schema = pa_schema(ddl)

    def run(batches):
        model = Classifier(profiles)
        for ids, texts in text_batches(batches, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, *model.predict(texts)), schema, strict=True)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, ddl)


def keep_identified(docs: DataFrame, profiles: dict[str, list[str]], min_score: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that have a language with at least ``min_score``; without profiles, those with letters."""
    at = docs.columns.index(text_col)

    def run(batches):
        model = Classifier(profiles)
        for batch in batches:
            rows = batch.select([at, at])
            start = 0
            for _, texts in text_batches([rows], SLICE):
                if profiles:
                    kept = [lang != "und" and s >= min_score for lang, s in zip(*model.predict(texts), strict=True)]
                else:
                    kept = [any(c.isalpha() for c in t) for t in texts]
                yield batch.slice(start, len(texts)).filter(pa.array(kept, pa.bool_()))
                start += len(texts)

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", mod: int = 4, rest: int = 2):
    """Whether crc32 of the id as text leaves ``rest``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest
