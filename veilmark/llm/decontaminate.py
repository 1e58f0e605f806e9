"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to words (A-Z lower-cased; ASCII other than
letters and digits separates).  The automaton holds every run of words of every
item.  A document's words are streamed through it, keeping the longest run that
ends at each word.  Where that run reaches ``window`` words, the last ``window``
words are a window of an item and are hit; an item of fewer words is one window
by itself.  The items of a window are those of the state that holds it.

The item set is a stated query set, dealt by a hash of the item into blocks of
about ``BLOCK_WORDS`` words.  One block is collected at a time, and its automaton
is built in each task that streams rows past it.  Up to one block, that is the
only pass; with more, each makes a pass of its own over the rows, and the spans
and items of a row are merged by its number afterwards.  So memory follows the
block (about 1 kB a word), not the item set, and no bound drops an item.

Null text has no words.  Items of null text or without words have no window; a
null item_id is written as an empty string.  Items with equal ids or equal texts
both count once per id.  Without items nothing is hit.  Repeated documents each
get a row; columns other than the named ones are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow, column_ddl, fresh, pa_schema, scratch, settled, text_batches

WINDOW = 10
BLOCK_WORDS = 200_000
#: Lower case, and a blank for every ASCII character that is no letter or digit; bytes over 127 belong to words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over words.  State 0 is the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[str]] = [set()]
        for name, words in items:
            if not words:
                continue
            last = 0
            for w in words:
                last = self._extend(last, w, owners)
                owners[last].add(name)
        self._spread(owners)
        self.shorts = self._short_ends(items)

    def _extend(self, last: int, w: bytes, owners: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w, owners)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        owners.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w, owners)
        return new

    def _split(self, p: int, q: int, w: bytes, owners: list[set[str]]) -> int:
        """A state for the run of ``p`` and ``w``, taken out of ``q``."""
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        owners.append(set())
        link[q] = twin
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def _spread(self, owners: list[set[str]]) -> None:
        """Items of a state: those that end in it or in a state that links to it; kept for windows only."""
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        base = lambda s: self.length[self.link[s]] if s else 0
        # The state that holds the last `window` words of a longer run is an ancestor of the run's state.
        self.items: list[frozenset | None] = [frozenset(owners[s]) if base(s) < self.window <= self.length[s] else None for s in range(len(self.link))]
        #: Of each state that is as long as a window, that ancestor (or itself), so that a match takes no walk.
        self.holder = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            if self.length[s] >= self.window:
                self.holder[s] = s if base(s) < self.window else self.holder[self.link[s]]

    def _short_ends(self, items: list[tuple[str, list[bytes]]]) -> dict[int, list[tuple[int, frozenset]]]:
        """By state, the short items that end a run of it: (words, item ids), longest first; links are followed here, once."""
        by: dict[tuple[bytes, ...], set[str]] = {}
        for name, words in items:
            if 0 < len(words) < self.window:
                by.setdefault(tuple(words), set()).add(name)
        own: dict[int, tuple[int, frozenset]] = {}
        for words, names in by.items():
            s = 0
            for w in words:
                s = self.next[s][w]
            own.setdefault(s, []).append((len(words), frozenset(names)))
        out: dict[int, list[tuple[int, frozenset]]] = {}
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            ends = own.get(s, []) + out.get(self.link[s], [])
            if ends:
                out[s] = sorted(ends, key=lambda e: -e[0])
        return out

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [first, end) word spans that are hit, and the items whose windows occur."""
        nxt, link, length, window, items, shorts, holder = self.next, self.link, self.length, self.window, self.items, self.shorts, self.holder
        spans: list[list[int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        state = run = 0
        root = nxt[0]
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is not None:
                run += 1
                state = to
            elif w in root:
                while w not in nxt[state]:
                    state = link[state]
                run = length[state] + 1
                state = nxt[state][w]
            else:
                state = run = 0
                continue
            hit = 0
            if run >= window:
                hit = window
                s = holder[state]
                if s not in seen:
                    seen.add(s)
                    found |= items[s]
            if state in shorts:
                for n, names in shorts[state]:
                    if n <= run:
                        hit = max(hit, n)
                        found |= names
            if hit:
                first = i + 1 - hit
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = i + 1
                else:
                    spans.append([first, i + 1])
        return spans, found


def collect_items(benchmark: DataFrame) -> list[tuple[str, list[bytes]]]:
    """The items of one block, as words."""
    return [(r["i"], words_of(r["t"])) for r in benchmark.orderBy("i", "t").collect()]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items (``i``, ``t``) in blocks of about ``block_words`` words, or one item; none without items."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.regexp_count("t", F.lit(WORD)).cast("long"))).first()[0] or 0
    if total <= block_words:
        return [items] if total else []
    n = -(-total // block_words)
    placed = settled(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition(F.col("block")))
    return [placed.where(F.col("block") == b).drop("block") for b in range(n)]


def places(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Word spans with the code points where they start and end."""
    if not spans:
        return []
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(NORMAL))]
    out, at, point = [], 0, 0
    for a, b in spans:
        edges = []
        for byte in (words[a][0], words[b - 1][1]):
            point += len(data[at:byte].decode("utf-8", "surrogatepass"))
            at = byte
            edges.append(point)
        out.append([a, b, *edges])
    return out


def hits(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int, with_text: bool) -> DataFrame:
    """``row`` and, if wanted, ``text`` of ``rows``, ``n_words``, ``items``, and merged ``spans``: first and end word, first and end code point."""
    spark = rows.sparkSession
    rows = rows.select("row", F.col("text").cast("string").alias("text"))

    def one_pass(rows: DataFrame, block: DataFrame | None, with_text: bool) -> DataFrame:
        ddl = f"{column_ddl(rows, 'row')}, {'text string, ' if with_text else ''}n_words long, spans array<array<bigint>>, items array<string>"
        schema = pa_schema(ddl)
        items = spark.sparkContext.broadcast(collect_items(block) if block is not None else [])

        def run(batches):
            automaton = Automaton(items.value, window)
            for batch in batches:
                at = 0
                for _, texts in text_batches([batch.select([1, 1])]):
                    part = batch.slice(at, len(texts))
                    at += len(texts)
                    words = [words_of(t) for t in texts]
                    found = [automaton.match(w) for w in words]
                    spans = [places(t, s) for t, (s, _) in zip(texts, found, strict=True)]
                    yield arrow((*part.columns[: 1 + with_text], [len(w) for w in words], spans, [sorted(f) for _, f in found]), schema)

        return rows.mapInArrow(run, ddl)

    with scratch(spark) as keep:
        blocks = item_blocks(benchmark, block_words=block_words)
        if len(blocks) <= 1:
            return one_pass(rows, blocks[0] if blocks else None, with_text)
        rows = keep(rows.withColumn("number", F.monotonically_increasing_id()))
        every = None
        for block in blocks:
            found = settled(one_pass(rows.select(F.col("number").alias("row"), "text"), block, False).where("size(spans) > 0"))
            every = found if every is None else every.unionByName(found)
        spans = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast("array<array<bigint>>"), _join_spans)
        items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        every = keep(every.groupBy(F.col("row").alias("number")).agg(spans.alias("spans"), items.alias("items")))
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("n_words")
    none = {"spans": "array<array<bigint>>", "items": "array<string>"}
    return rows.join(every, "number", "left").select("row", *["text"] * with_text, n_words, *(F.coalesce(n, F.array().cast(t)).alias(n) for n, t in none.items()))


def _join_spans(a: Column, x: Column) -> Column:
    """One more span, in order of their starts, to merged ones."""
    last = F.element_at(a, -1)
    longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]), last[2], F.greatest(last[3], x[3]))))
    return F.when(F.size(a) == 0, F.array(x)).when(x[0] <= last[1], longer).otherwise(F.array_append(a, x))


def _hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row: words, hit words, items with windows that occur, and the word spans."""
    found = hits(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), benchmark, window, block_words, False)
    found = found.withColumn("n_hit", _hit_words())
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    spans = F.transform("spans", lambda s: F.slice(s, 1, 2)).alias("hit_spans")
    return found.select(F.col("row").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"), F.col("items").alias("item_ids"), spans)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = 1, max_share: float = 0.5, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans of at least ``min_words`` words; a row with more than ``max_share`` of its words hit is removed.

    A span is what hit windows cover together: at least ``window`` words, or a
    whole item of fewer.  It goes with what stands between its words, and a blank
    takes its place.  Shorter spans than ``min_words`` stay, but count towards the share.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(True).alias(fresh(others, "beside")), *(F.col(f"`{c}`") for c in others))
    found = hits(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text")), benchmark, window, block_words, True)
    kept = found.where((F.col("n_words") == 0) | (_hit_words() <= F.col("n_words") * max_share))
    kept = kept.withColumn("spans", F.filter("spans", lambda s: s[1] - s[0] >= min_words))

    def before(s, i):
        since = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)[3])
        return F.substring(F.col("text"), (since + 1).cast("int"), (s[2] - since).cast("int"))

    tail = F.substring(F.col("text"), (F.element_at("spans", -1)[3] + 1).cast("int"), F.length("text"))
    new = F.concat(F.array_join(F.transform("spans", before), " "), F.lit(" "), tail)
    text = F.when(F.size("spans") > 0, new).otherwise(F.col("text"))
    return kept.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
