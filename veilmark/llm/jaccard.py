"""Exact Jaccard similarity join on word shingles: a grouped prefix join.

1. Documents with equal shingle sets become one node; nodes with the same
   prefix and size become one group, and its smallest node leads it.
   Prefixes follow one global order: shingles that are frequent somewhere go
   last, by count; the rest by hash.  (Any order is exact; this one keeps the
   lists of frequent shingles out of most prefixes.)
2. Leaders that share a prefix shingle and pass the size and position filters
   are candidates.  A short list of leaders gives its pairs; a long one pairs
   its most central leader with each other one, so it costs its length only.
   A group pairs its leader with each member.
3. Candidates whose parity bitmaps differ in more bits than linked sets may
   differ in shingles are out (the bits bound the difference from below, so no
   link is lost); the rest is verified by exact intersection.  Links give components.
4. Lists that more than one component still shares are expanded to members;
   a group with several members has one at least, its first shingle's, even if
   no other leader is on it.  Those outside the list's largest component are
   paired with the members of other components, under the same filters, unless step 3 compared them.
   Pairs inside a component need no comparison, since their class is known.
So no link between components is lost, and a group of copies never gives all its pairs.

In step 4 documents of a list meet only within neighbouring bands of size, in
slices of a long list, and where 256 parity bits leave room for a link; what
remains of a list of n unlike documents is n * n tests of four numbers, spread
over tasks, of which almost none gives a row.

Two documents link when 100 * intersection >= percent * union.  Null text,
empty text and text without words have an empty set: no links, class is the
own id.  Rows with a null id are returned with a null class and link nothing.
Repeated rows are equal sets and so one class; rows that share an id but not
the text are documents of their own, each with the class of its own text.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import arrow, column_ddl, pa_schema, scratch, settled, text_batches
from .shingles import shingle_sets, signature

#: Lists of up to this many leaders give all their pairs.
SHORT = 16
#: Entries of the table of frequent shingles, which each task holds (16 bytes each).
FREQUENT = 400_000
#: A shingle counts as frequent from this many different documents in a slice of a task.
SEEN = 3
#: Shingles of the documents of such a slice.
HELD = 2_000_000
#: Rows of ids and set signatures (up to seven numbers, about 100 bytes in a hash table) up to which they are broadcast to
#: pick out their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a list in one slice of step 4.
SLICE = 2048


def _ceil(x: Column, by: int) -> Column:
    return F.floor((x + (by - 1)) / by).cast("int")


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def often(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that ``tokens`` holds ``SEEN`` times or more, and how many times; ``tokens`` is sorted in place."""
    tokens.sort()
    ends = max(0, len(tokens) - SEEN + 1)
    first = np.concatenate(([True], tokens[1:] != tokens[:-1]))[:ends]
    first &= tokens[:ends] == tokens[SEEN - 1 :]
    values = tokens[np.flatnonzero(first)]
    return values, np.searchsorted(tokens, values, "right") - np.searchsorted(tokens, values)


def frequent_shingles(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """Shingles that several different documents of a slice share, with their summed counts; at most ``FREQUENT``."""

    def run(batches):
        schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
        # One array holds the sets of a slice: thousands of small ones would leave a worker's memory in pieces.
        seen, held, room = set(), np.empty(HELD + HELD // 4, np.int64), 0

        def flush():
            tokens, counts = often(held[:room])
            return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(counts)], schema=schema)

        for _, texts in text_batches(batches):
            for own in shingle_sets(texts, size):
                sign = signature(own)
                if len(own) and sign not in seen:
                    seen.add(sign)
                    if room + len(own) > len(held):
                        held = np.concatenate((held[:room], np.empty(len(own) + HELD // 4, np.int64)))
                    held[room : room + len(own)] = own
                    room += len(own)
            if room > HELD:
                yield flush()
                seen, room = set(), 0
        if room:
            yield flush()

    counts = docs.select(F.lit(0).alias("i"), text_col).mapInArrow(run, "token long, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)


def parity_bits(own: np.ndarray) -> bytes:
    """A bitmap of at least four bits a shingle and 256 in all; a bit is the parity of the shingles that fall on it."""
    m = 1 << max(8, (4 * len(own) - 1).bit_length())
    place = (own ^ (own >> 29)) & (m - 1)
    return np.packbits((np.bincount(place, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes) -> np.ndarray:
    """The bitmap folded to 256 bits, as four numbers: how many bits of two differ bounds the sets' difference from below."""
    a = np.frombuffer(bits, np.uint64)
    while len(a) > 4:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.view(np.int64)


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded: at most the size of the sets' symmetric difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of each row: id, text hash, two halves of the set's signature, set size, prefix, how many at its start are not frequent, two halves of the prefix's signature, bitmap."""
    common = frequent_shingles(docs, size, "text").toPandas()
    common = common.sort_values("token")
    order = docs.sparkSession.sparkContext.broadcast((common["token"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    ddl = f"{column_ddl(docs, '_id')}, _h long, s1 long, s2 long, n int, prefix array<bigint>, n_rare int, p1 long, p2 long, bits binary"
    schema = pa_schema(ddl)

    def run(batches):
        tokens, counts = order.value
        for keys, texts in text_batches(batches):
            rows = []
            for own in shingle_sets(texts, size):
                first, rare = own, len(own)
                if len(own):
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        known = np.where(tokens[at] == own, counts[at], 0)
                        first, rare = own[np.argsort(known, kind="stable")], int((known == 0).sum())
                    first = first[: prefix_length(len(own), percent)]
                rows.append((*signature(own), len(own), first, rare, *signature(first), parity_bits(own)))
            yield arrow(([k["_id"] for k in keys], [k["_h"] for k in keys], *zip(*rows, strict=True)), schema)

    return docs.select(F.struct("_id", "_h").alias("key"), "text").mapInArrow(run, ddl)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Size filter, index prefix of the smaller set, and position filter of a shared shingle; columns of two rows of the lists."""
    nx, ny, px, py = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    small_x = (nx < ny) | ((nx == ny) & (F.col(f"{x}.node") < F.col(f"{y}.node")))
    small_n, small_p = F.when(small_x, nx).otherwise(ny), F.when(small_x, px).otherwise(py)
    index = small_n - _ceil(small_n * (2 * percent), 100 + percent) + 1
    need = _ceil((nx + ny) * percent, 100 + percent)
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (small_p < index) & (F.least(nx - px, ny - py) >= need)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _same_row(rows: DataFrame) -> Column:
    return (rows["_id"] == F.col("doc._id")) & (rows["_h"] == F.col("doc._h"))


def close_pairs(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(i).to_pylist() for i in range(6))
            # |A ^ B| = na + nb - 2 common, and a link has common >= percent (na + nb) / (100 + percent)
            kept = [differing(p, q) * (100 + percent) <= (m + n) * (100 - percent) for m, n, p, q in zip(na, nb, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema).filter(pa.array(kept, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def shingle_links(nodes: DataFrame, docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, with the exact size of their intersection."""
    pairs = settled(close_pairs(nodes, pairs.distinct(), percent))
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = settled(ids.join(nodes.select("node", "doc", "s1", "s2"), "node"))
    found = docs.join(_small(wanted), _same_row(docs)).select(F.struct("node", "s1", "s2").alias("key"), "text")
    schema = pa_schema("node long, tokens array<bigint>")

    def run(batches):
        for keys, texts in text_batches(batches):
            kept = [(k["node"], own) for k, own in zip(keys, shingle_sets(texts, size), strict=True) if signature(own) == (k["s1"], k["s2"])]
            if kept:
                yield arrow(zip(*kept, strict=True), schema)

    sets = settled(found.mapInArrow(run, "node long, tokens array<bigint>"))
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("common") * (100 + percent) >= (F.size("ta") + F.size("tb")) * percent).select("a", "b", "common")


def _classes(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _h, n, comp, component_id`` of each row: text hash, set size, class (null if the row links nothing), smallest id of it."""
    docs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as keep:
        rows = settled(prefixes(docs, size, percent))
        sets = rows.where("n > 0 and _id is not null").groupBy("s1", "s2", "n")
        sets = sets.agg(F.min(F.struct("_id", "_h")).alias("doc"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bits").alias("bits"))
        nodes = settled(sets.select(F.monotonically_increasing_id().alias("node"), "*"))
        grouping = nodes.groupBy("n", "p1", "p2").agg(F.min("node").alias("leader"), F.count("*").alias("members"))
        crowded = settled(grouping.where("members > 1"))
        member = settled(nodes.select("node", "n", "p1", "p2").join(crowded, ["n", "p1", "p2"]).where("node <> leader").select("node", "leader"))
        crowd = crowded.select(F.col("leader").alias("node"), F.lit(True).alias("crowd"))
        leaders = settled(nodes.select("node", "doc", "s1", "s2").join(member.select("node"), "node", "left_anti").join(crowd, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))))
        same = _same_row(rows) & (rows["s1"] == F.col("l.s1")) & (rows["s2"] == F.col("l.s2"))
        each = rows.join(_small(leaders).alias("l"), same).select("node", "n", "n_rare", "crowd", F.posexplode("prefix").alias("pos", "token"))
        # A list of one leader is of use only for the members behind it, and the first shingle passes every filter between them.
        useful = (F.col("m") > 1) | (F.col("crowd") & (F.col("pos") == 0))
        # Rare shingles are counted where one exchange brings them together; frequent ones, of which there are at most FREQUENT, by sums before it.
        rare = each.where("pos < n_rare").drop("n_rare").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).where(useful)
        often = each.where("pos >= n_rare").drop("n_rare")
        counts = often.groupBy("token").agg(F.count("*").alias("m"))
        lists = settled(rare.unionByName(often.join(F.broadcast(counts), "token").where(useful)))

        short = lists.where(F.col("m") <= SHORT)
        x, y = short.alias("x"), short.alias("y")
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & _may_link("x", "y", percent)).select(*_ordered("x", "y"))
        long = lists.where(F.col("m") > SHORT)
        central = long.groupBy("node").agg((F.sum("m") / F.sqrt(F.max("n"))).alias("weight"))
        best = long.join(central, "node").groupBy("token").agg(F.max(F.struct("weight", -F.col("node"), "n", "pos")).alias("best"))
        star = best.select("token", (-F.col("best")["col2"]).alias("node"), F.col("best")["n"].alias("n"), F.col("best")["pos"].alias("pos"))
        rays = long.alias("x").join(star.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & _may_link("x", "y", percent)).select(*_ordered("x", "y"))
        inside = member.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        first = settled(shingle_links(nodes, docs, pairs.union(rays).union(inside), size, percent))

        known = components(first)
        last = shingle_links(nodes, docs, _open_pairs(lists, member, known, nodes, percent), size, percent)
        known = components(settled(first.union(last)))

        doc = nodes.select("node", "doc", "s1", "s2", "n").join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        smallest = doc.groupBy("comp").agg(F.min("doc._id").alias("component_id"))
        classes = doc.join(smallest, "comp").select("s1", "s2", "n", "comp", "component_id")
        out = rows.select("_id", "_h", "s1", "s2", "n").join(classes, ["s1", "s2", "n"], "left")
        linked = F.col("_id").isNotNull()
        return keep(out.select("_id", "_h", F.col("n").cast("long").alias("n"), F.when(linked, F.col("comp")).alias("comp"), F.when(linked, F.coalesce("component_id", "_id")).alias("component_id")))


def _open_pairs(lists: DataFrame, member: DataFrame, known: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of the lists that could still join components: long ones, and those of groups with several members."""
    some = lists.groupBy("token").agg(F.max(F.col("crowd") | (F.col("m") > SHORT)).alias("some")).where("some").select("token")
    rest = lists.join(some, "token").select("token", "node", "n", "pos", "m")
    more = rest.join(member.withColumnRenamed("node", "other"), F.col("node") == F.col("leader")).select("token", F.col("other").alias("node"), "n", "pos", "m", F.lit(True).alias("expanded"))
    rest = rest.withColumn("expanded", F.lit(False)).unionByName(more)
    rest = rest.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    share = rest.groupBy("token", "comp").agg(F.count("*").alias("k"))
    share = share.groupBy("token").agg(F.count("*").alias("comps"), F.sum("k").alias("rows"), F.max_by("comp", F.struct("k", "comp")).alias("big")).where("comps > 1").drop("comps")
    quarters = [F.col("word")[i].alias(f"q{i}") for i in range(4)]
    small = nodes.select("node", "bits").mapInArrow(_fold, "node long, word array<bigint>").select("node", *quarters)
    # Linked sets differ in size by less than one band.
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent) + 1e-9)).cast("long")
    slices = (F.col("rows") / SLICE).cast("int") + 1
    rest = settled(rest.join(share, "token").join(small, "node").withColumn("band", band).withColumn("slices", slices))
    outside = rest.where("comp <> big").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    outside = outside.withColumn("near", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).alias("x")
    other = rest.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).alias("y")
    fresh = (F.col("x.m") > SHORT) | F.col("x.expanded") | F.col("y.expanded")
    once = (F.col("y.comp") == F.col("y.big")) | (F.col("x.node") < F.col("y.node"))
    bits = sum((F.bit_count(F.col(f"x.q{i}").bitwiseXOR(F.col(f"y.q{i}"))) for i in range(4)), F.lit(0))
    close = bits * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.near") == F.col("y.band"))
    return outside.join(other, met & (F.col("x.comp") != F.col("y.comp")) & fresh & once & _may_link("x", "y", percent) & close).select(*_ordered("x", "y"))


def _fold(batches):
    schema = pa.schema([("node", pa.int64()), ("word", pa.list_(pa.int64()))])
    for batch in batches:
        yield arrow((batch.column(0), [folded(b) for b in batch.column(1).to_pylist()]), schema)


def similarity_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_shingles`` and ``component_id`` (smallest id reachable by links) of each row."""
    return _classes(docs, size, percent, id_col, text_col).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (and text hash).

    Rows without words or with a null id stay; rows equal in id and text leave one.
    """
    with scratch(docs.sparkSession) as keep:
        rows = _classes(docs, size, percent, id_col, text_col)
        one = F.struct("_id", "_h")
        first = rows.where("comp is not null").groupBy("comp").agg(F.min(one).alias("first"))
        gone = keep(rows.join(first, "comp").where(one != F.col("first")).select("_id", "_h").distinct())
        twice = keep(rows.where("_id is not null").groupBy("_id", "_h").count().where("count > 1").select("_id", "_h").join(gone, ["_id", "_h"], "left_anti"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"))
    kept = packed.join(_small(gone), ["_id", "_h"], "left_anti")
    if not twice.isEmpty():
        repeated = kept.join(_small(twice), ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
        kept = kept.join(_small(twice), ["_id", "_h"], "left_anti").unionByName(repeated)
    return kept.select("row.*")
