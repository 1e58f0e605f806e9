"""Personal data: high-recall generators, boosted trees, calibrated thresholds; DataFrame functions only.

Generators are regular expressions that propose spans, overlapping ones too.
Four of them with their checks are the base kinds, whose spans always stay; so
does what its own evidence confirms: an account number whose checksum holds, and
any other proposal right after a keyword that names its kind.  Proposals that
meet a base span are part of it and count nowhere.  The others are left to
boosted trees.  Each has features of its format, its context and its company,
small integers, so all proposals of a corpus fall into a bounded number of
feature vectors (at most the product of their ranges): one aggregation over all
rows counts labels by vector, and the trees are boosted on that table.

Labels are made by a rule: a check (checksum, digits or ranges: cards, addresses,
phones and account numbers, those that fail included), or a keyword that names
the kind just before the span.  What makes the label of a kind is no feature of
that kind, so the trees learn how proposals look that such evidence confirms,
from the checked kinds in every corpus, and select others that look the same.  Three texts in four (by a hash of the text, so
copies stay together) fit the trees; the fourth calibrates a threshold for each
kind: the lowest score from which the share of confirmed proposals stays at
``PRECISION``.  A kind with fewer than ``CALIBRATION`` proposals there takes the
threshold of all kinds that have no check; with no such score, the trees select nothing.
Scoring is a projection without a shuffle.

Null text counts as empty: no spans.  Repeated rows each get a row; only the
named columns are read.  An empty table gives a model that selects no more than
base spans and confirmed account numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "email_spelled", "number", "iban", "hardware")
BASE = KINDS[:4]
#: Base kinds whose check can fail: they teach the trees, with the check withheld.
CHECKED = ("ip", "card", "phone")
#: Each run is taken whole from its start, as leftmost greedy matching does; possessive, so that no input backtracks.
_LOCAL = "A-Za-z0-9._%+-"
GENERATORS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_spelled": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hardware": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
}
#: A cheap test that texts without the kind fail: they are not searched for it.
_NUMBERS = lambda text: F.col("digits")
GATES = {
    "email": lambda text: text.contains("@"),
    "ip": _NUMBERS,
    "card": _NUMBERS,
    "phone": lambda text: text.contains("+"),
    "email_spelled": lambda text: text.rlike(r"[\[(][Aa][Tt][\])]"),
    "number": _NUMBERS,
    "iban": _NUMBERS,
    "hardware": lambda text: text.contains(":") | text.contains("-"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
OCTETS = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"
KEYWORDS = (r"phone|mobile|\btel\b|\bcall\b|\bfax\b", r"e-?mail|contact|\bwrite to\b", r"\bcard\b|credit|visa|payment", r"\bssn\b|social security|passport|national id|\bdob\b", r"\biban\b|account|\bbank\b", r"\bip\b|address|\bmac\b|host")
#: Keywords, by their place above from 1, that name a kind.
WANTED = {"email_spelled": (2,), "number": (1, 4), "iban": (5,), "hardware": (6,)}
#: Features and how many values each has.
FEATURES = {"f_kind": 8, "f_digits": 12, "f_letters": 3, "f_space": 3, "f_dash": 3, "f_dot": 4, "f_left": 5, "f_right": 5, "f_word": 7, "f_before": 5, "f_crowd": 3}
CONTEXT = 24
PRECISION, CALIBRATION = 0.95, 30
ROUNDS, RATE = 30, 0.3


def _prefix(lengths: Column) -> Column:
    """Running sums before each element."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(lengths, start, lambda a, n: F.struct(F.array_append(a["out"], a["at"]).alias("out"), (a["at"] + n).alias("at")), lambda a: a["out"])


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def step(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _iban_ok(value: Column) -> Column:
    """ISO 7064 mod 97 by characters."""
    tight = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(tight, F.lit(5), F.length(tight)), F.substring(tight, 1, 4))

    def step(rest, c):
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(n < 10, (rest * 10 + n) % 97).otherwise((rest * 100 + n) % 97)

    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _count(value: Column, pattern: str, most: int) -> Column:
    return F.least(F.length(value) - F.length(F.regexp_replace(value, pattern, "")), F.lit(most))


def _side(c: Column) -> Column:
    """0 edge, 1 blank, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"\A\s\z"), 1).when(c.rlike(r"\A\p{L}\z"), 2).when(c.rlike(r"\A[0-9]\z"), 3).otherwise(4)


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(OCTETS),
        "card": lambda: F.when(digits.between(12, 19), _luhn(value)).otherwise(False),
        "phone": lambda: digits.between(9, 15),
        "iban": lambda: F.when(F.length(value).between(15, 42), _iban_ok(value)).otherwise(False),
    }.get(kind, lambda: F.lit(False))()


def proposals(rows: DataFrame, taught: bool = False) -> DataFrame:
    """``row, text`` and for each row ``base``, the spans of the base kinds, and ``more``, the other proposals with features and label; with those of the ``CHECKED`` kinds where ``taught``.

    Spans have start and end in code points, end exclusive.
    """
    text = F.col("text")
    rows = rows.select("row", F.coalesce(text.cast("string"), F.lit("")).alias("text")).withColumn("digits", text.rlike("[0-9]"))
    none = F.array().cast("array<string>")
    found = {kind: F.when(GATES[kind](text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{kind}") for kind, pattern in GENERATORS.items()}
    rows = rows.select("row", "text", *found.values())
    steps = []
    for kind, pattern in GENERATORS.items():
        m = F.col(f"m_{kind}")
        gaps = F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none)
        steps.append(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("n"), v.alias("value"))).alias(f"s_{kind}"))
    rows = rows.select("row", "text", *steps)

    def placed(i: int, kind: str) -> Column:
        s = F.col(f"s_{kind}")
        before = _prefix(F.transform(s, lambda x: x["gap"] + x["n"]))

        def one(x, b):
            at = b + x["gap"]
            return F.struct(at.alias("start"), F.lit(i).alias("kind"), (at + x["n"]).alias("end"), x["value"].alias("value"), _valid(kind, x["value"]).alias("valid"))

        return F.zip_with(s, before, one)

    base = F.concat(*(F.filter(placed(i, k), lambda x: x["valid"]) for i, k in enumerate(BASE)))
    wanted = [i for i, k in enumerate(KINDS) if k not in BASE or (taught and k in CHECKED)]
    spans = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = rows.select("row", "text", spans.alias("base"), F.concat(*(placed(i, KINDS[i]) for i in wanted)).alias("other"))
    own = lambda x: (x["kind"] < len(BASE)) & x["valid"]
    apart = lambda x: own(x) | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.withColumn("other", F.filter("other", apart))

    def described(x: Column) -> Column:
        value = x["value"]
        context = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
        near = F.lower(context)
        word = F.lit(0)
        for k in range(len(KEYWORDS), 0, -1):
            word = F.when(near.rlike(KEYWORDS[k - 1]), k).otherwise(word)
        last = F.regexp_extract(context, r"(\S)\s*\z", 1)
        kind_is = lambda k: x["kind"] == KINDS.index(k)

        def labelled(word):
            named = F.lit(False)
            for k, places in WANTED.items():
                named = named | kind_is(k) & word.isin(*places)
            by_word = named & ~kind_is("iban")
            fields = {
                "f_kind": (x["kind"] + len(KINDS) - len(BASE)) % len(KINDS),
                "f_digits": _count(value, "[0-9]", 22) / 2,
                "f_letters": (_count(value, "[A-Za-z]", 4) + 1) / 2,
                "f_space": _count(value, r"\x20", 2),
                "f_dash": _count(value, "-", 2),
                "f_dot": _count(value, r"\.", 3),
                "f_left": _side(F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise("")),
                "f_right": _side(F.substring(text, x["end"] + 1, F.lit(1))),
                # The keyword that makes the label is no feature of its kind.
                "f_word": F.when(by_word, 0).otherwise(word),
                "f_before": F.when(last == "", 0).when(last.rlike(r"[:=#]"), 1).otherwise(_side(last)),
                "f_crowd": F.least(F.size("base"), F.lit(2)),
            }
            confirmed = F.when(kind_is("iban") | (x["kind"] < len(BASE)), x["valid"]).otherwise(by_word)
            return F.struct(*[v.cast("int").alias(k) for k, v in fields.items()], x["start"].alias("start"), x["end"].alias("end"), x["valid"].alias("valid"), confirmed.alias("confirmed"))

        return F.get(F.transform(F.array(word), labelled), F.lit(0))

    return rows.select("row", "text", "base", F.transform("other", described).alias("more"))


def fit(docs: DataFrame, text_col: str = "text") -> dict:
    """Boosted trees and thresholds, from counts of labels by feature vector over all rows of ``docs``."""
    held = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(4)) == 0
    each = proposals(docs.select(F.lit(0).alias("row"), F.col(text_col).alias("text")), taught=True).select(held.alias("held"), "more")
    # An outer explode: an inner one makes Spark test the array's size in a filter that repeats every search.
    each = each.select("held", F.explode_outer("more").alias("p")).where("p is not null").select("held", "p.*")
    yes, held = F.col("confirmed"), F.col("held")
    counts = each.groupBy(*FEATURES).agg(F.count_if(yes & ~held), F.count_if(~yes & ~held), F.count_if(yes & held), F.count_if(~yes & held))
    width = len(FEATURES)
    return boost(sorted((list(r[:width]), *r[width:]) for r in counts.collect()))


def boost(rows: list[tuple[list[int], int, int, int, int]]) -> dict:
    """Logistic boosting of two-level trees on (vector, positives, negatives, and both again to calibrate with).

    Counts enter by their logarithm, so that no vector drowns the rest.
    """
    data = [(x, p * d, n * d) for x, p, n, _, _ in rows if p + n for d in [math.log1p(p + n) / (p + n)]]
    scores = [0.0] * len(data)
    trees = []

    def best_split(some: list[int], g: list[float], h: list[float]):
        G, H = sum(g[i] for i in some), sum(h[i] for i in some)
        best = (1e-9, None, 0)
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in some:
                at = by.setdefault(data[i][0][f], [0.0, 0.0])
                at[0] += g[i]
                at[1] += h[i]
            gl = hl = 0.0
            for c in sorted(by)[:-1]:
                gl, hl = gl + by[c][0], hl + by[c][1]
                gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                if gain > best[0]:
                    best = (gain, f, c)
        return best[1:], -RATE * G / (H + 1)

    for _ in range(ROUNDS if data else 0):
        prob = [1 / (1 + math.exp(-s)) for s in scores]
        g = [q * (p + n) - p for q, (_, p, n) in zip(prob, data, strict=True)]
        h = [q * (1 - q) * (p + n) for q, (_, p, n) in zip(prob, data, strict=True)]

        def grow(some, depth, g=g, h=h):
            (f, c), leaf = best_split(some, g, h)
            if depth == 0 or f is None:
                return leaf
            return (f, c, grow([i for i in some if data[i][0][f] <= c], depth - 1), grow([i for i in some if data[i][0][f] > c], depth - 1))

        tree = grow(list(range(len(data))), 2)
        trees.append(tree)
        scores = [s + value(tree, x) for s, (x, _, _) in zip(scores, data, strict=True)]

    held = [(sum(value(t, x) for t in trees), x[0], p, n) for x, _, _, p, n in rows if p + n]
    thresholds = {}
    free = len(KINDS) - len(BASE)
    held = [h for h in held if h[1] < free]
    for k, kind in enumerate(KINDS[len(BASE) :]):
        own = [h for h in held if h[1] == k]
        least = calibrated(own if sum(p + n for _, _, p, n in own) >= CALIBRATION else held)
        if least is not None:
            thresholds[kind] = least
    return {"trees": trees, "thresholds": thresholds}


def calibrated(held: list[tuple[float, int, int, int]]) -> float | None:
    """The lowest of the scores from which on ``PRECISION`` of the (score, kind, positives, negatives) are positives."""
    least, pos, neg = None, 0, 0
    held = sorted(held, reverse=True)
    for i, (s, _, p, n) in enumerate(held):
        pos, neg = pos + p, neg + n
        if (i + 1 == len(held) or held[i + 1][0] < s) and pos >= PRECISION * (pos + neg):
            least = s
    return least


def value(tree, x: list[int]) -> float:
    while isinstance(tree, tuple):
        f, c, low, high = tree
        tree = low if x[f] <= c else high
    return tree


def _score(x: Column, trees: list) -> Column:
    names = list(FEATURES)

    def expr(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, c, low, high = tree
        return F.when(x[names[f]] <= c, expr(low)).otherwise(expr(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + expr(tree)
    return total


def chosen(rows: DataFrame, model: dict) -> DataFrame:
    """``row, text, spans`` (start, kind, end, base), by start and kind: the base spans, confirmed proposals, and what the trees select."""

    def selected(x):
        enough = x["valid"] | x["confirmed"]
        for kind, least in model["thresholds"].items():
            enough = enough | ((x["f_kind"] == KINDS.index(kind) - len(BASE)) & (_score(x, model["trees"]) >= least - 1e-9))
        return enough

    def span(x, kind, base):
        return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), F.lit(base).alias("base"))

    more = F.transform(F.filter("more", selected), lambda x: span(x, x["f_kind"] + len(BASE), False))
    spans = F.array_sort(F.concat(F.transform("base", lambda x: span(x, x["kind"], True)), more))
    return proposals(rows).select("row", "text", spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans, for each row."""
    found = chosen(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), model)
    base = F.filter("spans", lambda x: x["base"])

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == i))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    digest = F.sha2(_joined(base), 256).alias("base_sha256")
    return found.select(F.col("row").alias(id_col), *counts, digest, _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with each selected span (overlapping ones as one) replaced by ``[KIND]``; rows without a span are unchanged."""

    def fold(a, x):
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))))
        alone = F.array_append(a, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.when(F.size(a) == 0, alone).when(x["start"] < last["end"], joined).otherwise(alone)

    found = chosen(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), model)
    found = found.select("row", "text", F.aggregate("spans", F.array().cast("array<struct<start:int,end:int,kind:int>>"), fold).alias("spans"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(x, i):
        since = F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])
        return F.concat(F.substring("text", since + 1, x["start"] - since), F.get(names, x["kind"]))

    tail = F.substring("text", F.element_at("spans", -1)["end"] + 1, F.length("text"))
    new = F.concat(F.array_join(F.transform("spans", piece), ""), tail)
    row = F.when(F.size("spans") > 0, F.col("row").withField(f"`{text_col}`", new)).otherwise(F.col("row"))
    return found.select(row.alias("row")).select("row.*")
