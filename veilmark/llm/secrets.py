"""Secret scan: base formats, then sliding-window Shannon entropy per character class.

Candidate strings are maximal runs of key characters.  A window of ``WINDOW``
characters slides over each; the sum of c*log2(c) over the counts is updated
with the two counts that change, so a step costs the same for every window
width.  Windows at or above the threshold of the candidate's character class
are merged into spans; the allow list suppresses what is known to be harmless.

Shorter candidates than a window are not scored: ``window`` and ``thresholds`` are
parameters, and thresholds hold for the window they were chosen for.

Null text counts as empty: no spans.  Repeated rows each get a row of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

from pyspark.sql import DataFrame

from .shared import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: Runs are maximal, so a run under 16 characters can be passed over from its start.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
#: Bits a character of a window of 20: random hex has about 3.2, random letters and digits 3.9.
#: Of letters alone it has 3.9 in two cases; words run together stay below 3.8 but for a few.
#: Digits alone (of which long runs are base spans) have 3.3 at most, where each stands twice.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.6, "letters": 3.8, "digits": 3.25}
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64", "entropy_letters", "entropy_digits")
#: Whole candidates that are known not to be secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"\d{4}-\d\d-\d\dT[0-9T-]*"),  # time stamp
    re.compile(r".*example.*", re.I | re.S),
)
#: An address, in which neither the name nor the host counts; after ``name:`` or ``//`` it is a credential of a URL.
ADDRESS = re.compile(r"(?:(?<=mailto:)|(?<![A-Za-z0-9._%+:/-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
HOST_END = re.compile(r"\.[A-Za-z]{2,}\Z")
#: A path or name: its parts are words (by their vowels), numbers of up to four digits, or words with such a number.
PART = re.compile(r"(?:[A-Z]?[a-z]*+|[A-Z]++)\d{0,4}")
SEPARATOR = re.compile(r"[/_-]")
LETTERS = re.compile(r"[a-z]+")
#: What words do not have: five letters and more without a vowel between.
UNSPOKEN = re.compile(r"[^aeiouy]{5}")
#: From this many letters on a word shows vowels, one in ``VOWELS`` at least.
SPOKEN, VOWELS = 6, 6


def is_word(part: str) -> bool:
    """Whether the letters of a part may be a word: short, or with vowels as words have them."""
    letters = "".join(LETTERS.findall(part.lower()))
    return len(letters) < SPOKEN or not UNSPOKEN.search(letters) and VOWELS * sum(map(letters.count, "aeiouy")) >= len(letters)


def allowed(word: str) -> bool:
    parts = SEPARATOR.split(word.rstrip("="))
    return any(a.fullmatch(word) for a in ALLOWED) or len(parts) > 1 and all(PART.fullmatch(p) and is_word(p) for p in parts)


@cache
def _candidates(window: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{window},}}+={{0,2}}")


@cache
def _xlogx(window: int) -> list[float]:
    return [0.0, 0.0] + [c * math.log2(c) for c in range(2, window + 1)]


def char_class(candidate: str) -> str:
    """The class whose threshold holds."""
    body = candidate.rstrip("=")
    has_digit = any("0" <= c <= "9" for c in body)
    has_alpha = any(c.isalpha() for c in body)
    if not has_alpha:
        return "digits"
    if not has_digit:
        return "letters"
    if not body.strip("0123456789abcdef") or not body.strip("0123456789ABCDEF"):
        return "hex"
    if body.isalnum():
        return "alnum" if body != body.lower() else "hex" if not body.strip("0123456789abcdef") else "alnum"
    return "base64"


def hot_windows(candidate: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose entropy reaches ``threshold``."""
    xlogx = _xlogx(window)
    counts: dict[str, int] = {}
    total, spans, whole = 0.0, [], math.log2(window)
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlogx[n + 1] - xlogx[n]
        if i + 1 >= window:
            start = i + 1 - window
            if whole - total / window >= threshold - 1e-9:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
            old = candidate[start]
            m = counts[old]
            counts[old] = m - 1
            total += xlogx[m - 1] - xlogx[m]
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS) or not low.isascii():
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy_spans(text: str, taken: list[tuple[int, int, str]], window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int, str]]:
    """Spans of the entropy method in what base spans leave of each candidate."""
    out = []
    addresses = [m.span() for m in ADDRESS.finditer(text) if HOST_END.search(m.group())] if "@" in text else []
    known, i, j = sorted((s, e) for s, e, _ in taken), 0, 0
    for m in _candidates(window).finditer(text):
        at, end = m.span()
        while i < len(addresses) and addresses[i][1] <= at:
            i += 1
        if allowed(m.group()) or i < len(addresses) and addresses[i][0] <= at and end <= addresses[i][1]:
            continue
        while j < len(known) and known[j][1] <= at:
            j += 1
        k = j
        while at < end:
            until = max(at, known[k][0]) if k < len(known) and known[k][0] < end else end
            word = text[at:until]
            if len(word) >= window and not allowed(word):
                kind = char_class(word)
                out += [(at + s, at + e, f"entropy_{kind}") for s, e in hot_windows(word, thresholds[kind], window)]
            at = max(at, known[k][1]) if until < end else end
            k += 1
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> tuple:
    base = base_spans(text)
    more = entropy_spans(text, base, window, thresholds)
    kinds = [k for _, _, k in base]
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, joined(base + more), len(more)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """One row for each row of ``docs``: counts, digest of the base spans, all spans (code points, end exclusive)."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return map_texts(docs, lambda t: scan(t, window, thresholds), schema, id_col, text_col)
