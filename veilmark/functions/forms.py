"""Masking the forms of known values in one text: a small helper that runs on texts that may hold one."""

from __future__ import annotations

import re

import numpy as np

BLANKS = re.compile(r"[ \t\n\r\f\x0b]+")
#: What a cut encoding grows over.
ALPHABETS = {"hex": re.compile("[0-9a-fA-F]+"), "url": re.compile("[A-Za-z0-9_-]+"), "base64": re.compile("[A-Za-z0-9+/=]+")}


class Tight:
    """A text without its blanks, and where its characters stood: the offsets of blank runs, taken when first asked for and searched by bisection."""

    def __init__(self, text: str):
        self.text, self.whole, self.at = BLANKS.sub("", text), text, None

    def original(self, places: np.ndarray) -> np.ndarray:
        if not len(places):
            return places
        if self.at is None:
            runs = np.array([m.span() for m in BLANKS.finditer(self.whole)], np.int64).reshape(-1, 2)
            self.gone = np.concatenate(([0], np.cumsum(runs[:, 1] - runs[:, 0])))
            self.at = runs[:, 0] - self.gone[:-1]
        return places + self.gone[np.searchsorted(self.at, places, side="right")]


def found(text: str, form: str) -> np.ndarray:
    """Offsets of ``form``, from left to right without overlap."""
    out, at, find, step = [], text.find(form), text.find, len(form)
    while at >= 0:
        out.append(at)
        at = find(form, at + step)
    return np.array(out, np.int64)


def spans(text: str, forms: list[dict]) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, token) of the forms, by start; of those that overlap the longest stays, then the first, then by token.

    A form has ``form``, ``tight`` (it is looked for where blanks are taken out),
    ``grows`` (an alphabet: what is found is taken whole, as far as that reaches) and ``token``.
    """
    tight, runs, starts, ends, tokens = None, {}, [], [], []
    for f in forms:
        if not f["tight"]:
            a = found(text, f["form"])
            b = a + len(f["form"])
        else:
            tight = tight or Tight(text)
            a = found(tight.text, f["form"])
            b = tight.original(a + len(f["form"]) - 1) + 1
            a = tight.original(a)
        if len(a) and f["grows"]:
            if f["grows"] not in runs:
                runs[f["grows"]] = np.array([m.span() for m in ALPHABETS[f["grows"]].finditer(text)], np.int64).reshape(-1, 2).T
            first, last = runs[f["grows"]]
            a, b = first[np.searchsorted(first, a, side="right") - 1], last[np.searchsorted(first, b - 1, side="right") - 1]
        starts.append(a)
        ends.append(b)
        tokens += [f["token"]] * len(a)
    if not tokens:
        return []
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    if (a[order][1:] >= b[order][:-1]).all():
        return [(s, e, tokens[i]) for s, e, i in zip(a[order].tolist(), b[order].tolist(), order.tolist(), strict=True)]
    kept, covered = [], bytearray(len(text))
    for _, s, token, e in sorted(zip((a - b).tolist(), a.tolist(), tokens, b.tolist(), strict=True)):
        if covered.find(1, s, e) < 0:
            covered[s:e] = b"\1" * (e - s)
            kept.append((s, e, token))
    return sorted(kept)


def masked(text: str, forms: list[dict]) -> tuple[str, int]:
    """The text with its spans replaced by their tokens, and their number."""
    parts, since = [], 0
    own = spans(text, forms)
    for s, e, token in own:
        parts += (text[since:s], token)
        since = e
    return "".join([*parts, text[since:]]), len(own)
