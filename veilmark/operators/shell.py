"""References inside shell commands: where they stand, whether they can expand, what a command writes.

The quoting state of a shell is no regular language, so one small scanner runs
in an Arrow-fed function; what follows from it (joins with the vault, issues,
decisions) is DataFrame work.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import fresh
from .vault import by_name

REF = re.compile(R.REF)
HEREDOC = re.compile(r"<<(-?)[ \t]*(?:'([^'\n]*)'|\"([^\"\n]*)\"|((?:\\.|[^\s<>|&;()'\"])+))")
TARGET = re.compile(r"(?:[0-9]*|&)>>?\|?(?!&)[ \t]*([^\s<>|&;()]+)|(?:^|[|;&(\n])[ \t]*tee\b((?:[ \t]+[^\s<>|&;()]+)+)", re.M)
DEVICE = re.compile(r"/dev/(?:null|zero|stdout|stderr|tty|fd/.*)\Z")


#: Places where the shell expands nothing, or nothing that could be put there safely.
INERT = ("comment", "inert", "open", "escaped")


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of quotes (sq, dq, ansq), comments and here-documents (heredoc, inert).

    A quote that nothing closes is ``open``, to the end of the text.  A bracket of a
    subshell ends a word, that of a substitution does not.
    """
    spans, waiting, brackets, i, n, depth = [], [], [], 0, len(text), 0
    word = True  # a comment may start here
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            word, i = word and text[i + 1] == "\n", i + 2
            continue
        if c == "'" or text.startswith("$'", i):
            start, ansi = i, c == "$"
            i += 1 + ansi
            while i < n and text[i] != "'":
                i += 2 if ansi and text[i] == "\\" else 1
            spans.append((start, min(n, i + 1), "open" if i >= n else "ansq" if ansi else "sq"))
            i = min(n, i + 1)
        elif c == '"':
            start, i = i, i + 1
            while i < n and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
            spans.append((start, min(n, i + 1), "open" if i >= n else "dq"))
            i = min(n, i + 1)
        elif c == "#" and word:
            start = i
            while i < n and text[i] != "\n":
                i += 1
            spans.append((start, i, "comment"))
            continue
        elif text.startswith("$((", i):
            depth, i = depth + 1, i + 3
        elif depth and text.startswith("))", i):
            depth, i = depth - 1, i + 2
        elif c == "(":
            brackets.append(i > 0 and text[i - 1] in "$<>")
            i += 1
        elif c == ")" and brackets:
            word, i = not brackets.pop(), i + 1
            continue
        elif text.startswith("<<<", i):
            i += 3
        elif not depth and text.startswith("<<", i) and (m := HEREDOC.match(text, i)):
            quoted = m[2] is not None or m[3] is not None or "\\" in (m[4] or "")
            name = m[2] if m[2] is not None else m[3] if m[3] is not None else re.sub(r"\\(.)", r"\1", m[4])
            waiting.append((name, bool(m[1]), quoted))
            i = m.end()
        elif c == "\n" and waiting:
            i += 1
            for name, dash, quoted in waiting:
                start = i
                while i < n:
                    end = text.find("\n", i)
                    end = n if end < 0 else end
                    line = text[i:end]
                    i = min(n, end + 1)
                    if (line.lstrip("\t") if dash else line) == name:
                        break
                spans.append((start, i, "inert" if quoted else "heredoc"))
            waiting, word = [], True
            continue
        else:
            i += 1
        word = c in " \t\n;&|("
    return spans


def variable(name: str) -> str:
    """The environment variable of a reference name, as ``predicates.variable_name`` has it."""
    return f"__VEIL_{re.sub('[^A-Za-z0-9]', '_', name).upper()}_{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def expand_command(text: str, known: set[str] | None = None) -> dict:
    """References by disposition, the command with variables in their place, and the variables it needs.

    Inert, though held: those in comments, quoted here-documents and open quotes,
    and those behind a backslash that would quote what takes their place.
    """
    spans, refs, out, since, env = scan(text), [], [], 0, {}
    for m in REF.finditer(text):
        kind = next((k for a, b, k in spans if a <= m.start() and m.end() <= b), "plain")
        slashes = m.start() - len(text[: m.start()].rstrip("\\"))
        if kind not in ("sq", "comment", "inert", "open") and slashes % 2:
            kind = "escaped"
        held = (known is None or m[1] in known) and m[1] != R.RESERVED
        state = "unknown" if not held else "inert" if kind in INERT else "expand"
        refs.append((m.start(), m.end(), m[1], state, kind))
        if state == "expand":
            v = variable(m[1])
            env[v] = m[1]
            after = text[m.end() : m.end() + 1]
            new = {"plain": f'"${v}"', "heredoc": f"${{{v}}}", "sq": f"'\"${v}\"'", "ansq": f"'\"${v}\"$'"}.get(kind) or (f"${{{v}}}" if after.isalnum() or after == "_" else f"${v}")
            out += (text[since : m.start()], new)
            since = m.end()
    return {"refs": refs, "command": "".join([*out, text[since:]]), "env": env}


def write_targets(text: str) -> list[str]:
    """Files that redirections and ``tee`` write, in order, each once; devices and other descriptors are none."""
    code = list(text)
    for a, b, _ in scan(text):
        code[a:b] = ["\n" if c == "\n" else "_" for c in text[a:b]]
    found: dict[str, None] = {}
    for m in TARGET.finditer("".join(code)):
        spots = [m.span(1)] if m[1] else [(m.start(2) + w.start(), m.start(2) + w.end()) for w in re.finditer(r"\S+", m[2]) if not w[0].startswith("-")]
        for a, b in spots:
            name = text[a:b].strip("'\"")
            if name and not DEVICE.match(name):
                found[name] = None
    return list(found)


REFS = "array<struct<start:int,end:int,name:string,disposition:string,context:string>>"


def lex(commands: Column) -> Column:
    """References, rewritten command and write targets of each command; null stays null."""

    @F.pandas_udf(f"struct<refs:{REFS},command:string,targets:array<string>,env:map<string,string>>")
    def scanned(commands: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if c is None else ((x := expand_command(c))["refs"], x["command"], write_targets(c), x["env"]) for c in commands]
        names = ("start", "end", "name", "disposition", "context")
        refs = [None if r is None else [dict(zip(names, y, strict=True)) for y in r] for r, *_ in rows]
        return pd.DataFrame({"refs": refs, "command": [r[1] for r in rows], "targets": [r[2] for r in rows], "env": [r[3] for r in rows]})

    return scanned(commands)


def classify(df: DataFrame, vault: DataFrame, key: str, command_col: str = "command") -> DataFrame:
    """``df`` with classified references, the rewritten command (variable names, never values), ``env`` (variable to name of each reference that
    expands), targets, issues, and whether it is blocked.

    A reference the vault lacks is ``unknown``; one in a comment or a quoted
    here-document is ``inert``.  Known inert references block; unknown inert ones are prose.
    """
    k, own, lexed = fresh([*df.columns, "refs", "targets", "rewritten", "env", "issues", "blocked", "warned"], "k", "names", "lexed")
    names = vault.groupBy(F.col(key).alias(k)).agg(F.collect_set("name").alias(own))
    both = df.withColumn(lexed, lex(F.col(command_col))).join(names, df[key] == F.col(k), "left")
    held = lambda x: F.coalesce(F.array_contains(own, x["name"]), F.lit(False))
    refs = F.transform(F.col(lexed)["refs"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name"), F.when(~held(x), "unknown").otherwise(x["disposition"]).alias("disposition"), x["context"].alias("context")))
    both = both.withColumn("refs", refs)
    inert_place = lambda x: x["context"].isin(*INERT)
    held_inert = lambda x: (x["disposition"] == "inert") & (x["name"] != R.RESERVED)
    bad = F.filter("refs", lambda x: held_inert(x) | (x["disposition"] == "unknown") & ~inert_place(x) & (x["name"] != R.RESERVED))
    why = lambda x: F.when(x["disposition"] == "inert", F.format_string("{{sec:%s}} stands where the shell does not expand it", x["name"])).otherwise(F.format_string("sec:%s is not in the vault", x["name"]))
    issues = F.transform(bad, why)
    env = F.map_filter(F.col(lexed)["env"], lambda _, n: F.exists("refs", lambda x: (x["name"] == n) & (x["disposition"] == "expand")))
    warn = (F.size("refs") > 0) & (F.size(F.col(lexed)["targets"]) > 0)
    given = {"targets": F.col(lexed)["targets"], "rewritten": F.col(lexed)["command"], "env": env, "issues": issues, "blocked": F.size(issues) > 0, "warned": warn}
    return both.withColumns(given).drop(lexed, k, own)


def environment(df: DataFrame, vault: DataFrame, key: str, out: str = "environment") -> DataFrame:
    """Classified commands with the variables that their process gets, and the values: the one place where values are delivered."""
    k, m = fresh([*df.columns, out], "k", "m")
    held = by_name(vault, key, "value").select(F.col(key).alias(k), F.col("held").alias(m))
    both = df.join(held, df[key] == F.col(k), "left")
    values = F.transform_values("env", lambda _, n: F.element_at(m, n)["value"])
    return both.withColumn(out, F.when(F.col("blocked"), F.create_map().cast("map<string,string>")).otherwise(values)).drop(k, m)
