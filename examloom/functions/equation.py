"""The layout grammar of equation scripts: tokens, and a tree as JSON.  A grammar of its own, independent of the LaTeX passes.

A tree is nested lists, the head naming the kind: ``["frac", top, bottom]``, ``["sup", base, up]``, ``["row", ...]``; a text
is a plain string.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------
KEYWORDS = (
    "SQRT", "LEFT", "RIGHT", "RM", "IT", "BAR", "VEC", "BOX", "CASES", "EQALIGN", "PILE", "LPILE", "RPILE", "PRIME", "LIM", "INT", "SUM", "PROD", "SIN", "COS", "TAN", "LOG", "LN", "SEC", "OVER", "ATOP",
    "PI", "THETA", "ALPHA", "BETA", "GAMMA", "DELTA", "TIMES", "CDOTS", "CDOT", "CAP", "SMALLINTER", "SIM", "LEQ", "LE", "GEQ", "NEQ", "RARROW", "LARROW", "INF", "ANGLE",
)
SYMBOLS = {
    "PI": "π", "THETA": "θ", "ALPHA": "α", "BETA": "β", "GAMMA": "γ", "DELTA": "Δ", "TIMES": "×", "CDOT": "·", "CDOTS": "⋯", "CAP": "∩", "SMALLINTER": "∩", "SIM": "∼", "LE": "≤", "LEQ": "≤", "GEQ": "≥", "NEQ": "≠",
    "RARROW": "→", "LARROW": "←", "INF": "∞", "ANGLE": "∠", "INT": "∫", "SUM": "∑", "PROD": "∏",
}
SIGNS = {"!=": "≠", "<=": "≤", ">=": "≥", "->": "→"}
FUNCTIONS = {"SIN", "COS", "TAN", "LOG", "LN", "SEC"}
PILES = {"EQALIGN": "left", "LPILE": "left", "RPILE": "right", "PILE": "center"}
THIN, WIDE, TAB = "\u2009", "\u2002", "\t"
# --------------------------------------------------------------------------------------------

_WORD = re.compile("|".join(sorted(KEYWORDS, key=len, reverse=True)), re.IGNORECASE)
_SCAN = re.compile(r"(?P<number>[0-9.]+)|(?P<word>(?:[^\W\d_]|')+)|(?P<sign>[<>!=][=<>]|->)|(?P<mark>[{}^_&#\n\r`~])|(?P<space>\s+)|(?P<other>.)", re.DOTALL)
_MARKS = {"{": "open", "}": "close", "^": "up", "_": "down", "&": "tab", "#": "line", "\n": "line", "\r": "line", "`": "thin", "~": "wide"}


def pieces(run: str) -> list[str]:
    """A run of letters cut at the longest keywords in it; what is between stays whole."""
    out, at = [], 0
    for m in _WORD.finditer(run):
        out += [run[at : m.start()], m[0]]
        at = m.end()
    return [p for p in [*out, run[at:]] if p]


def tokens(script: str) -> list[tuple[str, str]]:
    """(kind, text) pairs; kinds are word, number, sign and those of single marks."""
    out = []
    for m in _SCAN.finditer(script):
        if m.lastgroup == "word":
            out += [("word", p) for p in pieces(m[0])]
        elif m.lastgroup == "mark":
            out.append((_MARKS[m[0]], m[0]))
        elif m.lastgroup == "other":
            out.append(("sign", m[0]))
        elif m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return out


def row(items: list) -> list | str:
    """A row without empty texts and rows inside; one item stands for itself."""
    flat = []
    for x in items:
        flat += x[1:] if isinstance(x, list) and x and x[0] == "row" else [x] if x != "" else []
    return flat[0] if len(flat) == 1 else ["row", *flat]


class _Parser:
    def __init__(self, script: str):
        self.toks, self.at = tokens(script), 0

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.toks[i][0] if i < len(self.toks) else "end"

    def take(self) -> tuple[str, str]:
        got = self.toks[self.at] if self.at < len(self.toks) else ("end", "")
        self.at += 1
        return got

    def word_is(self, *words: str) -> bool:
        return self.kind() == "word" and self.toks[self.at][1].upper() in words

    def row(self, stops: tuple[str, ...] = (), until: str = ""):
        items = []
        while (k := self.kind()) not in ("close", "end", *stops) and not (until and self.word_is(until)):
            if k in ("thin", "wide", "tab", "line"):
                self.take()
                items.append({"thin": THIN, "wide": WIDE, "tab": TAB, "line": " "}[k])
            else:
                items.append(self.relation())
        return row(items)

    def relation(self):
        node = self.scripted()
        while self.word_is("OVER", "ATOP"):
            name = {"OVER": "frac", "ATOP": "atop"}[self.take()[1].upper()]
            node = [name, node, self.scripted()]
        return node

    def scripted(self):
        base = "" if self.kind() in ("up", "down") else self.atom()
        low = high = None
        spaces = []
        while True:
            ahead = 0
            while self.kind(ahead) in ("thin", "wide"):
                ahead += 1
            k = self.kind(ahead)
            if k not in ("up", "down"):
                break
            spaces += [THIN if self.kind(i) == "thin" else WIDE for i in range(ahead)]
            self.at += ahead + 1
            if k == "down":
                low = self.argument()
            else:
                high = self.argument()
        if isinstance(base, list) and base[0] in ("integral", "operator"):
            node = [*base[: 1 + (base[0] == "operator")], low, high]
        elif low is not None and high is not None:
            node = ["subsup", base, low, high]
        elif low is not None:
            node = ["sub", base, low]
        elif high is not None:
            node = ["sup", base, high]
        else:
            node = base
        return row([node, *spaces]) if spaces else node

    def argument(self):
        while self.kind() in ("thin", "wide", "line", "tab"):
            self.take()
        return self.atom()

    def atom(self):
        k = self.kind()
        if k in ("close", "end", "tab", "line"):
            return ""
        _, text = self.take()
        if k == "open":
            node = self.row()
            if self.kind() == "close":
                self.take()
            return node
        if k == "word":
            return self.word(text)
        return {"thin": THIN, "wide": WIDE}.get(k) or SIGNS.get(text, text)

    def delimiter(self) -> str:
        k, text = self.take()
        if k in ("open", "close", "sign", "word", "number"):
            text = SIGNS.get(text, text)
            return "" if text == "." else text
        return ""

    def pile(self, align: str):
        if self.kind() != "open":
            return self.argument()
        self.take()
        rows = []
        while self.kind() not in ("close", "end"):
            cols = [self.row(("line", "tab"))]
            while self.kind() == "tab":
                self.take()
                cols.append(self.row(("line", "tab")))
            rows.append(cols)
            while self.kind() == "line":
                self.take()
        if self.kind() == "close":
            self.take()
        return ["pile", align, rows]

    def word(self, text: str):
        w = text.upper()
        if w == "SQRT":
            return ["sqrt", self.argument()]
        if w == "LEFT":
            left = self.delimiter()
            body = self.row(until="RIGHT")
            if self.word_is("RIGHT"):
                self.take()
            return ["paren", left, self.delimiter(), body]
        if w == "RIGHT":
            self.delimiter()
            return ""
        if w in ("RM", "IT"):
            braced = w == "RM" and self.kind() == "open"
            return ["roman" if w == "RM" else "italic", self.atom() if braced else self.scripted()]
        if w in ("BAR", "VEC", "BOX"):
            return [w.lower(), self.argument()]
        if w == "CASES":
            return ["paren", "{", "", self.pile("left")]
        if w in PILES:
            return self.pile(PILES[w])
        if w == "PRIME":
            return "'"
        if w == "LIM":
            low = None
            if self.kind() == "down":
                self.take()
                low = self.argument()
            return ["limit", text, low]
        if w == "INT":
            return ["integral", None, None]
        if w in ("SUM", "PROD"):
            return ["operator", SYMBOLS[w], None, None]
        if w in FUNCTIONS:
            return ["roman", text.lower()]
        return SYMBOLS.get(w, text)


def parse(script: str) -> list | str:
    """The tree of a script."""
    p = _Parser(script)
    out = [p.row()]
    return row(out)


def to_json(script: str | None) -> str | None:
    return None if script is None else json.dumps(parse(script), ensure_ascii=False, separators=(",", ":"))


def tree(script: Column) -> Column:
    """The tree of each script as JSON text, in Arrow batches."""

    def run(scripts: pd.Series) -> pd.Series:
        return scripts.map(to_json, na_action="ignore")

    return F.pandas_udf(run, "string")(script)


def token_texts(script: Column) -> Column:
    def run(scripts: pd.Series) -> pd.Series:
        return scripts.map(lambda s: [t for _, t in tokens(s)], na_action="ignore")

    return F.pandas_udf(run, "array<string>")(script)
