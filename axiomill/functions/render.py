"""Formulas in words, by templates of their relations.

In a template ``%1`` stands for an argument, ``%*{2-4}[ and ]`` for several with a separator, ``%n{not }`` for a text
that only shows under a negation (``%n`` alone shows "not "), ``%p{...}`` for one that only shows without it, and
``&%Name`` links a term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from axiomill.sources.kif import Node, parse

#: Words of the operators in English.
WORDS = {"and": " and ", "or": " or ", "=>": ("if ", ", then "), "<=>": " if and only if ", "not": "it is not the case that ", "forall": "for all ", "exists": "there is "}
_SLOT = re.compile(r"%\*\{(\d+)-(\d+|N)\}\[([^\]]*)\]|%([np])(?:\{([^}]*)\})?|%(\d+)|&%([A-Za-z][\w-]*)")


def render(n: Node, formats: dict[str, str], terms: dict[str, str] | None = None, negated: bool = False, missing: list[str] | None = None) -> str:
    """The formula in words; relations without a template are named, and listed in ``missing``."""
    terms, missing = terms or {}, [] if missing is None else missing
    go = lambda x, neg=False: render(x, formats, terms, neg, missing)
    if n.kind != "list":
        return n.val.strip('"') if n.kind == "string" else terms.get(n.val, n.val)
    h, a = n.head, n.items[1:]
    if n.items and n.items[0].kind == "op":
        if h in ("and", "or", "<=>"):
            return WORDS[h].join(map(go, a))
        if h == "=>":
            return WORDS[h][0] + go(a[0]) + WORDS[h][1] + go(a[1])
        if h == "equal":
            return f"{go(a[0])} is {'not ' if negated else ''}equal to {go(a[1])}"
        if h == "not":
            inner = a[0]
            return go(inner, True) if inner.head in formats or inner.head == "equal" else WORDS["not"] + go(inner)
        return WORDS[h] + ", ".join(v.val for v in a[0].items) + ": " + go(a[1])
    if h not in formats:
        if h and h not in missing:
            missing.append(h)
        return f"{'not ' if negated else ''}{terms.get(h, h)}({', '.join(map(go, a))})"

    def slot(m: re.Match) -> str:
        if m[1]:
            last = len(a) if m[2] == "N" else int(m[2])
            return m[3].join(go(x) for x in a[int(m[1]) - 1 : last])
        if m[4]:
            return (m[5] if m[5] is not None else "not ") if negated == (m[4] == "n") else ""
        if m[6]:
            k = int(m[6]) - 1
            return go(a[k]) if k < len(a) else m[0]
        return terms.get(m[7], m[7])

    return _SLOT.sub(slot, formats[h])


def render_frame(kif: DataFrame, formats: dict[str, str], terms: dict[str, str] | None = None) -> DataFrame:
    """``sid, text, missing`` of statements (sid, kif). The templates of one language are a bounded table of the base."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, text in zip(b["sid"], b["kif"]):
                roots, missing = parse(text)[0], []
                rows.append((sid, render(roots[0], formats, terms, missing=missing) if roots else None, missing))
            yield pd.DataFrame(rows, columns=["sid", "text", "missing"])

    return kif.select("sid", "kif").where("kif is not null").mapInPandas(run, "sid bigint, text string, missing array<string>")
