"""Pattern lookup over statements: a pattern is planned on the driver into filters and equi-joins on nested statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.operators.store import roots_of
from axiomill.sources.kif import Node, parse

_KINDS = {"symbol": ("symbol",), "op": ("op", "symbol"), "string": ("literal",), "number": ("literal",)}


def lookup(st: DataFrame, pattern: str, contains: list[str] | None = None) -> DataFrame:
    """Statements that match a pattern: ``sid`` and one column per variable (its name without ``?`` or ``@``).

    ``?x`` stands for any one element, the same one wherever it is repeated, across nesting too; ``?`` and names starting
    with ``?_`` bind nothing. ``@row`` stands for any number of elements, the fewest that let the rest match, and gives
    their number. A list matches a nested statement, by one join per list in the pattern. Without ``@`` the lengths must
    be equal. A pattern that can't be read, or names what isn't there, finds nothing. A plain head, and ``contains``, of
    whose symbols a statement must have one among its own elements, are asked of the scan first.
    """
    roots, wrong = parse(pattern)
    if wrong or len(roots) != 1 or roots[0].kind != "list":
        return st.select("sid").where(F.lit(False))
    rows = st
    if roots[0].items and roots[0].items[0].kind in ("symbol", "op"):
        rows = rows.where(F.col("head") == roots[0].items[0].val)
    if contains is not None:
        rows = rows.where(F.exists("elements", lambda e: (e["kind"] == "symbol") & e["val"].isin(*contains)))
    out, names = _match(rows.select("sid", "elements"), st, roots[0], {}, [0])
    return out.select("sid", *[F.col(c).alias(v.lstrip("?@")) for v, c in names.items()])


def lookup_nested(st: DataFrame, pattern: str) -> DataFrame:
    """Matches at any depth: ``root, sid`` and the variables, where ``root`` is the statement by itself around the match."""
    found = lookup(st, pattern)
    return roots_of(st, found.select("sid")).join(found, "sid").select("root", "sid", *[c for c in found.columns if c != "sid"])


def _match(rows: DataFrame, st: DataFrame, pattern: Node, names: dict[str, str], count: list[int]) -> tuple[DataFrame, dict[str, str]]:
    """Rows (with ``elements`` of the statement at hand) that match, bindings as columns."""
    items = list(pattern.items)
    globs = [i for i, x in enumerate(items) if x.kind == "row"]
    n = F.size("elements")
    nested: list[tuple[Node, Column]] = []
    if not globs:
        rows = rows.where(n == len(items))
        places = [(x, F.lit(i)) for i, x in enumerate(items)]
    else:
        rows = rows.where(n >= len(items) - len(globs))
        places = [(x, F.lit(i)) for i, x in enumerate(items[: globs[0]])]
        tail = items[globs[-1] + 1 :]
        # what stands between two globs starts at the first place that fits, found from left to right
        start: Column = F.lit(globs[0])
        for g, nxt in zip(globs, [*globs[1:], None]):
            part = tail if nxt is None else items[g + 1 : nxt]
            if nxt is None:
                at: Column = n - len(part)
            else:
                fits = F.array_min(F.filter(F.sequence(start, n - len(part) - len(tail)), _fitter(part)))
                at = F.when(start <= n - len(part) - len(tail), fits)
            col = f"_at{count[0]}"
            count[0] += 1
            rows = rows.withColumn(col, at).where(F.col(col).isNotNull() & (F.col(col) >= start))
            names[items[g].val] = f"_n{count[0]}"
            rows = rows.withColumn(names[items[g].val], F.col(col) - start)
            places += [(x, F.col(col) + i) for i, x in enumerate(part)]
            start = F.col(col) + len(part)
    for x, at in places:
        e = F.try_element_at("elements", at + 1)
        if x.kind == "variable":
            if x.val == "?" or x.val.startswith("?_"):
                continue
            if x.val in names:
                rows = rows.where(F.concat_ws(":", e["kind"], e["val"]) == F.concat_ws(":", F.col(names[x.val] + "k"), F.col(names[x.val])))
            else:
                c = f"_v{count[0]}"
                count[0] += 1
                names[x.val] = c
                rows = rows.withColumn(c, e["val"]).withColumn(c + "k", e["kind"])
        elif x.kind == "list":
            nested.append((x, e))
        else:
            rows = rows.where(e["kind"].isin(*_KINDS[x.kind]) & (e["val"] == x.val))
    for x, e in nested:
        c = f"_s{count[0]}"
        count[0] += 1
        rows = rows.withColumn(c, F.when(e["kind"] == "sub", e["val"].try_cast("bigint"))).where(F.col(c).isNotNull())
        inner = st.select(F.col("sid").alias(c), F.col("elements").alias("_inner"))
        if x.head:
            inner = st.where(F.col("head") == x.head).select(F.col("sid").alias(c), F.col("elements").alias("_inner"))
        outer = f"_e{count[0]}"
        rows = rows.withColumnRenamed("elements", outer).join(inner, c).withColumnRenamed("_inner", "elements")
        rows, names = _match(rows, st, x, names, count)
        rows = rows.drop("elements").withColumnRenamed(outer, "elements")
    return rows, names


def _fitter(part: list[Node]):
    return lambda i: _fits(part, i)


def _fits(part: list[Node], i: Column) -> Column:
    """Whether a run of plain elements and wildcards stands at ``i`` (from 0)."""
    ok = F.lit(True)
    for k, x in enumerate(part):
        e = F.try_element_at(F.col("elements"), (i + 1 + k).cast("int"))
        if x.kind == "list":
            ok = ok & (e["kind"] == "sub")
        elif x.kind != "variable":
            ok = ok & e["kind"].isin(*_KINDS[x.kind]) & (e["val"] == x.val)
    return F.coalesce(ok, F.lit(False))
