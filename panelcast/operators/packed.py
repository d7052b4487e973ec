"""Panels whose measures stand in one array column (P1-P13, K14 at full width).

The names are a dictionary from measure to position, held once beside the table.  Renaming is a change of that
dictionary alone, and every other step is one array expression with a table of positions in it, so a plan over
hundreds of measures is as short as one over two: nothing grows past the code generator's field limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.codes import BIRTHS, KEYS, MIGRATION, POPULATION, RESIDUAL, SENTINEL, TIME, measures, parse
from panelcast.functions.numeric import percent_of_sql
from panelcast.operators.features import row_sql


@dataclass(frozen=True)
class Packed:
    """Ids and the array ``vector`` of the measures called ``names``, in their order."""

    df: DataFrame
    names: tuple[str, ...]
    vector: str = "v"

    @property
    def ids(self) -> list[str]:
        return [c for c in self.df.columns if c != self.vector]

    def at(self, name: str) -> int:
        """Position of a measure; a name that isn't there is an error."""
        return self.names.index(name)

    def with_vector(self, expr: str, names: Sequence[str] | None = None) -> Packed:
        """The same rows with the array replaced."""
        df = self.df.selectExpr(*[f"`{c}`" for c in self.ids], f"{expr} AS `{self.vector}`")
        return replace(self, df=df, names=self.names if names is None else tuple(names))

    def computed(self, expr: str, names: Sequence[str] | None = None) -> Packed:
        """The array replaced by an expression of ``w``, the whole old array.

        ``w`` is bound once.  Named inside a lambda, the column would be replaced by its own expression when Spark merges
        projections, and that be evaluated again for every element.
        """
        return self.with_vector(f"transform(array(`{self.vector}`), w -> {expr})[0]", names)

    def cell(self, name: str) -> str:
        """Expression of one measure."""
        return f"`{self.vector}`[{self.at(name)}]"


def _ints(values: Sequence[int]) -> str:
    return "array(" + ", ".join(map(str, values)) + ")" if values else "CAST(array() AS ARRAY<INT>)"


def pack(df: DataFrame, ids: Sequence[str] = (TIME, *KEYS), vector: str = "v") -> Packed:
    """A wide panel with its measures in one array of doubles."""
    names = measures(df, ids)
    cells = row_sql(names) if names else "CAST(array() AS ARRAY<DOUBLE>)"
    return Packed(df.selectExpr(*[f"`{c}`" for c in ids], f"{cells} AS `{vector}`"), tuple(names), vector)


def unpack(p: Packed) -> DataFrame:
    """Back to one column per measure."""
    return p.df.selectExpr(*[f"`{c}`" for c in p.ids], *[f"{p.cell(n)} AS `{n}`" for n in p.names])


def to_long(p: Packed, name: str = "metric", value: str = "value") -> DataFrame:
    """One row per measure, as a generator: the input's partitioning stays."""
    dictionary = "array(" + ", ".join(f"'{n}'" for n in p.names) + ")"
    cells = p.df.selectExpr(*[f"`{c}`" for c in p.ids], f"posexplode(`{p.vector}`) AS (_at, `{value}`)")
    return cells.selectExpr(*[f"`{c}`" for c in p.ids], f"{dictionary}[_at] AS `{name}`", f"`{value}`")


def take(p: Packed, names: Sequence[str]) -> Packed:
    """The chosen measures in the given order; one the panel lacks is null."""
    where = {n: i for i, n in enumerate(p.names)}
    chosen = _ints([where.get(n, -1) for n in names])
    return p.computed(f"transform({chosen}, i -> if(i < 0, CAST(NULL AS DOUBLE), w[i]))", names)


def drop(p: Packed, *patterns: str) -> Packed:
    """Without the measures that match a pattern."""
    return take(p, [n for n in p.names if not any(re.search(x, n) for x in patterns)])


def canonical(p: Packed) -> Packed:
    """Sorted codes, then the residual (P5)."""
    coded = sorted(n for n in p.names if parse(n))
    return take(p, [*coded, *[n for n in p.names if n == RESIDUAL]])


def align_vintage(p: Packed, renames: Mapping[str, Mapping[str, str]]) -> Packed:
    """Column groups renamed in the dictionary only; the table isn't touched."""
    def new_name(name: str) -> str:
        parts = parse(name)
        return name if parts is None else f"{parts[0]}_{renames.get(parts[0], {}).get(parts[1], parts[1])}_{parts[2]}"

    return replace(p, names=tuple(new_name(n) for n in p.names))


def stack(panels: Sequence[Packed]) -> Packed:
    """Panels under one dictionary, names in order of first sight."""
    names = list(dict.fromkeys(n for p in panels for n in p.names))
    aligned = [p if list(p.names) == names else take(p, names) for p in panels]
    return replace(aligned[0], df=reduce(lambda a, b: a.unionByName(b), [p.df for p in aligned]))


def fill_missing(p: Packed, value: float = 0.0) -> Packed:
    """Null and NaN cells become ``value``; infinities stay."""
    return p.with_vector(f"transform(`{p.vector}`, x -> if(x IS NULL OR isnan(x), {value!r}D, x))")


def clean_sentinel(p: Packed, threshold: float = SENTINEL) -> Packed:
    """Cells at or below the threshold become 0."""
    return p.with_vector(f"transform(`{p.vector}`, x -> if(x <= {threshold!r}D, 0D, x))")


def _percent(p: Packed, base_of: Callable[[str, str, str], str | None], wrap: str, when: str | None = None) -> Packed:
    bases = []
    for n in p.names:
        parts = parse(n)
        base = base_of(*parts) if parts else None
        bases.append(-1 if base is None else p.at(base))
    if max(bases, default=-1) < 0:
        return p
    count = wrap.format(percent_of_sql(f"w[{_ints(bases)}[i]]", "x"))
    changed = f"transform(w, (x, i) -> if({_ints(bases)}[i] < 0, x, {count}))"
    return p.computed(changed if when is None else f"if({when}, {changed}, w)")


def pct_to_count(p: Packed, tbl: str = "S0101", base_row: str = "001E", cols: Sequence[str] = ("C01", "C02", "C03"),
                 before: int | None = None, t: str = TIME, digits: int = 0) -> Packed:
    """Percentages of a column group's own total become counts, rounded half to even."""
    def base(table: str, col: str, row: str) -> str | None:
        return f"{tbl}_{col}_{base_row}" if table == tbl and col in cols and row != base_row else None

    return _percent(p, base, f"bround({{}}, {digits})", None if before is None else f"`{t}` < {before}")


def scale_by_sibling(p: Packed, tbl: str, base_col: str, cols: Sequence[str], exclude_rows: Sequence[str] = ()) -> Packed:
    """Percentages become counts of the same row in a sibling column group."""
    def base(table: str, col: str, row: str) -> str | None:
        return f"{tbl}_{base_col}_{row}" if table == tbl and col in cols and row not in exclude_rows else None

    return _percent(p, base, "{}")


def sum_family(p: Packed, families: Mapping[str, Sequence[str]]) -> Packed:
    """New measures behind the others, each the sum of a family; a missing part makes it null (P10)."""
    if not families:
        return p
    parts = "array(" + ", ".join(_ints([p.at(n) for n in names]) for names in families.values()) + ")"
    sums = f"transform({parts}, f -> aggregate(f, 0D, (a, i) -> a + w[i]))"
    return p.computed(f"concat(w, {sums})", [*p.names, *families])


def sum_columns(p: Packed, tbl: str, cols: Sequence[str], into: str, exclude_rows: Sequence[str] = ()) -> Packed:
    """Sum sibling column groups row by row (P10)."""
    rows = [parse(n)[2] for n in p.names if parse(n) and parse(n)[:2] == (tbl, cols[0]) and parse(n)[2] not in exclude_rows]
    return sum_family(p, {f"{tbl}_{into}_{r}": [f"{tbl}_{c}_{r}" for c in cols] for r in rows})


def residual_change(p: Packed, total: str = POPULATION, parts: Sequence[str] = (MIGRATION, BIRTHS),
                    keys: Sequence[str] = KEYS, t: str = TIME, name: str = RESIDUAL) -> Packed:
    """Change of the total since the entity's previous row, less its known components, as a last measure."""
    change = F.expr(p.cell(total)) - F.lag(F.expr(p.cell(total))).over(Window.partitionBy(*keys).orderBy(t))
    for part in parts:
        change = change - F.expr(p.cell(part))
    df = p.df.withColumn("_change", change)
    wider = replace(p, df=df).with_vector(f"concat(`{p.vector}`, array(_change))", [*p.names, name])
    return replace(wider, df=wider.df.drop("_change"))


def metric_means(p: Packed) -> DataFrame:
    """``(metric, mean)`` of every measure: map-side sums, then one row per measure (A2)."""
    return to_long(p).groupBy("metric").agg(F.avg("value").alias("mean"))


def drop_zero_metrics(p: Packed) -> Packed:
    """Without the measures whose mean is 0; the driver reads one row per measure."""
    zero = {r["metric"] for r in metric_means(p).where("mean = 0").select("metric").collect()}
    return take(p, [n for n in p.names if n not in zero])
