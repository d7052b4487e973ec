"""Counts of doubtful cells, taken while a release is read.

``DataFrame.observe`` adds the counts to the job that reads the release anyway, so the report costs no second scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.codes import KEYS, SENTINEL, TIME, parse
from panelcast.sources.releases import typed_release

#: Kinds of doubtful cells and what tells them, for the text ``x`` of a cell.
KINDS = {
    "empty": "x IS NULL OR trim(x) = ''",
    "no_number": "trim(x) <> '' AND try_cast(x AS DOUBLE) IS NULL",
    "sentinel": f"try_cast(x AS DOUBLE) <= {SENTINEL!r}D",
}
REPORT = f"{TIME} int, tbl string, n_rows long, cells long, empty long, no_number long, sentinel long"


def _tables(names: list[str]) -> dict[str, list[str]]:
    """Measures by source table; those without a code under ``other``."""
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(parse(n)[0] if parse(n) else "other", []).append(n)
    return out


def read_observed_release(spark: SparkSession, path: str, year: int) -> tuple[DataFrame, Observation]:
    """A release as :func:`read_release` gives it, and the observation that its next action fills.

    The action should read the release once and whole, as a checkpoint or a written stage does: a filter doesn't change the
    counts, a limit does, and of several actions the first one fills them.
    """
    raw = spark.read.option("header", True).csv(path)
    tables = _tables([c for c in raw.columns if c not in KEYS])
    seen = Observation(f"cells of {year}")
    counts = ["count(1) AS n_rows"]
    for tbl, names in tables.items():
        cells = "array(" + ", ".join(f"`{n}`" for n in names) + ")"
        counts += [f"coalesce(sum(size(filter({cells}, x -> {test}))), 0L) AS {tbl}_{kind}" for kind, test in KINDS.items()]
    observed = raw.observe(seen, *[F.expr(c) for c in counts])
    return typed_release(observed, year), seen


def quality_report(spark: SparkSession, releases: Mapping[int, tuple[DataFrame, Observation]]) -> DataFrame:
    """A row for each (year, table) with the cells read, empty, no number or a sentinel.

    Each release must have been read by an action, else this waits for one.
    """
    rows = []
    for year, (df, seen) in sorted(releases.items()):
        got = seen.get
        for tbl, names in _tables([c for c in df.columns if c not in (TIME, *KEYS)]).items():
            rows.append((year, tbl, got["n_rows"], got["n_rows"] * len(names), *[got[f"{tbl}_{k}"] for k in KINDS]))
    return spark.createDataFrame(rows, REPORT)
