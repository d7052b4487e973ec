"""Raw yearly releases to clean training and held-out panels."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame

from panelcast.functions.codes import KEYS, LAYOUT_CHANGE_YEAR, TIME, VINTAGE_RENAMES
from panelcast.operators import packed
from panelcast.operators.clean import clean_sentinel, fill_missing, zero_metrics
from panelcast.operators.derive import pct_to_count
from panelcast.operators.packed import Packed
from panelcast.operators.relate import decode, split_by_list
from panelcast.operators.shape import align_vintage, stack_releases
from panelcast.operators.sizing import cut_lineage
from panelcast.sources.releases import stack_all


def clean_releases(df: DataFrame, old_layout: bool, legacy_order: bool = False) -> DataFrame:
    """Releases of one layout with sentinels removed, percentages as counts and current column groups.

    ``legacy_order`` leaves sentinels in until the counts are made, as older runs did;
    a sentinel percentage of a tiny total then survives as a large negative count.
    """
    out = df if legacy_order else clean_sentinel(fill_missing(df))
    return align_vintage(pct_to_count(out, before=None), VINTAGE_RENAMES) if old_layout else out


def collect_panels(releases: Mapping[int, DataFrame], holdout: DataFrame | None = None,
                   names: DataFrame | None = None, layout_change: int = LAYOUT_CHANGE_YEAR,
                   legacy_order: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(training panel, held-out panel) from releases by year.

    ``holdout`` lists the held-out ``(state, place)``; ``names`` is a ``(FIPS, Name)``
    lookup that turns held-out place codes into names.  Measures that are always
    zero are decided on the training panel and dropped from both.
    """
    layouts = {old: {y: df for y, df in releases.items() if (y < layout_change) == old} for old in (True, False)}
    cleaned = [clean_releases(stack_all(part), old, legacy_order) for old, part in layouts.items() if part]
    stacked = fill_missing(stack_releases(cleaned))
    if legacy_order:
        stacked = clean_sentinel(stacked)
    stacked = cut_lineage(stacked)  # releases are parsed once, not for the measures and for each panel again
    if holdout is None:
        return stacked.drop(*zero_metrics(stacked)), None
    held, training = split_by_list(stacked, holdout)
    if names is not None:
        held = decode(held, names, "FIPS", "Name", "place")
    empty = zero_metrics(training)
    return training.drop(*empty), held.drop(*empty)


def collect_packed(releases: Mapping[int, DataFrame], layout_change: int = LAYOUT_CHANGE_YEAR) -> Packed:
    """Clean panel of all releases with its measures packed, at any width: one job reads every release once.

    Observations of the releases (``panelcast.sources.quality``) are filled by that job.
    """
    cleaned = []
    for year, df in sorted(releases.items()):
        p = packed.clean_sentinel(packed.fill_missing(packed.pack(df)))
        cleaned.append(packed.align_vintage(packed.pct_to_count(p), VINTAGE_RENAMES) if year < layout_change else p)
    stacked = packed.fill_missing(packed.stack(cleaned))
    return replace(stacked, df=cut_lineage(stacked.df))


def sorted_panel(df: DataFrame) -> DataFrame:
    """Total order by time and entity, for sinks only (O1)."""
    return df.orderBy(TIME, *KEYS)
