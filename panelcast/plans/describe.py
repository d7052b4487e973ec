"""Descriptive tables of the collected panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import POPULATION, TIME, TOTAL_KEY
from panelcast.operators.aggregate import histogram_density, kde, report_max, with_totals, without_totals
from panelcast.operators.derive import add_age_groups, add_ratios, growth_rate
from panelcast.operators.shape import intersect_schema, select_metrics, to_long

RATIO_RANGE = (-8.0, 10.0)
GROWTH_RANGE = (-250.0, 250.0)


def age_panel(training: DataFrame, held: DataFrame) -> DataFrame:
    """Both panels on their common age measures, with yearly totals, age groups and ratios."""
    a, b = intersect_schema(training, held)
    ages = [select_metrics(p, include=["^S0101_C01_"]) for p in (a, b)]
    grouped = add_age_groups(with_totals(ages[0].unionByName(ages[1])), total=None)
    return add_ratios(grouped, total=POPULATION)


def stacked_series(df: DataFrame, ids: list[str]) -> DataFrame:
    """Age groups crossed with ratio types, 3 x 2 rows per input row (P25)."""
    groups = to_long(df, [*ids, "working_total_ratio", "senior_total_ratio"], ["youth", "working", "senior"],
                     "age_group", "population")
    return to_long(groups, [*ids, "age_group", "population"], ["working_total_ratio", "senior_total_ratio"],
                   "ratio_type", "ratio")


@dataclass
class Description:
    """Tables of :func:`descriptive_report`, each computed only when asked for."""

    panel: DataFrame
    first: int
    last: int
    n: int

    @property
    def entities(self) -> DataFrame:
        return without_totals(self.panel)

    @property
    def everyone(self) -> DataFrame:
        return self.panel.where(F.col("place") == TOTAL_KEY)

    def growth(self) -> DataFrame:
        """Growth of every complete entity between the two years; totals do not count as an entity."""
        return growth_rate(self.entities, POPULATION, self.first, self.last, self.n)

    def growth_histogram(self) -> DataFrame:
        return histogram_density(self.growth(), "growth_rate", *GROWTH_RANGE)

    def growth_density(self) -> DataFrame:
        return kde(self.growth().withColumn("kind", F.lit("growth")), "growth_rate", ["kind"], *GROWTH_RANGE)

    def ratio_density(self) -> DataFrame:
        """Working/senior ratio of the entities in the first and the last year."""
        ends = self.entities.where(F.col(TIME).isin(self.first, self.last))
        return kde(ends, "working_senior_ratio", [TIME], *RATIO_RANGE)

    def composition(self) -> DataFrame:
        """Age groups and ratios of everyone, by year."""
        return stacked_series(self.everyone, [TIME])

    def axis(self) -> DataFrame:
        return report_max(self.everyone, [POPULATION])


def descriptive_report(training: DataFrame, held: DataFrame, first: int, last: int, n: int) -> Description:
    """Totals, growth between two years of entities with ``n`` rows, and distributions."""
    return Description(age_panel(training, held), first, last, n)
