"""The dashboard's flow as one object: sidebar filters applied once, then every
tab's tables as lazy DataFrames.

Mirrors the source dashboard's order of work: load → type → filter (grade,
role, product, period) → propagate the selection to the skeletons → funnels,
dynamics, skeletons, classes, session time, month comparison, export.  Each
method composes operators of this package; nothing is computed until the
caller acts on a returned frame (the exact median in ``time`` excepted).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse, classes, compare, filters, funnel, metrics, report, skeleton
from ..sources import sinks


@dataclass
class Dashboard:
    """``dialogs`` in canonical columns (see ``sources.tables.canonical_dialogs``),
    optional ``skeletons`` (``canonical_skeletons``) and ``class_stats``
    (``canonical_classes``); sidebar selections as in the dashboard (``None`` or
    ``'Все'`` = no filter)."""

    dialogs: DataFrame
    skeletons: DataFrame | None = None
    class_stats: DataFrame | None = None
    grade: object = None
    role: str | None = None
    product: str | None = None
    period: tuple | None = None
    _filtered: DataFrame | None = field(default=None, init=False, repr=False)

    # --- sidebar ----------------------------------------------------------------

    def facets(self) -> DataFrame:
        """F-6: the values offered by the grade / role / product selectors."""
        return filters.facets(self.dialogs, ["dialog_grade", "dialog_role", "product_slug"])

    def period_bounds(self) -> DataFrame:
        """A-14: the default period."""
        return metrics.period_bounds(self.dialogs)

    @property
    def filtered(self) -> DataFrame:
        """F-1…F-3: the dialogs passing every sidebar filter.

        Without a period the default one applies, from the first to the last day: it keeps
        every dialog with a readable date (all dialogs, if none has one).
        """
        if self._filtered is None:
            d = filters.apply_filters(self.dialogs, grade=self.grade, role=self.role,
                                      product=self.product, period=self.period)
            if not self.period and "activity_dt" in d.columns:
                dated = F.col("activity_dt").isNotNull()
                if not self.dialogs.where(dated).isEmpty():
                    d = d.where(dated)
            self._filtered = d
        return self._filtered

    def filter_effect(self) -> DataFrame:
        """F-7: dialogs shown of all dialogs, and the filters applied."""
        return filters.filter_effect(self.dialogs, grade=self.grade, role=self.role, product=self.product,
                                     period=self.period)

    def selected_skeletons(self) -> DataFrame | None:
        """J-1: skeletons of the selected dialogs (semi join, no id list)."""
        if self.skeletons is None:
            return None
        return filters.skeletons_for(self.skeletons, self.filtered)

    # --- tab: funnels -------------------------------------------------------------

    def matching_funnel(self) -> DataFrame:
        return funnel.with_funnel_text(funnel.matching_funnel(self.filtered))

    def post_funnel(self) -> DataFrame:
        return funnel.with_funnel_text(funnel.post_funnel(self.filtered))

    def post_rate(self) -> DataFrame:
        return funnel.post_funnel_rate(self.filtered)

    # --- tab: dynamics ------------------------------------------------------------

    def daily(self) -> DataFrame:
        return metrics.daily_counts(self.filtered)

    def kpis(self) -> DataFrame:
        return metrics.kpis(self.filtered)

    # --- tab: skeletons -----------------------------------------------------------

    def skeleton_blocks(self) -> DataFrame | None:
        """B-1…B-7 for every selected dialog, with the block labels."""
        sk = self.selected_skeletons()
        return None if sk is None else skeleton.parse_skeletons(sk).select("*", *skeleton.label_columns())

    def skeleton_excerpts(self) -> DataFrame | None:
        sk = self.selected_skeletons()
        return None if sk is None else skeleton.block_excerpts(sk)

    def skeleton_search(self, text: str, regex: bool = False) -> DataFrame | None:
        sk = self.selected_skeletons()
        return None if sk is None else filters.search_dialog(sk, text, regex=regex, first=True)

    def skeleton_options(self, n: int = 100) -> DataFrame | None:
        sk = self.selected_skeletons()
        return None if sk is None else browse.dialog_options(sk, n)

    def skeleton_browser(self, n: int = 50) -> DataFrame | None:
        sk = self.selected_skeletons()
        return None if sk is None else browse.browse_skeletons(sk, n)

    # --- tab: classes / subjects ----------------------------------------------------

    def grade_bars(self) -> DataFrame | None:
        return None if self.class_stats is None else classes.grade_totals(self.class_stats)

    def subject_shares(self) -> DataFrame | None:
        return None if self.class_stats is None else classes.subject_totals(self.class_stats)

    # --- tab: session time ------------------------------------------------------------

    def time(self, approx: bool = False) -> DataFrame:
        return metrics.session_stats(self.filtered, approx=approx)

    def top_sessions(self, k: int = 20) -> DataFrame:
        return metrics.top_sessions(self.filtered, k)

    def top_sessions_with_skeleton(self, k: int = 20) -> DataFrame | None:
        sk = self.selected_skeletons()
        if sk is None:
            return None
        return browse.top_sessions_with_skeleton(self.filtered, sk, skeleton.parse_skeletons, k)

    # --- tab: comparison ----------------------------------------------------------------

    def comparison(self, months=None) -> tuple[DataFrame, DataFrame]:
        """A-12/A-13 over the selected months with grade/role/product applied
        and the period ignored (as in the dashboard)."""
        d = compare.comparison_filter(self.dialogs, grade=self.grade, role=self.role, product=self.product)
        if months is not None:
            d = compare.select_months(d, months)
        return metrics.monthly_conversion(d), metrics.monthly_daily_counts(d)

    # --- report and export ------------------------------------------------------------

    def report(self) -> DataFrame:
        return report.full_report(self.filtered)

    def export(self, folder: str, month: str) -> str:
        """K-1: the filtered dialogs as CSV with the source's headers under ``analytics_{month}_{YYYYMMDD}``."""
        path = f"{folder.rstrip('/')}/{sinks.export_name(month)}"
        sinks.export_csv(sinks.with_source_names(self.filtered), path)
        return path

