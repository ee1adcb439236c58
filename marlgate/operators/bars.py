"""What a strategy may see at one session: a view of panel, statements and snapshots that never looks ahead."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.operators import portal


@dataclass(frozen=True)
class BarView:
    """Everything as known at ``session`` (a value of the panel's session column).

    Defined results. An asset the panel doesn't have gives no row, one without a bar nulls. Prices are adjusted as of the
    session, so a later split changes nothing. Statements and snapshots of the session's own day aren't known yet.
    """

    panel: DataFrame
    session: object
    statements: DataFrame | None = None
    snapshots: DataFrame | None = None
    adjustment: str = "qfq"

    def current(self, fields: Sequence[str], assets: Sequence[object] | None = None) -> DataFrame:
        """asset and fields at the session."""
        return portal.values_at(self.panel, fields, self.session, assets, self.adjustment)

    def raw_current(self, fields: Sequence[str], assets: Sequence[object] | None = None) -> DataFrame:
        """The same as traded, without adjustment."""
        return portal.values_at(self.panel, fields, self.session, assets, "raw")

    def history(self, fields: Sequence[str], bars: int, assets: Sequence[object] | None = None) -> DataFrame:
        """asset, session and fields of the last ``bars`` sessions, this one included."""
        if bars < 1:
            raise ValueError("a history has at least one bar")
        return portal.history(self.panel, fields, self.session, bars, assets, self.adjustment)

    def fundamentals(self, fields: Sequence[str], day: object, periods: int = 1, report_type: str | None = "1") -> DataFrame:
        """Each company's last report periods as known before the day; ``day`` in the statements' spelling."""
        if self.statements is None:
            raise ValueError("this view has no statements")
        return portal.statements_known(self.statements, day, fields, report_type, periods)

    def constituents(self, day: object) -> DataFrame:
        """series, snapshot, item of the latest snapshots before the day; ``day`` in the snapshots' spelling."""
        if self.snapshots is None:
            raise ValueError("this view has no snapshots")
        return portal.members_on(self.snapshots, day)

    def can_trade(self, suspended: str | None = None, assets: Sequence[object] | None = None) -> DataFrame:
        """asset, can_trade: a bar exists, something was traded and the flag isn't set."""
        rows = self.panel.where(F.col("session") == F.lit(self.session))
        rows = rows if assets is None else rows.where(F.col("asset").isin(list(assets)))
        flag = F.coalesce(F.col(suspended).cast("boolean"), F.lit(False)) if suspended else F.lit(False)
        return rows.select("asset", portal.tradable(rows, flag).alias("can_trade"))
