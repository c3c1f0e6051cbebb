"""Rolling operators within a ticker, by row position in date order.

``least`` is the fewest values that a window needs: ``None`` means all n, so a gap or a
short history gives NULL.  All share one window specification, hence one exchange and one sort
of the panel by ticker, however many of them a select holds.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from factorloom.functions import finite, safe_div


class TickerWindow:
    def __init__(self, ticker: str = "ticker", date: str = "date"):
        self.ticker, self.date = ticker, date

    @property
    def all(self) -> WindowSpec:
        return Window.partitionBy(self.ticker).orderBy(self.date)

    def rows(self, n: int) -> WindowSpec:
        return self.all.rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.all.rowsBetween(Window.unboundedPreceding, 0)

    def _full(self, value: Column, present: Column, n: int, least: int | None) -> Column:
        return F.when(F.count(present).over(self.rows(n)) >= (n if least is None else least), value)

    def sum(self, x: Column, n: int, least: int | None = None) -> Column:
        x = finite(x)
        return self._full(F.sum(x).over(self.rows(n)), x, n, least)

    def mean(self, x: Column, n: int, least: int | None = None) -> Column:
        x = finite(x)
        return self._full(F.avg(x).over(self.rows(n)), x, n, least)

    def std(self, x: Column, n: int, least: int | None = None) -> Column:
        x = finite(x)
        return self._full(F.stddev_samp(x).over(self.rows(n)), x, n, least)

    def min(self, x: Column, n: int, least: int | None = None) -> Column:
        x = finite(x)
        return self._full(F.min(x).over(self.rows(n)), x, n, least)

    def max(self, x: Column, n: int, least: int | None = None) -> Column:
        x = finite(x)
        return self._full(F.max(x).over(self.rows(n)), x, n, least)

    def quantile(self, x: Column, n: int, q: float, least: int | None = None) -> Column:
        """Linear interpolation between the neighbouring values."""
        x = finite(x)
        values = F.array_sort(F.collect_list(x).over(self.rows(n)))
        at = (F.size(values) - 1) * F.lit(float(q))
        low = F.floor(at).cast("int")
        down, up = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return self._full(down + (up - down) * (at - low), x, n, least)

    def _pair(self, x: Column, y: Column) -> tuple[Column, Column]:
        both = finite(x).isNotNull() & finite(y).isNotNull()
        return F.when(both, x), F.when(both, y)

    def cov(self, x: Column, y: Column, n: int, least: int | None = None) -> Column:
        x, y = self._pair(x, y)
        return self._full(F.covar_samp(x, y).over(self.rows(n)), x, n, least)

    def corr(self, x: Column, y: Column, n: int, least: int | None = None) -> Column:
        """NULL on constant windows, where the built-in corr raises."""
        x, y = self._pair(x, y)
        w = self.rows(n)
        spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
        return self._full(safe_div(F.covar_samp(x, y).over(w), spread), x, n, least)

    def beta(self, y: Column, x: Column, n: int, least: int | None = None) -> Column:
        x, y = self._pair(x, y)
        w = self.rows(n)
        return self._full(safe_div(F.covar_samp(x, y).over(w), F.var_samp(x).over(w)), x, n, least)

    def rank(self, x: Column, n: int, least: int | None = None) -> Column:
        """Percentile rank of the last value in its window, ties averaged; infinities keep their place."""
        values = F.collect_list(x).over(self.rows(n))
        below = F.size(F.filter(values, lambda v: v < x))
        same = F.size(F.filter(values, lambda v: v == x))
        return F.when(x.isNotNull(), self._full((below + (same + 1) / 2) / F.size(values), x, n, least))

    def argmax(self, x: Column, n: int) -> Column:
        """Place of the first largest value, the oldest being 1."""
        return self._place(F.max, finite(x), n)

    def argmin(self, x: Column, n: int) -> Column:
        return self._place(F.min, finite(x), n)

    def _place(self, best, x: Column, n: int) -> Column:
        w = self.rows(n)
        return self._full(F.array_position(F.collect_list(x).over(w), best(x).over(w)).cast("double"), x, n, None)

    def delay(self, x: Column, k: int) -> Column:
        return F.lag(x, k).over(self.all)

    def lead(self, x: Column, k: int) -> Column:
        return F.lead(x, k).over(self.all)

    def delta(self, x: Column, k: int) -> Column:
        return x - self.delay(x, k)

    def decay(self, x: Column, n: int) -> Column:
        """Weighted mean, the newest weighing n times the oldest; NULL if any value is."""
        x = finite(x)
        values = F.collect_list(x).over(self.rows(n))
        total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
        return self._full(total / (n * (n + 1) / 2), x, n, None)

    def decay_known(self, x: Column, n: int) -> Column:
        """The same over known values only, weights renormalised."""
        x = finite(x)
        lags = [F.lag(x, n - 1 - i).over(self.all) for i in range(n)]
        top = sum((F.coalesce(v * (i + 1), F.lit(0.0)) for i, v in enumerate(lags)), F.lit(0.0))
        weight = sum((F.when(v.isNotNull(), float(i + 1)).otherwise(0.0) for i, v in enumerate(lags)), F.lit(0.0))
        return safe_div(top, weight)

    def forward_fill(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far())

    def cumulative_growth(self, x: Column) -> Column:
        """Running product of 1 + x; a gap is NULL and doesn't end it."""
        return F.when(x.isNotNull(), F.product(1 + x).over(self.so_far()))

    def pct_change(self, filled: Column, k: int = 1) -> Column:
        """Of a series that is forward-filled already."""
        return safe_div(filled, self.delay(filled, k)) - 1

    def forward_return(self, x: Column, k: int) -> Column:
        return safe_div(self.lead(x, k), x) - 1

    def drawdown(self, nav: Column) -> Column:
        return safe_div(nav, F.max(nav).over(self.so_far())) - 1
