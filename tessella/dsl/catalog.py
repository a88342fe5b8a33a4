"""The functions that formulas may call. register() adds more."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessella.functions import scalar as S
from tessella.operators import cs, ts


@dataclass(frozen=True)
class Function:
    name: str
    kind: str  # scalar, ts or cs: what its rows must be brought together by
    build: Callable  # columns and numbers -> Column
    series: int  # arguments that are columns; -1: all
    numbers: tuple[str, ...] = ()  # names of the numeric arguments after them
    defaults: tuple[float, ...] = ()  # of the last of those
    group: str = "math"

    @property
    def window(self) -> int | None:
        """Which argument says how many bars back it looks."""
        return self.series if self.kind == "ts" and self.numbers else None


FUNCTIONS: dict[str, Function] = {}
ALIASES: dict[str, str] = {}


def register(name: str, kind: str, build: Callable, series: int = 1, numbers: tuple[str, ...] = (), defaults: tuple[float, ...] = (), group: str | None = None, aliases: tuple[str, ...] = ()) -> None:
    FUNCTIONS[name] = Function(name, kind, build, series, numbers, defaults, group or {"ts": "time-series", "cs": "cross-section"}.get(kind, "math"))
    ALIASES.update(dict.fromkeys(aliases, name))


_N = ("window",)
for _name, _build, _aliases in (
    ("ts_mean", ts.mean, ()), ("ts_sum", ts.total, ()), ("ts_max", ts.maximum, ()), ("ts_min", ts.minimum, ()), ("ts_std", ts.std, ()), ("ts_median", ts.median, ()), ("ts_skew", ts.skew, ()), ("ts_kurt", ts.kurt, ()),
    ("ts_argmax", ts.argmax, ()), ("ts_argmin", ts.argmin, ()), ("ts_minmax_norm", ts.minmax_norm, ()), ("ts_zscore", ts.zscore, ()), ("ts_rank", ts.rank, ()), ("ts_decay_linear", ts.decay_linear, ("decay_linear",)),
):
    register(_name, "ts", _build, 1, _N, aliases=_aliases)
for _name, _build in (("ts_mean2", ts.mean_of_two), ("ts_zscore2", ts.zscore_of_two)):
    register(_name, "ts", _build, 1, _N)
for _name, _build in (("ts_ema_at", ts.ema_at), ("ts_ewm_at", ts.ewm_at)):
    register(_name, "ts", _build, 2, _N)
register("ts_carry", "ts", ts.carry)
register("ts_hold", "ts", ts.carry)  # of a mean; check() counts the mean's own look-back only
register("ts_place", "ts", ts.place)
register("lag", "ts", ts.lag, 1, _N, (1,), aliases=("delay",))
register("delta", "ts", ts.delta, 1, _N, (1,))
register("ts_pct_change", "ts", ts.pct_change, 1, _N, (1,))
register("ts_quantile", "ts", ts.quantile, 1, ("window", "q"))
register("ts_cov", "ts", ts.cov, 2, _N)
register("ts_corr", "ts", ts.corr, 2, _N)

register("cs_rank", "cs", cs.rank, aliases=("rank",))
register("cs_demean", "cs", cs.demean, aliases=("demean",))
register("cs_zscore", "cs", cs.zscore, aliases=("zscore",))
register("cs_share", "cs", cs.share)
register("cs_winsorize", "cs", cs.winsorize, 1, ("p",), (0.01,), aliases=("winsorize",))
register("cs_quantile", "cs", cs.quantile, 1, ("q",), (0.5,))
register("pct_rank", "cs", cs.pct_rank_centred)
register("zclip", "cs", cs.zclip)
register("weight_cap", "cs", cs.weight_cap, 1, ("most",))
register("cs_extremes", "cs", cs.extremes, 1, ("q",))
#: Two passes over the bar: written as formulas of the above, x and y standing for the arguments.
MACROS: dict[str, tuple[tuple[str, ...], str]] = {
    "cs_scale": (("x",), "cs_share(cs_demean(x))"),
    "cs_neutralize": (("x", "y"), "cs_demean(x) - cs_beta(cs_demean(x), cs_demean(y)) * cs_demean(y)"),
    "mad_winsorize": (("x", "k"), "clamp_to(x, cs_median(x), k * (cs_median(abs(x - cs_median(x))) + 0.00000001))"),
    "ts_ewm": (("x", "n"), "ts_carry(ts_ewm_at(x, ts_place(x), n))"),
    "ts_ema": (("x", "n"), "ts_hold(ts_ema_at(x, ts_place(x), n))"),
    # Derived fields
    "ret_1": ((), "ts_pct_change(close_trade_px, 1)"),
    "range_pct": ((), "div(high_trade_px - low_trade_px, close_trade_px)"),
    "mid_px": ((), "(high_trade_px + low_trade_px) / 2"),
    "vwap_gap": ((), "div(close_trade_px, vwap) - 1"),
}
ALIASES |= {"scale": "cs_scale", "safe_div": "div", "signed_power": "pow", "clamp": "clip"}


def _beta(x, y):
    from pyspark.sql import functions as F

    return F.sum(x * y).over(cs.bar()) / (F.sum(y * y).over(cs.bar()) + S.EPS)


register("cs_beta", "cs", _beta, 2)
register("cs_median", "cs", lambda x: cs.percentile(x, 0.5))


def _clamp_to(x, centre, reach):
    from pyspark.sql import functions as F

    return F.when(x < centre - reach, centre - reach).when(x > centre + reach, centre + reach).otherwise(x)


register("clamp_to", "scalar", _clamp_to, 3)
register("add", "scalar", lambda a, b: a + b, 2)
register("sub", "scalar", lambda a, b: a - b, 2)
register("mul", "scalar", lambda a, b: a * b, 2)
register("div", "scalar", S.safe_div, 2)
register("ratio", "scalar", S.ratio, 2)
register("neg", "scalar", lambda a: -a)
register("pow", "scalar", S.signed_power, 1, ("p",))
register("clip", "scalar", S.clip, 1, ("lo", "hi"))
for _name, _build in (("signed_log", S.signed_log), ("log", S.log), ("sqrt", S.sqrt), ("sigmoid", S.sigmoid)):
    register(_name, "scalar", _build)


register("fill_zero", "scalar", S.fill_zero)
register("twelve", "scalar", S.twelve)


def _native(name: str):
    from pyspark.sql import functions as F

    return lambda x: getattr(F, name)(x)


for _name, _native_name in (("abs", "abs"), ("sign", "signum"), ("tanh", "tanh")):
    register(_name, "scalar", _native(_native_name))
for _name, _build in (("gt", S.gt), ("ge", S.ge), ("lt", S.lt), ("le", S.le), ("eq", S.eq), ("and_op", S.and_op), ("or_op", S.or_op), ("min_of", S.min_of), ("max_of", S.max_of)):
    register(_name, "scalar", _build, 2, group="conditional")
register("not_op", "scalar", S.not_op, group="conditional")
register("ifelse", "scalar", S.ifelse, 3, group="conditional")
register("mean_of", "scalar", S.mean_of, -1, group="combination")


def frame(spark: SparkSession) -> DataFrame:
    """The catalog as rows: name, kind, group, arguments, aliases."""
    held = [Function("ts_ema", "ts", ts.ema_at, 1, _N, (), "time-series")]  # a macro with a window
    rows = [(f.name, f.kind, f.group, f.series, list(f.numbers), sorted(a for a, n in ALIASES.items() if n == f.name)) for f in [*FUNCTIONS.values(), *held]]
    return spark.createDataFrame(sorted(rows), "name string, kind string, group string, n_series int, numbers array<string>, aliases array<string>")
