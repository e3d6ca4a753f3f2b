"""Feature packs: employment, capital, customs; and the register that holds packs.

A pack takes a panel of (code, month) and returns it with its features and its axis. Sources are summed first, to a row for
each code and month, so what is joined to the panel is as small as the panel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.functions.exprs import clip, dlog, row_mean, safe_div
from pitwright.operators.pit import pit_frame, valid_interval_join
from pitwright.operators.tswin import along, ffill, ols_residual, rolling
from pitwright.plans.axes import standardised

# Share of income paid in; ceiling of the monthly income that counts, by year; the month in which incomes are set anew;
# head counts at which rules change, and how near counts as near; groups of advanced markets are a parameter.
RATE = 0.09
INCOME_CAP = {2016: 4_340_000, 2017: 4_490_000, 2018: 4_680_000, 2019: 4_860_000, 2020: 5_030_000, 2021: 5_240_000, 2022: 5_530_000, 2023: 5_900_000, 2024: 6_170_000}
LATEST_CAP = 6_370_000
RESET_MONTH = 7
BANDS, BAND_WIDTH = (50, 100, 300), 0.10
WON_PER_USD = 1300.0


def _back(c: str, rows: int = 12) -> Column:
    return F.lag(c, rows).over(along())


def _change(c: str, rows: int = 12) -> Column:
    return F.col(c) - _back(c, rows)


def _weight(theta: str) -> Column:
    """How much of a firm the source sees, as a weight: unknown is none."""
    return F.coalesce(clip(F.col(theta), 0.0, 1.0), F.lit(0.0))


def _axis(df: DataFrame, features: tuple[str, ...], products: Callable[[dict[str, Column]], dict[str, Column]], axis: str, theta: str | None = None) -> DataFrame:
    a = standardised(df, {f"__z_{c}": c for c in features})
    made = products({c: F.col(f"__z_{c}") for c in features})
    a = a.withColumns(made)
    mean = row_mean(*(F.col(c) for c in made))
    return a.withColumn(axis, mean * _weight(theta) if theta else mean).drop(*(f"__z_{c}" for c in features))


# ---- employment


def workplace_panel(workplaces: DataFrame, mapping: DataFrame, key: str = "workplace") -> DataFrame:
    """(code, month, members, paid, joined, quit, n_places, event_date, knowledge_date): sums over the workplaces that belonged to a
    code in that month; known two month ends later."""
    a = valid_interval_join(workplaces, mapping, key, "month").groupBy("code", "month")
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("members", "paid", "joined", "quit"))
    return pit_frame(a.agg(*sums, F.countDistinct(key).alias("n_places")), F.col("month"), F.last_day(F.add_months("month", 2)), "workplaces").drop("_src")


def employment_features(df: DataFrame) -> DataFrame:
    """n1 growth of members; n2 premium of the marginal wage over the wage before; n3 fall of the share that quits; n4 more places and more
    members; n5 change of nearness to the income ceiling; n6 the yearly raise; theta_N; flags; d_tax. Columns members, paid,
    quit, n_places, employees, tax_expense, pretax_income are taken.

    The marginal wage is defined only where members change by 3 and by 0.5 % at least, and not in the month when all incomes are set anew.
    """
    cap = F.lit(float(LATEST_CAP))
    for year, top in INCOME_CAP.items():
        cap = F.when(F.year("month") == year, F.lit(float(top))).otherwise(cap)
    reset, members = F.month("month") == RESET_MONTH, F.col("members")
    a = df.withColumns({"income": safe_div(F.col("paid") / RATE, members), "loss_rate": safe_div(F.col("quit"), members), "eff_tax": clip(safe_div(F.col("tax_expense"), F.col("pretax_income")), -1.0, 1.0), "n1": dlog(members, _back("members"))})
    steady = F.abs(_change("members", 1)) >= F.greatest(F.lit(3.0), members * 0.005)
    a = a.withColumns({"marginal_wage": F.when(steady & ~reset, clip(safe_div(_change("paid", 1), _change("members", 1)) / RATE, 0.0, 5e7)), "cap_ratio": clip(F.col("income") / cap, 0.0, 2.0), "__jump": F.when(reset, safe_div(F.col("income"), _back("income", 1)) - 1)})
    premium = safe_div(F.col("marginal_wage"), _back("income", 1))
    seen = clip(safe_div(members, F.col("employees")), 0.0, 2.0)
    near = [F.abs(members - b) <= b * BAND_WIDTH for b in BANDS]
    return a.withColumns(
        {
            "n2": F.when((premium > 0.1) & (premium < 10), premium),
            "n3": -_change("loss_rate"),
            "n4": F.coalesce(((_change("n_places") > 0) & (F.col("n1") > 0)).cast("double"), F.lit(0.0)),
            "n5": _change("cap_ratio"),
            "n6": ffill("__jump", along(), 11),
            "theta_N": F.when(seen > 0, seen),
            "high_wage": F.coalesce((F.col("cap_ratio") > 0.85).cast("int"), F.lit(0)),
            "near_band": F.coalesce((near[0] | near[1] | near[2]).cast("int"), F.lit(0)),
            "d_tax": _change("eff_tax"),
        }
    ).drop("__jump")


def employment_axis(df: DataFrame) -> DataFrame:
    """df with TP_N1 to TP_N4 and E_N: more people, and each time something that usually suffers for it."""
    pairs = lambda z: {"TP_N1": z["n1"] * z["n2"], "TP_N2": z["n1"] * z["n3"], "TP_N3": z["n4"] * z["n1"], "TP_N4": z["n1"] * z["d_va_per_emp"]}
    return _axis(df, ("n1", "n2", "n3", "n4", "d_va_per_emp"), pairs, "E_N", "theta_N")


# ---- capital


def capital_features(df: DataFrame, events: DataFrame) -> DataFrame:
    """p1, p2: 12-row changes of payout to cash flow and of investment to revenue; p3: own shares cancelled to acquired, by events of 12 rows; acq_size;
    p4: change of the debt ratio (d_debt_ratio). events: code, month, event (treasury_acq or treasury_canc)."""
    kinds = ["treasury_acq", "treasury_canc"]
    counts = events.where(F.col("event").isin(kinds)).groupBy("code", "month").pivot("event", kinds).count()
    spent = lambda *cs: sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in cs), F.lit(0.0))
    a = df.join(counts, ["code", "month"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("double") for c in kinds})
    a = a.withColumns({"payout_ratio": safe_div(spent("dividend_paid_ttm", "treasury_buy_ttm"), F.col("cfo_ttm")), "invest_ratio": safe_div(spent("capex_ttm", "rnd_ttm"), F.col("revenue_ttm")), **{f"{c}_n": rolling(c, F.sum, along(), 12, 1) for c in kinds}})
    return a.withColumns(
        {
            "p1": _change("payout_ratio"),
            "p2": _change("invest_ratio"),
            "p3": clip(safe_div(F.col("treasury_canc_n"), F.col("treasury_acq_n")), 0.0, 2.0),
            "acq_size": safe_div(F.abs("treasury_buy_ttm"), F.col("assets")),
            "p4": F.col("d_debt_ratio"),
        }
    )


def capital_axis(df: DataFrame) -> DataFrame:
    """df with TP_P1 to TP_P3 and E_C. Cancelling says something only of those who bought more than their cell."""
    pairs = lambda z: {"TP_P1": z["p1"] * z["p2"], "TP_P2": F.when(z["acq_size"] > 0, z["acq_size"]) * z["p3"], "TP_P3": z["p1"] * -z["p4"]}
    return _axis(df, ("p1", "p2", "p3", "acq_size", "p4"), pairs, "E_C")


# ---- customs


def customs_panel(trade: DataFrame, mapping: DataFrame, advanced: list[str]) -> DataFrame:
    """(code, month, exp_usd, exp_wgt, hhi_dest, adv_share, event_date, knowledge_date): exports dealt to codes by weight, in one shuffle;
    known 15 days after the next month's end. trade: month, hs, grp, usd, wgt; mapping: hs, code, weight."""
    usd = F.col("usd") * F.col("weight")
    a = trade.join(mapping, "hs").withColumn("__u", usd).groupBy("code", "month")
    a = a.agg(F.sum("__u").alias("exp_usd"), F.sum(F.col("wgt") * F.col("weight")).alias("exp_wgt"), F.sum(F.col("__u") * F.col("__u")).alias("__sq"), F.sum(F.when(F.col("grp").isin(advanced), F.col("__u"))).alias("__adv"))
    a = a.withColumns({"hhi_dest": safe_div(F.col("__sq"), F.col("exp_usd") * F.col("exp_usd")), "adv_share": safe_div(F.col("__adv"), F.col("exp_usd"))}).drop("__sq", "__adv")
    return pit_frame(a, F.col("month"), F.date_add(F.last_day(F.add_months("month", 1)), 15), "customs").drop("_src")


def customs_features(df: DataFrame) -> DataFrame:
    """x1 growth of weight; x2 unit price beside its own trend (residual of 36 months without a gap: mean of 6 over deviation of 36); x3_1 fall of
    concentration; x3_2 rise of advanced markets; theta_X; d_sgna."""
    t = F.months_between("month", F.first("month").over(along()))
    a = df.withColumns({"__price": F.log(safe_div(F.col("exp_usd"), F.col("exp_wgt"))), "__t": F.round(t), "sgna_ratio": safe_div(F.col("sgna_ttm"), F.col("revenue_ttm"))})
    a = ols_residual(a, "__price", "exp_wgt", "__t", along()).withColumn("resid", F.when(F.col("__t") - _back("__t", 35) == 35, F.col("resid")))
    usual = rolling("resid", F.stddev_samp, along(), 36, 18)
    return a.withColumns(
        {
            "x1": dlog(F.col("exp_wgt"), _back("exp_wgt")),
            "x2": safe_div(rolling("resid", F.avg, along(), 6, 4), usual),
            "x3_1": -_change("hhi_dest"),
            "x3_2": _change("adv_share"),
            "theta_X": clip(safe_div(F.col("exp_usd") * WON_PER_USD, F.col("revenue_ttm")), 0.0, 2.0),
            "d_sgna": _change("sgna_ratio"),
        }
    ).drop("__price", "__t", "sgna_ratio")


def customs_axis(df: DataFrame) -> DataFrame:
    """df with TP_X1 to TP_X3 and E_X."""
    pairs = lambda z: {"TP_X1": z["x1"] * z["x2"], "TP_X2": z["x3_1"] * z["x2"], "TP_X3": z["x3_2"] * -z["d_sgna"]}
    return _axis(df, ("x1", "x2", "x3_1", "x3_2", "d_sgna"), pairs, "E_X", "theta_X")


# ---- the register


@dataclass
class Packs:
    """Packs by id. A pack without a list of policies that could explain its effect is refused; a disabled one gives a NULL axis."""

    packs: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    policies: dict[str, list[tuple[str, str | None]]] = field(default_factory=dict)
    disabled: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, features: Callable[[DataFrame], DataFrame], policy: list[tuple[str, str | None]]) -> None:
        if not policy:
            raise ValueError(f"pack {name} names no policies")
        self.packs[name], self.policies[name] = features, policy

    def disable(self, name: str, reason: str) -> None:
        self.disabled[name] = reason

    def apply(self, df: DataFrame) -> DataFrame:
        for name, features in self.packs.items():
            df = df.withColumn(f"E_{name}", F.lit(None).cast("double")) if name in self.disabled else df.transform(features)
        return df
