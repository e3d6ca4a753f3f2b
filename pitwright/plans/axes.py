"""Evidence axes of a panel, the reflection score, and the one path from axes to a signal.

Standardising is done for all features of an axis together: one shuffle for each rung of the ladder of cells, however
many features there are.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.functions.exprs import dlog, row_mean, safe_div, state_label
from pitwright.operators import ranks, xsec
from pitwright.operators.pit import asof_join
from pitwright.operators.tswin import along, slope
from pitwright.sources.files import dealt, written

CELLS = ("cell", "cell_l2", "cell_l3")


def standardised(df: DataFrame, features: dict[str, str], how=xsec.zscore, cells: tuple[str, ...] = CELLS, **options) -> DataFrame:
    """df with, for each out: column of features, the value of the first cell, from fine to coarse, that gives one."""
    return xsec.TOGETHER[how](df, features, list(cells), **options)


def _back(c: str, rows: int = 12) -> Column:
    return F.lag(c, rows).over(along())


def quality_features(df: DataFrame) -> DataFrame:
    """Axis B: gpm and its trend b1, DIO, DSO, turn_days, d_turn, dlog_rev, accruals, d_accruals, b4. Changes are over 12 rows."""
    rev = F.col("revenue_ttm")
    a = df.withColumns({"gpm": safe_div(rev - F.col("cogs_ttm"), rev), "DIO": safe_div(F.col("inventory"), F.col("cogs_ttm")) * 365, "DSO": safe_div(F.col("receivable"), rev) * 365, "__row": F.row_number().over(along())})
    a = a.withColumns({"turn_days": F.col("DIO") + F.col("DSO"), "accruals": safe_div(F.col("net_income_ttm") - F.col("cfo_ttm"), (F.col("assets") + _back("assets")) / 2)})
    return a.withColumns(
        {
            "b1": slope("gpm", "__row", along()),
            "d_turn": F.col("turn_days") - _back("turn_days"),
            "dlog_rev": dlog(rev, _back("revenue_ttm")),
            "d_accruals": F.col("accruals") - _back("accruals"),
            "b4": safe_div(F.col("contract_liab") - _back("contract_liab"), rev),
        }
    ).drop("__row")


def quality_axis(df: DataFrame) -> DataFrame:
    """df with TP_B1, TP_B2 and E_AXB: growth that turnover and accruals keep up with, and the trends, half each."""
    a = standardised(df, {f"__z_{c}": c for c in ("dlog_rev", "d_turn", "d_accruals", "b1", "b4")})
    a = a.withColumns({"TP_B1": F.col("__z_dlog_rev") * -F.col("__z_d_turn"), "TP_B2": F.col("__z_dlog_rev") * -F.col("__z_d_accruals")})
    a = a.withColumn("E_AXB", 0.5 * row_mean(F.col("TP_B1"), F.col("TP_B2")) + 0.5 * row_mean(F.col("__z_b1"), F.col("__z_b4")))
    return a.drop(*(c for c in a.columns if c.startswith("__z_")))


def resource_features(df: DataFrame) -> DataFrame:
    """Axis C: IC, dlog_IC, ROIC (after 22 % tax, on mean capital), d_ROIC, value_added, va_per_emp, d_va_per_emp, dlog_emp, c3, debt_ratio, d_debt_ratio."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    a = df.withColumns(
        {
            "IC": known("receivable") + known("inventory") - known("payable") + known("ppe") + known("intangible"),
            "value_added": known("op_income_ttm") + known("payroll") + known("dep_ttm"),
            "debt_ratio": safe_div(F.col("liabilities"), F.col("equity")),
            "c3": safe_div(F.abs("capex_ttm"), F.abs("dep_ttm")),
        }
    )
    a = a.withColumns({"dlog_IC": dlog(F.col("IC"), _back("IC")), "ROIC": safe_div(F.col("op_income_ttm") * 0.78, (F.col("IC") + _back("IC")) / 2), "va_per_emp": safe_div(F.col("value_added"), F.col("employees"))})
    return a.withColumns({"d_ROIC": F.col("ROIC") - _back("ROIC"), "d_va_per_emp": F.col("va_per_emp") - _back("va_per_emp"), "dlog_emp": dlog(F.col("employees"), _back("employees")), "d_debt_ratio": F.col("debt_ratio") - _back("debt_ratio")})


def resource_axis(df: DataFrame) -> DataFrame:
    """df with TP_C1, TP_C2 and E_AXC: capital and people that grow while what they earn holds, and c3, half each."""
    a = standardised(df, {f"__z_{c}": c for c in ("dlog_IC", "d_ROIC", "dlog_emp", "d_va_per_emp", "c3")})
    a = a.withColumns({"TP_C1": F.col("__z_dlog_IC") * F.col("__z_d_ROIC"), "TP_C2": F.col("__z_dlog_emp") * F.col("__z_d_va_per_emp")})
    a = a.withColumn("E_AXC", 0.5 * row_mean(F.col("TP_C1"), F.col("TP_C2")) + 0.5 * F.col("__z_c3"))
    return a.drop(*(c for c in a.columns if c.startswith("__z_")))


def reflection_features(df: DataFrame) -> DataFrame:
    """Axis D: dlog_E, dlog_P, dlog_M over 6 rows, d1 = -dlog_M, D_state, and d3 from cum120 (net flow of 120 days) where df has it."""
    a = df.withColumns({"dlog_E": dlog(F.col("net_income_ttm"), _back("net_income_ttm", 6)), "dlog_P": dlog(F.col("close"), _back("close", 6))})
    a = a.withColumn("dlog_M", F.col("dlog_P") - F.col("dlog_E")).withColumns({"d1": -F.col("dlog_M"), "D_state": state_label(F.col("dlog_E"), F.col("dlog_M"))})
    return a.withColumn("d3", -safe_div(F.col("cum120"), F.col("adv20") * 250) if "cum120" in a.columns else F.lit(None).cast("double"))


def net_flow_120(daily: DataFrame) -> DataFrame:
    """(code, month, cum120): the net flow of the last 120 days, at least 40, as of a month's last day."""
    f = along(time="day").rowsBetween(-119, 0)
    a = daily.withColumn("cum120", F.when(F.count("net_flow").over(f) >= 40, F.sum("net_flow").over(f)))
    return a.groupBy("code", F.last_day("day").alias("month")).agg(F.max_by("cum120", "day").alias("cum120"))


def consensus(reports: DataFrame, days: int = 90, named: bool = True) -> DataFrame:
    """(code, month, n_analyst, tp_median, rev_up, rev_dn, d2, d4): of the reports of the last days before a month's end.

    A revision is the sign of a target against the one before by the same analyst. d2: fewer upward revisions an analyst;
    d4: fewer analysts than in the row before. Reports without a code are left out, or a group of their own if not named. Each report is dealt to the months whose window holds it, so work is linear.
    """
    w = Window.partitionBy("code", "analyst").orderBy("pub_date", "uid")
    q = written(reports.where("code is not null and pub_date is not null" if named else "pub_date is not null").select("code", "analyst", "pub_date", "uid", "target"))
    q = dealt(q, q.count(), "code", "analyst").withColumn("rev", F.signum(F.col("target") - F.lag("target").over(w)))
    months = F.transform(F.sequence(F.lit(0), F.lit(days // 28)), lambda k: F.last_day(F.add_months(F.trunc("pub_date", "month"), k)))
    q = q.select("*", F.explode(months).alias("month")).where(F.col("pub_date") > F.date_sub("month", days))
    up, dn = (F.sum(F.coalesce((F.col("rev") * s > 0).cast("long"), F.lit(0))) for s in (1, -1))
    a = q.groupBy("code", "month").agg(F.countDistinct("analyst").alias("n_analyst"), up.alias("rev_up"), dn.alias("rev_dn"))
    middle = ranks.quantiles(q, ["code", "month"], "target", {"tp_median": 0.5}).withColumnsRenamed({"code": "__c", "month": "__m"})
    a = a.join(middle, F.col("code").eqNullSafe(F.col("__c")) & (F.col("month") == F.col("__m")), "left").drop("__c", "__m")
    return a.withColumn("d2", -safe_div(F.col("rev_up"), F.col("n_analyst"))).withColumn("d4", -(F.col("n_analyst") - F.lag("n_analyst").over(along())))


def u_score(df: DataFrame, parts: tuple[str, ...] = ("d1", "d2", "d3", "d4")) -> DataFrame:
    """df with U_raw (mean of the parts' z that are there), U_axes_used and U, its rank in the cell."""
    a = standardised(df, {f"__z_{c}": c for c in parts})
    z = [F.col(f"__z_{c}") for c in parts]
    a = a.withColumns({"U_raw": row_mean(*z), "U_axes_used": sum((c.isNotNull().cast("int") for c in z), F.lit(0))}).drop(*(f"__z_{c}" for c in parts))
    return standardised(a, {"U": "U_raw"}, xsec.rank_pct)


def live_axes(df: DataFrame, axes: list[str], least: float = 0.01) -> list[str]:
    """The axes that have values in at least this share of rows; an error if none has."""
    share = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in axes)).first()
    live = [c for c in axes if (share[c] or 0) >= least]
    if not live:
        raise ValueError("no axis has values")
    return live


def scores(df: DataFrame, sets: dict[str, list[str]], least_axes: int = 2) -> DataFrame:
    """df with E_raw, E, FLOOR, Signal and Signal_rank (over the whole month) for each set of axes, as E_raw_<name> and so on.

    Axes are standardised before their mean is taken, so that they weigh alike; a set costs columns, not another pass.
    U and VETO are used if df has them.
    """
    every = list(dict.fromkeys(c for axes in sets.values() for c in axes))
    a = standardised(df, {f"__z_{c}": c for c in every})
    a = standardised(a, {f"__p_{c}": c for c in every}, xsec.rank_pct).withColumns({f"E_raw_{k}": row_mean(*(F.col(f"__z_{c}") for c in axes)) for k, axes in sets.items()})
    a = standardised(a, {f"E_{k}": f"E_raw_{k}" for k in sets}, xsec.rank_pct)
    a = a.withColumns({f"FLOOR_{k}": xsec.floor_gate(*(F.col(f"__p_{c}") for c in axes), least=least_axes) for k, axes in sets.items()})
    u = F.coalesce("U", F.lit(0.0)) if "U" in df.columns else F.lit(0.0)
    veto = F.coalesce("VETO", F.lit(0)) if "VETO" in df.columns else F.lit(1)
    a = a.withColumns({f"Signal_{k}": F.coalesce(f"E_{k}", F.lit(0.0)) * u * veto * F.col(f"FLOOR_{k}") for k in sets})
    a = standardised(a, {f"Signal_rank_{k}": f"Signal_{k}" for k in sets}, xsec.rank_pct, ("month",), min_n=1)
    return a.drop(*(f"__{k}_{c}" for k in "zp" for c in every))


def score(df: DataFrame, axes: list[str], least_axes: int = 2) -> DataFrame:
    """scores() of one set, under plain names, with pack_profile and n_axes."""
    there = [F.col(c).isNotNull().cast("int") for c in axes]
    a = scores(df, {"0": axes}, least_axes).withColumns({"pack_profile": F.concat(*(x.cast("string") for x in there)), "n_axes": sum(there, F.lit(0))})
    return a.withColumnsRenamed({f"{c}_0": c for c in ("E_raw", "E", "FLOOR", "Signal", "Signal_rank")})


def award_months(awards: DataFrame, delay_days: int = 15) -> DataFrame:
    """(code, month, known, award, win_rate, hhi_org, n_award): the awards of a month, known so many days after its end."""
    rate = F.when(F.col("rate").between(50, 120), F.col("rate")).otherwise(safe_div(F.col("award"), F.col("plan")) * 100)
    g = awards.withColumn("__rate", rate).groupBy("code", "month", "org").agg(F.sum("award").alias("a"), F.sum("__rate").alias("r"), F.count("__rate").alias("n"), F.count("*").alias("k"))
    return g.groupBy("code", "month").agg(F.date_add("month", delay_days).alias("known"), F.sum("a").alias("award"), safe_div(F.sum("r"), F.sum("n")).alias("win_rate"), (F.sum(F.col("a") * F.col("a")) / F.pow(F.sum("a"), F.lit(2))).alias("hhi_org"), F.sum("k").alias("n_award"))


def award_features(panel: DataFrame, awards: DataFrame) -> DataFrame:
    """panel with the newest awards that were known, and q1, q2, q3: growth of 12-row sums (6 at least), and 12-row changes of rate and
    concentration."""
    a = asof_join(panel, award_months(awards), "code", "month", "known", ["award", "win_rate", "hhi_org", "n_award"], ["month"])
    f = along().rowsBetween(-11, 0)
    a = a.withColumn("__sum", F.when(F.count("award").over(f) >= 6, F.sum("award").over(f)))
    return a.withColumns({"q1": dlog(F.col("__sum"), _back("__sum")), "q2": F.col("win_rate") - _back("win_rate"), "q3": _back("hhi_org") - F.col("hhi_org")}).drop("__sum")


def procurement_axis(df: DataFrame) -> DataFrame:
    """df with TP_Q1, TP_Q2 and E_P: orders that grow, or come from more places, while the rate of winning holds."""
    a = standardised(df, {f"__z_{c}": c for c in ("q1", "q2", "q3")})
    a = a.withColumns({"TP_Q1": F.col("__z_q1") * F.col("__z_q2"), "TP_Q2": F.col("__z_q3") * F.col("__z_q2")})
    return a.withColumn("E_P", row_mean(F.col("TP_Q1"), F.col("TP_Q2"))).drop("__z_q1", "__z_q2", "__z_q3")


def words_of(text: str) -> list[str]:
    """The words of a cleaned text that have two characters at least."""
    return [w for w in text.split(" ") if len(w) >= 2]


def cleaned(text: str) -> Column:
    """The text with a space for each character that is neither letter nor digit."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", " ")


def _cosine(later: str, earlier: str) -> float | None:
    a, b = Counter(words_of(later)), Counter(words_of(earlier))
    if a and b:
        squares = [float(sum(n * n for n in c.values())) for c in (a, b)]
        return float(sum(n * b[w] for w, n in a.items() if w in b)) / math.sqrt(squares[0] * squares[1])


def text_similarity(texts: DataFrame, keys: list[str], order: str, gap: int | None = 2) -> DataFrame:
    """keys, order and sim: cosine of the word counts of each text and the one before it of the same key, if at most gap apart (None: any).

    texts: keys, order, text; an order is there once for a key. Words are letters and digits, two at least. Which texts are neighbours is
    found without the texts; then each text moves to its row and to the one after it, and words are counted where two texts have met,
    so words are never shuffled. NULL where either text has no word.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    steps = texts.select(*keys, order).withColumn("__before", F.lag(order).over(w)).where("__before is not null" if gap is None else F.col(order) - F.col("__before") <= gap)
    bare = texts.select(*keys, order, cleaned("text").alias("__text"))
    earlier = bare.select(*keys, F.col(order).alias("__before"), F.col("__text").alias("__text0"))
    # merged, as texts that look small by their columns' usual width would be sent to all tasks
    met = steps.join(bare.hint("merge"), [*keys, order], "left").join(earlier.hint("merge"), [*keys, "__before"], "left")
    schema = steps.select(*keys, order, F.lit(None).cast("double").alias("sim")).schema

    def compared(batches):
        for b in batches:
            sims = [None if x is None or y is None else _cosine(x, y) for x, y in ((x.as_py(), y.as_py()) for x, y in zip(b["__text"], b["__text0"], strict=True))]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in (*keys, order)), pa.array(sims, pa.float64())], names=schema.names)

    return met.select(*keys, order, "__text", "__text0").mapInArrow(compared, schema)
