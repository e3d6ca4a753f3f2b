"""Tests of a plan: many arms in one fold, and small tables of verdicts. panel: code, month, signal, fwd_ret and what an arm needs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.operators import xsec
from pitwright.operators.tswin import along, hac_t
from pitwright.plans import axes as A
from pitwright.plans import portfolio


def arms_of(panel: DataFrame, signals: dict[str, Column], only: dict[str, Column] | None = None) -> DataFrame:
    """panel once for each arm, with arm and its signal: the panel is computed once, whatever the number of arms. only: an arm's rows."""
    made = [F.when((only or {}).get(name, F.lit(True)), F.struct(F.lit(name).alias("arm"), signal.cast("double").alias("signal"))) for name, signal in signals.items()]
    spread = panel.withColumn("__arms", F.array_compact(F.array(*made))).drop("arm", "signal")
    return spread.select("*", F.explode("__arms").alias("__arm")).select(*(c for c in spread.columns if c != "__arms"), "__arm.*")


def leak_arms(panel: DataFrame) -> DataFrame:
    """The plan, one that knows the future (rank of the coming return), and the plan's signal one row early."""
    known = xsec.rank_pct(panel, "fwd_ret", "month", "__future", min_n=1).withColumn("__early", F.lead("signal").over(along()))
    return arms_of(known, {"base": F.col("signal"), "oracle": F.coalesce("__future", "signal"), "early": F.col("__early")}).drop("__future", "__early")


def ablation_arms(panel: DataFrame, axes: list[str], least: int = 2) -> DataFrame:
    """The plan with all axes, and without each in turn where at least `least` are left; every arm is scored the same way."""
    sets = {"all": axes} | {f"without_{a}": [x for x in axes if x != a] for a in axes if len(axes) - 1 >= least}
    return arms_of(A.scores(panel, sets, least), {k: F.col(f"Signal_rank_{k}") for k in sets})


def keyed_noise(seed: int) -> Column:
    """A number in (0, 1) from the row's code and month: the same in any engine and whatever the partitions."""
    text = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("code"), F.col("month"))), 1, 5)
    return (F.conv(text, 16, 10).cast("double") + 0.5) / (1 << 20)


def noise_arms(panel: DataFrame, seeds: list[int], axes: list[str], least: int = 2) -> DataFrame:
    """The plan against arms whose E is the rank of noise, with the plan's own FLOOR, U and VETO, so that all arms choose from equally
    many rows."""
    a = A.scores(panel, {"base": axes}, least).withColumns({f"__n{s}": keyed_noise(s) for s in seeds})
    a = A.standardised(a, {f"__e{s}": f"__n{s}" for s in seeds}, xsec.rank_pct)
    rest = F.coalesce("U", F.lit(0.0)) * F.coalesce("VETO", F.lit(0)) * F.col("FLOOR_base")
    a = a.withColumns({f"__s{s}": F.coalesce(f"__e{s}", F.lit(0.0)) * rest for s in seeds})
    a = A.standardised(a, {f"__r{s}": f"__s{s}" for s in seeds}, xsec.rank_pct, ("month",), min_n=1)
    shown = lambda signal, rank: F.when(F.col(signal) > 0, F.col(rank))
    made = arms_of(a, {"base": shown("Signal_base", "Signal_rank_base")} | {f"noise_{s}": shown(f"__s{s}", f"__r{s}") for s in seeds})
    return made.drop(*(f"__{k}{s}" for k in "nesr" for s in seeds))


def product_arms(panel: DataFrame, products: list[str], plain: list[str], least: int = 2) -> DataFrame:
    """R2: the plan from products of pairs against one from their first members alone; each arm makes its E and FLOOR from its own."""
    a = A.scores(panel, {"product": products, "plain": plain}, least)
    return arms_of(a, {k: F.when(F.col(f"Signal_{k}") > 0, F.col(f"Signal_rank_{k}")) for k in ("product", "plain")})


def clean_month_arms(panel: DataFrame, masked: DataFrame) -> DataFrame:
    """The plan over all months and over those that no window masks; masked: month and masked, a short list."""
    a = panel.join(F.broadcast(masked.select("month", "masked")), "month", "left")
    return arms_of(a, {"full": F.col("signal"), "clean": F.col("signal")}, {"clean": F.coalesce("masked", F.lit(0)) == 0}).drop("masked")


def firing(panel: DataFrame, masked: DataFrame, at: float = 0.95) -> DataFrame:
    """(masked, months, rate): the mean share of a month's rows whose signal is above `at`, within windows and outside."""
    m = panel.groupBy("month").agg(F.avg(F.coalesce((F.col("signal") > at).cast("double"), F.lit(0.0))).alias("share"))
    return m.join(F.broadcast(masked), "month").groupBy("masked").agg(F.count("*").alias("months"), F.avg("share").alias("rate"))


def run(arms: DataFrame, exits: Column | None = None, **options) -> DataFrame:
    """The fold of all arms in one job: picks of each month, then only the codes that an arm ever picks. Flags are made by windows, so the
    arms are computed once."""
    gone = [c for c in ("delisting_date",) if c in arms.columns]
    a = arms.select("arm", "month", "code", "signal", (F.lit(0) if exits is None else exits.cast("int")).alias("exits"), F.col("adv20").alias("adv"), "fwd_ret", *gone)
    a = portfolio.flagged(a, ["arm"], "signal").withColumn("__ever", F.max("picked").over(Window.partitionBy("arm", "code"))).where("__ever = 1")
    return portfolio.backtest(a.drop("__ever"), **options)


def compared(returns: DataFrame, base: str, r: str = "ret", per_year: int = 12) -> DataFrame:
    """(arm, n, names, mean_ret, sharpe, delta): each arm's Sharpe ratio, and how far it is above the base arm's."""
    s = returns.groupBy("arm").agg(F.count("*").alias("n"), F.avg("names").alias("names"), F.avg(r).alias("mean_ret"), F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * per_year**0.5).alias("sharpe"))
    at = F.max(F.when(F.col("arm") == base, F.col("sharpe"))).over(Window.partitionBy())  # a row for each arm
    return s.withColumn("delta", F.col("sharpe") - at)


def _one_row(tests: DataFrame, name: str, passed: Column, kill: bool, metrics: list[str]) -> DataFrame:
    pairs = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*(F.col(c).cast("double") for c in metrics)))
    return tests.select(F.lit(name).alias("test"), passed.alias("passed"), F.lit(kill).alias("kill"), pairs.alias("metrics"))


def _by_arm(table: DataFrame, arms: list[str], columns: list[str]) -> DataFrame:
    """One row with <column>_<arm>."""
    return table.agg(*(F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for a in arms for c in columns))


def leak_verdict(table: DataFrame, at: float = 0.5, least_names: float = 0.5) -> DataFrame:
    """Knowing the future must add over `at` to the Sharpe ratio; undecided if that arm holds hardly any names. table: compared()."""
    t = _by_arm(table, ["base", "oracle", "early"], ["sharpe", "names"])
    added = F.coalesce(F.col("sharpe_oracle") - F.col("sharpe_base") > at, F.lit(False))
    return _one_row(t, "R1", F.when(F.col("names_oracle") >= least_names, added), False, ["sharpe_base", "sharpe_oracle", "sharpe_early"])


def paired_verdict(returns: DataFrame, table: DataFrame, better: str, worse: str, name: str = "R2", least_t: float = 1.0, kill: bool = True, r: str = "ret") -> DataFrame:
    """R2: an arm beats another one if the Newey-West t of the monthly differences is over least_t and its Sharpe ratio is higher."""
    pair = returns.groupBy("month").agg(*(F.max(F.when(F.col("arm") == a, F.coalesce(r, F.lit(0.0)))).alias(k) for a, k in ((better, "a"), (worse, "b")))).where("a is not null and b is not null")
    t = hac_t(pair.select(F.lit(1).alias("__one"), "month", (F.col("a") - F.col("b")).alias("d")), "d", ["__one"], "month").select("t")
    both = _by_arm(table, [better, worse], ["sharpe"]).crossJoin(F.broadcast(t.agg(F.max("t").alias("t"))))
    won = F.coalesce((F.col("t") > least_t) & (F.col(f"sharpe_{better}") > F.col(f"sharpe_{worse}")), F.lit(False))
    return _one_row(both, name, won, kill, [f"sharpe_{better}", f"sharpe_{worse}", "t"])


def policy_verdict(table: DataFrame, least_months: int = 24) -> DataFrame:
    """Kept if the clean months earn, with at least half of the Sharpe ratio of all; undecided below least_months clean ones."""
    t = _by_arm(table, ["full", "clean"], ["sharpe", "mean_ret", "n"])
    kept = (F.col("sharpe_clean") > 0) & (F.col("mean_ret_clean") > 0) & (F.col("sharpe_full").isNull() | (F.col("sharpe_clean") >= 0.5 * F.col("sharpe_full")))
    return _one_row(t, "R10", F.when(F.col("n_clean") >= least_months, F.coalesce(kept, F.lit(False))), False, ["sharpe_full", "sharpe_clean", "n_clean"])


def placebo_p(draws: DataFrame, real: float, r: str = "mean_ret") -> DataFrame:
    """(n, p): the share of random selections that earn at least as much as the plan."""
    return draws.agg(F.count("*").alias("n"), F.avg((F.col(r) >= real).cast("double")).alias("p"))


def cost_survival(returns: DataFrame) -> DataFrame:
    """Each arm before and after costs, from the one fold, which keeps both."""
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("basis"), F.col(c).alias("r")) for k, c in (("gross", "ret_gross"), ("net", "ret"))))).alias("x")
    return returns.select("arm", both).select("arm", "x.*").groupBy("arm", "basis").agg(F.count("*").alias("n"), F.avg("r").alias("mean_ret"), F.when(F.stddev_samp("r") > 0, F.avg("r") / F.stddev_samp("r") * 12**0.5).alias("sharpe"))


def factor_returns(panel: DataFrame, factors: list[str], least_rows: int = 30, least: int = 11) -> DataFrame:
    """(month, factor, ret): the mean return weighted by z above the month's least, over the plain mean. panel: cell, fwd_ret, factors."""
    a = panel.withColumn("__rows", F.count("*").over(Window.partitionBy("month"))).where(F.col("__rows") >= least_rows)
    a = xsec.zscores(a, {f"__z_{f}": f for f in factors}, ["cell"])
    long = a.select("month", "fwd_ret", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"__z_{f}").alias("z")) for f in factors))).alias("x")).select("month", "fwd_ret", "x.*")
    ok = long.where("z is not null and fwd_ret is not null")
    # weights are z - min(z) + 1e-9: sums of r, z and z r are enough
    s = ok.groupBy("month", "factor").agg(F.count("*").alias("n"), F.sum("fwd_ret").alias("r"), F.sum("z").alias("z"), F.sum(F.col("z") * F.col("fwd_ret")).alias("zr"), (1e-9 - F.min("z")).alias("up"))
    weighted = (F.col("zr") + F.col("up") * F.col("r")) / (F.col("z") + F.col("up") * F.col("n"))
    return s.where(F.col("n") >= least).select("month", "factor", (weighted - F.col("r") / F.col("n")).alias("ret"))


def alpha(returns: DataFrame, factor_table: DataFrame, factors: list[str], least: int = 24) -> DataFrame:
    """(arm, n, alpha, t): the intercept of an arm's returns on those of the factors, by least squares over a row for each month, and
    the Newey-West t of what the factors leave (intercept and residual)."""
    wide = factor_table.groupBy("month").pivot("factor", factors).agg(F.first("ret")).dropna()
    a = returns.join(wide, "month").select("arm", "month", "ret", *factors)
    x, k = [*factors, "ret"], len(factors)
    # sums of products about the means, a row for each arm
    means = a.groupBy("arm").agg(F.count("*").alias("__n"), *(F.avg(c).alias(f"__m_{c}") for c in x))
    off = lambda c: F.col(c) - F.col(f"__m_{c}")
    s = a.join(means, "arm").groupBy("arm", "__n").agg(*(F.sum(off(x[i]) * off(x[j])).alias(f"__s{j}{i}") for i in range(k + 1) for j in range(i, k + 1)))
    # Cholesky, column by column: l[j][i] for j >= i; a factor that others make up has no pivot, and no part in the fit
    for i in range(k):
        pivot = F.col(f"__s{i}{i}") - sum((F.col(f"__l{i}{m}") * F.col(f"__l{i}{m}") for m in range(i)), F.lit(0.0))
        s = s.withColumn(f"__l{i}{i}", F.when(pivot > 1e-12 * F.col(f"__s{i}{i}"), F.sqrt(F.greatest(pivot, F.lit(0.0)))))
        for j in range(i + 1, k + 1):
            rest = F.col(f"__s{j}{i}") - sum((F.col(f"__l{j}{m}") * F.col(f"__l{i}{m}") for m in range(i)), F.lit(0.0))
            s = s.withColumn(f"__l{j}{i}", F.coalesce(rest / F.col(f"__l{i}{i}"), F.lit(0.0)))
    for i in reversed(range(k)):
        known = sum((F.col(f"__l{m}{i}") * F.col(f"__b{m}") for m in range(i + 1, k)), F.lit(0.0))
        s = s.withColumn(f"__b{i}", F.coalesce((F.col(f"__l{k}{i}") - known) / F.col(f"__l{i}{i}"), F.lit(0.0)))
    fit = sum((F.col(f"__b{i}") * F.col(f) for i, f in enumerate(factors)), F.lit(0.0))
    rest = a.join(s.select("arm", "__n", *(f"__b{i}" for i in range(k))), "arm").select("arm", "month", F.when(F.col("__n") >= least, F.col("ret") - fit).alias("left"))
    t = hac_t(rest, "left", ["arm"], "month").select("arm", "t")
    return rest.groupBy("arm").agg(F.count("*").alias("n"), F.avg("left").alias("alpha")).join(t, "arm", "left")


def block_pbo(returns: DataFrame, r: str = "ret", blocks: int = 8) -> DataFrame:
    """(arm, blocks, pbo): the share of blocks of months, each once held out, that lose while the rest gains.

    The first blocks are one month longer where the months don't divide evenly; NULL below six months a block.
    """
    w = Window.partitionBy("arm").orderBy("month")
    n = F.count("*").over(Window.partitionBy("arm"))
    a = returns.select("arm", F.coalesce(r, F.lit(0.0)).alias("r"), (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    short, extra = F.floor(F.col("n") / blocks), F.col("n") % blocks
    long = extra * (short + 1)
    a = a.withColumn("b", F.when(F.col("i") < long, F.floor(F.col("i") / (short + 1))).otherwise(extra + F.floor((F.col("i") - long) / F.greatest(short, F.lit(1)))))
    s = a.groupBy("arm", "n", "b").agg(F.sum("r").alias("s"))
    s = s.withColumn("rest", F.sum("s").over(Window.partitionBy("arm")) - F.col("s"))
    return s.groupBy("arm", "n").agg(F.count("*").alias("blocks"), F.avg(((F.col("rest") > 0) & (F.col("s") <= 0)).cast("double")).alias("pbo")).select("arm", "blocks", F.when(F.col("n") >= 6 * blocks, F.col("pbo")).alias("pbo"))


def normal_share(z: Column, terms: int = 150) -> Column:
    """The share of a standard normal distribution below z, to about 1e-15: its density times x + x^3 / 3 + x^5 / 15 + ..., whose terms all
    have one sign, within 8.5 deviations of 0."""
    x = F.greatest(F.lit(-8.5), F.least(F.lit(8.5), z))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda s: s["total"])
    return F.when(z.isNotNull(), 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total)


def deflated_sharpe(returns: DataFrame, r: str = "ret", trials: int = 12) -> DataFrame:
    """(arm, n, sharpe, dsr): the chance that a month's Sharpe ratio beats the best of so many trials without skill."""
    s = returns.select("arm", F.coalesce(r, F.lit(0.0)).alias("r")).groupBy("arm").agg(F.count("*").alias("n"), (F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sharpe"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    k, e = max(trials, 2), 0.5772156649
    best = math.sqrt(2 * math.log(k)) * (1 - e) + e * math.sqrt(2 * math.log(k * math.e))
    sr = F.col("sharpe")
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr))
    x = F.when(F.col("n") >= 12, (sr - best / F.sqrt("n")) * F.sqrt(F.col("n") - 1) / spread)

    return s.select("arm", "n", "sharpe", normal_share(x).alias("dsr"))


def regimes(returns: DataFrame, market: DataFrame, r: str = "ret", least: int = 6, split: str = "2024-01-01") -> DataFrame:
    """(arm, regime, n, mean_ret, hit_rate) of months when the market rose or fell, of the first and second half, and before and from
    a day.

    market: month and up (boolean), a short list.
    """
    w = Window.partitionBy("arm")
    i, n = F.row_number().over(w.orderBy("month")) - 1, F.count("*").over(w)
    a = returns.withColumn("half", F.when(i < F.floor(n / 2), "first_half").otherwise("second_half")).join(F.broadcast(market), "month", "left")
    a = a.select("arm", F.col(r).alias("r"), F.explode(F.array("half", F.when(F.col("up"), "market_up").when(~F.col("up"), "market_down"), F.when(F.col("month") < F.lit(split).cast("date"), "before").otherwise("from"))).alias("regime")).where("regime is not null")
    return a.groupBy("arm", "regime").agg(F.count("*").alias("n"), F.avg("r").alias("mean_ret"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate")).where(F.col("n") >= least)


def verdicts(tests: DataFrame, passed: Column, kill: bool, name: str) -> DataFrame:
    """(test, subject, passed, kill, metrics): passed is NULL where a test can't decide. tests: subject first, then numbers."""
    subject, *numbers = tests.columns
    metrics = F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*(F.col(c).cast("double") for c in numbers)))
    return tests.select(F.lit(name).alias("test"), F.col(subject).alias("subject"), passed.alias("passed"), F.lit(kill).alias("kill"), metrics.alias("metrics"))
