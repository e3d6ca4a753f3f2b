"""Statements: long accounts, as filed, to a wide point-in-time table of quarters and trailing years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.functions.exprs import amount, knowledge_date
from pitwright.operators.pit import pit_frame
from pitwright.operators.tswin import along, quarterly, rolling, streak

# Items, the kind of statement that they stand in, and patterns of account ids and of names without blanks.
ACCOUNTS = {
    "revenue": ("IS", "ifrs-full_Revenue$|^매출액$|^수익\\(매출액\\)$|^영업수익$"),
    "cogs": ("IS", "CostOfSales|^매출원가$"),
    "gross_profit": ("IS", "GrossProfit|^매출총이익"),
    "sgna": ("IS", "SellingGeneralAndAdministrativeExpense|^판매비와관리비$"),
    "rnd": ("IS", "ResearchAndDevelopmentExpense|경상(연구)?개발비|^연구개발비"),
    "tax_expense": ("IS", "IncomeTaxExpense|법인세비용"),
    "pretax_income": ("IS", "ProfitLossBeforeTax|법인세비용차감전"),
    "other_income": ("IS", "OtherIncome$|^기타수익$|^영업외수익$"),
    "op_income": ("IS", "OperatingIncomeLoss|^영업이익"),
    "net_income": ("IS", "ProfitLoss$|^당기순이익"),
    "inventory": ("BS", "Inventories|^재고자산$"),
    "receivable": ("BS", "TradeAndOtherCurrentReceivables|^매출채권"),
    "payable": ("BS", "TradeAndOtherCurrentPayables|^매입채무"),
    "assets": ("BS", "ifrs-full_Assets$|^자산총계$"),
    "liabilities": ("BS", "ifrs-full_Liabilities$|^부채총계$"),
    "equity": ("BS", "ifrs-full_Equity$|^자본총계$"),
    "ppe": ("BS", "PropertyPlantAndEquipment|^유형자산$"),
    "intangible": ("BS", "IntangibleAssetsOtherThanGoodwill|^무형자산$"),
    "cash": ("BS", "CashAndCashEquivalents|^현금및현금성자산$"),
    "contract_liab": ("BS", "ContractLiabilities|^계약부채$|^선수금$"),
    "cfo": ("CF", "CashFlowsFromUsedInOperatingActivities|^영업활동.*현금흐름"),
    "capex": ("CF", "PurchaseOfPropertyPlantAndEquipment|유형자산의?취득"),
    "dep": ("CF", "DepreciationAndAmortisationExpense|^감가상각비|감가상각비와"),
    "dividend_paid": ("CF", "DividendsPaid|배당금지급"),
    "treasury_buy": ("CF", "PaymentsToAcquireOrRedeemEntitysShares|자기주식의?취득"),
    "debt_raise": ("CF", "ProceedsFromBorrowings|차입금의?증가|사채의?발행"),
}
KINDS = {"BS": ("BS",), "IS": ("IS", "CIS"), "CF": ("CF",)}
# Codes of reports and the quarter that they end; what is counted up over a year.
REPORTS = {"11013": 1, "11012": 2, "11014": 3, "11011": 4}
FLOWS = tuple(k for k, (kind, _) in ACCOUNTS.items() if kind != "BS")
KEYS = ["corp_code", "bsns_year", "reprt_code"]


def items(kind: Column, account: Column, name: Column, accounts: dict[str, tuple[str, str]] = ACCOUNTS) -> Column:
    """Array of the items that an account is; one account may be several."""
    plain = F.regexp_replace(name, r"\s+", "")
    found = (F.when(kind.isin(*KINDS[k]) & (F.coalesce(account.rlike("(?i)" + p), F.lit(False)) | F.coalesce(plain.rlike("(?i)" + p), F.lit(False))), F.lit(item)) for item, (k, p) in accounts.items())
    return F.array_compact(F.array(*found))


def pivoted(accounts: DataFrame) -> DataFrame:
    """KEYS, rcept_no (the smallest) and a column for each item: of several accounts that are one item, the largest in absolute
    terms. Accounts that are no item go before the one shuffle. accounts: KEYS, sj_div, account_id, account_nm, thstrm_amount, rcept_no."""
    a = accounts.select(*KEYS, "rcept_no", amount(F.col("thstrm_amount")).alias("a"), items(F.col("sj_div"), F.col("account_id"), F.col("account_nm")).alias("is")).where("a is not null and size(`is`) > 0")
    best = lambda k: F.max(F.when(F.array_contains("is", k), F.struct(F.abs("a").alias("size"), F.col("a")))).getField("a").alias(k)
    return a.groupBy(*KEYS).agg(F.min("rcept_no").alias("rcept_no"), *map(best, ACCOUNTS))


def tidy(accounts: DataFrame) -> DataFrame:
    """A row for each corp_code and quarter with both dates, all items, <flow>_q and <flow>_ttm (four rows), and v2_bad_3q: three rows in
    which profit is over twice the cash flow."""
    quarter = F.lit(None).cast("int")
    for code, q in REPORTS.items():
        quarter = F.when(F.col("reprt_code") == code, q).otherwise(quarter)
    a = pivoted(accounts).withColumn("q", quarter).where("q is not null")
    a = a.withColumn("period_end", F.last_day(F.make_date(F.col("bsns_year").cast("int"), F.col("q") * 3, F.lit(1))))
    for c in FLOWS:
        a = quarterly(a, c, f"{c}_q", ["corp_code"], "bsns_year", "q")
    w = along("corp_code", "period_end")
    a = a.withColumns({f"{c}_ttm": rolling(f"{c}_q", F.sum, w, 4, 4) for c in FLOWS})
    bad = F.coalesce((F.col("net_income_ttm") > 0) & (F.col("cfo_ttm") < 0.5 * F.col("net_income_ttm")), F.lit(False)).cast("double")
    a = a.withColumn("__bad", bad).withColumn("v2_bad_3q", streak(F.col("__bad"), w)).drop("__bad")
    return pit_frame(a, F.col("period_end"), knowledge_date(F.col("rcept_no"), F.col("period_end"), F.col("q") == 4), "statements")
