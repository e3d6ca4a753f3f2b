"""Column expressions for cleaning and scoring. Missing is NULL; a comparison with NULL is false unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of disclosure titles and their events, in order of precedence.
DISCLOSURES = (
    ("자기주식\\s*취득", "treasury_acq"), ("자기주식\\s*처분", "treasury_disp"), ("자기주식\\s*소각|이익소각", "treasury_canc"), ("배당\\s*결정|결산배당|중간배당", "dividend"), ("유상증자", "rights_issue"),
    ("전환사채", "cb_issue"), ("신주인수권부사채", "bw_issue"), ("감자", "capital_reduce"), ("감사보고서", "audit_opinion"),
)
# Words of opinions, in order of precedence, and what stands for a missing value in a cell.
OPINIONS = (
    ("BUY", ("매수", "buy", "outperform", "비중확대", "overweight")), ("HOLD", ("중립", "hold", "neutral", "marketperform", "시장수익률", "보유", "비중유지")), ("SELL", ("매도", "sell", "underperform", "비중축소", "underweight", "reduce")),
)
NULL_TOKENS = ("", "-", "--", "0", "n/a", "na", "없음", "투자의견없음", "nr", "not rated", "제시안함")
# Words of legal forms.
LEGAL_FORMS = ("주식회사", "유한회사", "합자회사", "co", "ltd", "inc", "corp", "corporation", "company", "limited", "llc")


def clean_number(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-12, a / b)


def dlog(now: Column, before: Column) -> Column:
    return F.when((now > 0) & (before > 0), F.log(now) - F.log(before))


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which least and greatest alone would pass over."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def row_mean(*cs: Column) -> Column:
    """Mean of the values that are there; NULL if none is."""
    n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)) / n)


def mixed_date(c: Column, run_date: Column | None = None) -> Column:
    """ISO, slashes, dots and yyyyMMdd; yy.MM.dd is 20yy, or 19yy if that is beyond the year after run_date."""
    t = F.trim(c)
    year = F.lit(2000) + F.substring(t, 1, 2).try_cast("int")
    if run_date is not None:
        year = F.when(year > F.year(run_date) + 1, year - 100).otherwise(year)
    short = F.when(t.rlike(r"^\d{2}[./-]\d{2}[./-]\d{2}$"), F.concat_ws("-", year.cast("string"), F.substring(t, 4, 2), F.substring(t, 7, 2)))
    plain = F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    long = F.when(t.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"), F.regexp_replace(t, "[/.]", "-"))
    return F.coalesce(short, plain, long).try_cast("date")


def nfkc(c: Column) -> Column:
    """Compatibility forms (full width, ligatures, circled digits, squared units) as plain letters; no built-in does it."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return plain(c)


def norm_text(c: Column, compatibility: bool = False) -> Column:
    """Bracketed parts off, punctuation to blanks, blanks squeezed. Full-width ASCII becomes ASCII; with compatibility, all of NFKC."""
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F)) + "\u3000\xa0"
    s = nfkc(c) if compatibility else F.translate(c, wide, "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)) + "  ")
    s = F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_]+", " "), " +", " "))


def norm_company(c: Column, forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """Lower case, without words of legal forms (the first ones also where they are run together with the name) and blanks."""
    s = F.regexp_replace(F.lower(norm_text(c)), rf"\b({'|'.join(forms)})\b", "")
    return F.regexp_replace(F.regexp_replace(s, "|".join(f for f in forms if not f.isascii()) or r"\B\b", ""), " ", "")


def security_code(c: Column) -> Column:
    """Six digits (shorter ones padded), or digits with a letter in the sixth or fifth place of the newer form; else NULL."""
    s = F.upper(F.trim(F.split(c, r"\.").getItem(0)))
    s = F.when(s.rlike(r"^[AQ]\d{5}[0-9A-Z]$"), F.substring(s, 2, 6)).otherwise(s)
    return F.when(s.rlike(r"^\d{1,6}$"), F.lpad(s, 6, "0")).when(s.rlike(r"^\d{4}[0-9A-Z]\d$") | s.rlike(r"^\d{5}[KLMN]$"), s)


def undo_repeat(c: Column) -> Column:
    """'ABCABC' to 'ABC' for two or three repeats of eight or more characters in all."""
    n, out = F.length(c), c
    for k in (3, 2):
        part = F.substring(c, F.lit(1), (n / k).cast("int"))
        out = F.when((n >= 8) & (n % k == 0) & (F.repeat(part, F.lit(k)) == c), part).otherwise(out)
    return out


def target_price(c: Column) -> Column:
    v = F.regexp_replace(c, "[,원 ]", "").try_cast("double")
    return F.when((v > 0) & (v <= 5e7), v)


def opinion(c: Column) -> Column:
    """BUY, HOLD or SELL by the first word that is found; NULL for what stands for a missing value, else the first 20 characters."""
    t = F.lower(F.trim(c))
    out = F.substring(F.trim(c), 1, 20)
    for name, words in reversed(OPINIONS):
        for word in reversed(words):
            out = F.when(t.contains(word), name).otherwise(out)
    return F.when(~t.isin(*NULL_TOKENS), out)


def event_class(c: Column, events: tuple[tuple[str, str], ...] = DISCLOSURES) -> Column:
    """The event of the first pattern that is found; NULL if none is."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(events):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def code_in_title(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[（(]\s*([0-9]{6})\s*[)）]", 1), F.lit(""))


def name_in_title(c: Column) -> Column:
    """What stands before a code in brackets, blanks squeezed; NULL without one."""
    name = F.regexp_extract(c, r"^(.*?)[（(]\s*[0-9]{6}\s*[)）]", 1)
    return F.nullif(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit(""))


def report_fields(c: Column, head: int = 6000, price_head: int = 8000, names_length: int = 120, mails_length: int = 200) -> Column:
    """struct(names, emails, target) of a report's text, of which the first `head` characters are read for people and `price_head` for
    prices. People: the word before an address, over titles and telephone numbers, if it is a name (two to four Hangul letters), with
    that address; where there is none, names before a title and all addresses. target: the first number that follows a price word."""
    titles = ("연구원", "애널리스트")
    ranks_ = (*titles, "수석", "책임", "선임")
    glued = rf"(?<=.)(?:{'|'.join(ranks_)})$"
    is_mail = lambda w: w.rlike(r"^[\w.%+-]+@[\w.-]*\w\.[A-Za-z]{2,}$")
    is_name = lambda w: w.rlike("^[가-힣]{2,4}$") & ~w.isin(*ranks_)
    bare = lambda w: F.regexp_replace(w, glued, "")

    def people(words: Column) -> Column:
        def before(k: Column) -> Column:
            back = F.reverse(F.slice(words, F.greatest(k - 5, F.lit(1)), F.least(k, F.lit(6))))
            return bare(F.get(F.filter(back, lambda w: ~w.isin(*ranks_) & ~w.rlike(r"^[\d.+-]+$")), F.lit(0)))

        paired = F.transform(words, lambda w, k: F.when(is_mail(w) & (k > 0), F.struct(before(k).alias("name"), w.alias("mail"))))
        paired = F.filter(paired, lambda p: p.isNotNull() & F.coalesce(is_name(p["name"]), F.lit(False)))
        titled = F.transform(words, lambda w, k: F.when((F.get(words, k + 1).isin(*titles) | w.rlike(rf"..(?:{'|'.join(titles)})$")) & is_name(bare(w)), bare(w)))
        alone = F.struct(F.filter(titled, lambda w: w.isNotNull()).alias("names"), F.filter(words, is_mail).alias("mails"))
        both = F.struct(F.transform(paired, lambda p: p["name"]).alias("names"), F.transform(paired, lambda p: p["mail"]).alias("mails"))
        return F.when(F.size(paired) > 0, both).otherwise(alone)

    words = F.transform(F.split(F.substring(c, 1, head), r"[\s,;()<>]+"), lambda w: F.rtrim(w, F.lit(".")))
    found = F.get(F.transform(F.array(words), people), F.lit(0))  # bound once
    after = F.slice(F.split(F.substring(c, 1, price_head), r"(?:목표|적정)\s*주가|TP"), 2, price_head)
    prices = F.filter(F.transform(after, lambda t: F.regexp_extract(t, r"^[\s:：(원)]*([0-9][0-9,]*)", 1)), lambda n: F.length(n).between(3, 10))
    joined = lambda a, n: F.substring(F.array_join(F.array_distinct(a), ","), 1, n)
    return F.struct(joined(found["names"], names_length).alias("names"), joined(found["mails"], mails_length).alias("emails"), target_price(F.get(prices, F.lit(0))).alias("target"))


def section_cut(c: Column, pattern: str, length: int = 60_000) -> Column:
    """The text from the pattern's first place on, without tags; NULL where it isn't found."""
    plain = F.regexp_replace(c, "<[^>]+>", " ")
    at = F.regexp_instr(plain, F.lit(pattern))
    return F.when(at > 0, F.substring(plain, at, F.lit(length)))


def amount(c: Column) -> Column:
    """A number with thousands separators, and minus as a hyphen or a minus sign."""
    return F.translate(F.trim(c), "−,", "-").try_cast("double")


def knowledge_date(receipt: Column, period_end: Column, annual: Column) -> Column:
    """The receipt number's first eight digits if they are a date of this century, else 45 days after the period, 90 for a year."""
    d = F.when(receipt.rlike(r"^20\d{6}"), mixed_date(F.substring(receipt, 1, 8)))
    return F.coalesce(d, F.when(annual, F.date_add(period_end, 90)).otherwise(F.date_add(period_end, 45)))


def size_bucket(n: Column) -> Column:
    out = F.lit("unknown")
    for low, name in ((None, "<50"), (50, "50-99"), (100, "100-299"), (300, "300-999"), (1000, "1000+")):
        out = F.when(n.isNotNull() if low is None else n >= low, name).otherwise(out)
    return out


def similarity(a: Column, b: Column) -> Column:
    """0 to 100, by edit distance."""
    return 100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def impact(trade: Column, adv: Column) -> Column:
    return F.when(adv > 0, 0.10 * F.sqrt(F.least(F.lit(1.0), F.abs(trade) / adv))).otherwise(0.02)


def exit_gate(dm: Column, de: Column) -> Column:
    """True: leave. If either is unknown, hold."""
    return F.when(dm.isNotNull() & de.isNotNull(), ~((de > 0) & (dm < de))).otherwise(False)


def state_label(de: Column, dm: Column) -> Column:
    """By the changes of earnings and of the multiple; unknown counts as decline."""
    return F.when((de > 0) & (dm <= 0), "neglect").when((de > 0) & (dm > 0), "growth").when((de <= 0) & (dm > 0), "hope").otherwise("decline")


# The sales tax from each day on; before the first day its rate holds too.
SALES_TAX = (("2016-01-01", 0.0030), ("2019-06-03", 0.0025), ("2021-01-01", 0.0023), ("2023-01-01", 0.0020), ("2024-01-01", 0.0018), ("2025-01-01", 0.0015))


def sales_tax(day: Column) -> Column:
    out = F.lit(SALES_TAX[0][1])
    for start, rate in SALES_TAX[1:]:
        out = F.when(day >= F.lit(start).cast("date"), F.lit(rate)).otherwise(out)
    return out
