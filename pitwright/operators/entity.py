"""Names, authors and codes of reports: cleaning, links with their method, and audits of what is linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwright.functions.exprs import code_in_title, norm_company, security_code

# Titles beside an author's name, words between or after names, words of houses, and how sure a link by each method is.
TITLES = ("연구원", "애널리스트", "수석", "책임", "선임", "팀장", "센터장", "위원", "박사")
BETWEEN = ("외", "및")
HOUSE_WORDS = ("증권", "투자", "금융", "리서치")
SUFFIXES = ("리서치센터", "리서치", "투자정보", "Research")
CONFIDENCE = {"list_field": 0.98, "pdf_header": 0.80}


def canonical(c: Column, aliases: list[tuple[str, str]], suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The name of the first alias pattern (a short list) that is found in the text without blanks; else that text without the first
    suffix that it ends with. An empty text is NULL."""
    bare = F.regexp_replace(c, r"\s+", "")
    named = F.coalesce(*(F.when(bare.rlike(pattern), F.lit(name)) for pattern, name in aliases), F.lit(None).cast("string"))
    shorter = F.coalesce(*(F.when(bare.endswith(x) & (F.length(bare) > len(x)), F.left(bare, F.length(bare) - len(x))) for x in suffixes), bare)
    return F.coalesce(named, F.nullif(shorter, F.lit("")))


def house_id(canon: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", F.lit("broker"), canon).cast("binary")), 1, 12)


def authors(c: Column, titles: tuple[str, ...] = TITLES) -> Column:
    """Array of authors' names (2 to 12 letters), in order, each once.

    The text is cut into fields at punctuation, at wide gaps and at words that stand between names; bracketed parts are cut out.
    A name is the letters of its field's words, of which titles (alone or run together with the name) and counts are none.
    """
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*?\)", ";")
    fields = F.split(F.regexp_replace(flat, rf"(?<=^|\s)(?:{'|'.join(BETWEEN)})(?=\s|$)", ";"), r"[,/·∙•|;]|\s\s+")
    title = rf"(?:{'|'.join(titles)})+$"

    def name(field: Column) -> Column:
        words = F.filter(F.split(F.trim(field), r"\s"), lambda w: ~w.rlike(r"^\d+인?$"))
        return F.array_join(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, title, ""), r"[^\p{IsHangul}A-Za-z]", "")), "")

    is_house = rf"^(?:{'|'.join(HOUSE_WORDS)})+$"
    return F.array_distinct(F.filter(F.transform(fields, name), lambda n: F.length(n).between(2, 12) & ~n.rlike(is_house)))


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)))


def author_links(reports: DataFrame) -> DataFrame:
    """(uid, analyst_id, name, broker, role, method, confidence, code, pub_date, target): a row for each author of a report.

    reports: uid, broker, author_list (preferred), author_found (a comma between names), code, pub_date, target. A name is one
    person within a broker; the first author leads.
    """
    listed = authors(F.col("author_list"))
    found = F.filter(F.transform(F.split(F.coalesce("author_found", F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != "")
    method = F.when(F.size(listed) > 0, "list_field").when(F.size(found) > 0, "pdf_header")
    a = reports.select("uid", "broker", "code", "pub_date", "target", method.alias("method"), F.posexplode(F.when(F.size(listed) > 0, listed).otherwise(found)).alias("place", "name"))
    name = F.regexp_replace("name", r"\s+", "")
    sure = F.when(F.col("method") == "list_field", CONFIDENCE["list_field"]).otherwise(CONFIDENCE["pdf_header"])
    ident = F.substring(F.sha1(F.concat_ws("\x1f", F.lit("analyst"), F.col("broker"), name).cast("binary")), 1, 14)
    return a.select("uid", ident.alias("analyst_id"), name.alias("name"), "broker", F.when(F.col("place") == 0, "lead").otherwise("co").alias("role"), "method", sure.alias("confidence"), "code", "pub_date", "target")


def author_master(links: DataFrame) -> DataFrame:
    """A row for each author; ambiguous: the name is there at more than one broker."""
    a = links.groupBy("analyst_id", "name", "broker").agg(F.min("pub_date").alias("first_seen"), F.max("pub_date").alias("last_seen"), F.countDistinct("uid").alias("n_reports"), F.countDistinct("code").alias("n_stocks"), F.count("target").alias("n_targets"))
    return a.withColumn("ambiguous", F.count("*").over(Window.partitionBy("name")) > 1)


def linkage_audit(reports: DataFrame, links: DataFrame, by: dict[str, Column]) -> DataFrame:
    """(grouping, value, n, with_author, with_code, with_target, confidence, authors): for each value of each grouping (by: name to a
    column of reports, or of links: method) the number of reports, the shares of them with an author, a code and a target, the mean
    confidence of their links and the number of authors. All groupings come from one pass."""
    of_report = links.groupBy("uid").agg(F.min("method").alias("method"), F.avg("confidence").alias("confidence"), F.collect_set("analyst_id").alias("who"))  # the authors of a report
    linked = reports.join(of_report, "uid", "left").select("code", "target", "method", "confidence", F.posexplode_outer("who").alias("place", "analyst_id"), *(e.cast("string").alias(f"__by_{k}") for k, e in by.items()))
    a = linked.withColumn("confidence", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("confidence")))
    one = F.coalesce("place", F.lit(0)) == 0  # one row for each report
    share = lambda c: F.count_if(one & F.col(c).isNotNull()) / F.count_if(one)
    columns = [F.col(f"__by_{k}") for k in by]
    sets = a.groupingSets([[c] for c in columns], *columns)
    of = F.grouping_id(*columns)
    out = sets.agg(of.alias("__set"), F.count_if(one).alias("n"), share("place").alias("with_author"), share("code").alias("with_code"), share("target").alias("with_target"), F.avg("confidence").alias("confidence"), F.countDistinct("analyst_id").alias("authors"))
    name, whole = F.lit(None).cast("string"), (1 << len(by)) - 1
    for i, k in enumerate(by):
        name = F.when(F.col("__set") == whole - (1 << (len(by) - 1 - i)), k).otherwise(name)
    return out.select(name.alias("grouping"), F.coalesce(*columns).alias("value"), "n", "with_author", "with_code", "with_target", "confidence", "authors")


def name_match(left: DataFrame, right: DataFrame, name: str, code: str) -> DataFrame:
    """left with the smallest code of the right's rows whose normalised name (of two letters or more) is the same."""
    key = norm_company(F.col(name))
    r = right.select(key.alias("__k"), F.col(code)).where(F.length("__k") >= 2).groupBy("__k").agg(F.min(code).alias(code))
    return left.withColumn("__k", key).join(r, "__k", "left").drop("__k")


def code_cascade(reports: DataFrame, names: DataFrame, source: str, title: str, name: str, code: str) -> DataFrame:
    """reports with code and code_from: the source's own code, else one in brackets in the title, else that of the name. names: name, code."""
    own, told = security_code(F.col(source)), security_code(code_in_title(F.col(title)))
    a = name_match(reports, names.withColumnRenamed(code, "__named"), name, "__named")
    found = F.when(own.isNotNull(), "source").when(told.isNotNull(), "title").when(F.col("__named").isNotNull(), "name")
    return a.withColumns({code: F.coalesce(own, told, F.col("__named")), "code_from": found}).drop("__named")


def matches(left: DataFrame, right: DataFrame, securities: DataFrame, name: str, code: str, first: str, last: str, **options) -> DataFrame:
    """(name, code, method, score, valid_from, valid_to): the exact match of a normalised name, else the best one by edits.

    A match can't be older than the security, nor outlive it: the days on which the name was seen (first and last) are clamped to
    listing and delisting. left: name, first, last; right: name, code; securities: code, listing_date, delisting_date.
    """
    from pitwright.operators.ledger import fuzzy_match

    seen = left.groupBy(name).agg(F.min(first).alias("__first"), F.max(last).alias("__last")).withColumn("__key", norm_company(F.col(name)))
    exact = name_match(seen, right, name, code)
    known = right.select(norm_company(F.col(name)).alias("__key"), code).where(F.length("__key") >= 2)
    near = fuzzy_match(exact.where(F.col(code).isNull()).select("__key"), known, "__key", code, **options).withColumnRenamed(code, "__near")
    a = exact.join(near, "__key", "left").withColumns({"score": F.when(F.col(code).isNotNull(), F.lit(100.0)).otherwise(F.col("score")), code: F.coalesce(F.col(code), F.col("__near"))}).where(F.col(code).isNotNull())
    a = a.join(securities.select(code, "listing_date", "delisting_date"), code, "left")
    method = F.when(F.col("score") >= 99.9, "exact_name").otherwise("fuzzy_name")
    return a.select(name, code, method.alias("method"), "score", F.greatest("__first", "listing_date").alias("valid_from"), F.least("__last", "delisting_date").alias("valid_to"))


def extended(mapping: DataFrame, newest: DataFrame, end: str = "valid_to") -> DataFrame:
    """mapping with ends before the newest month moved up to it: forward only. newest: one row, column month."""
    return mapping.crossJoin(F.broadcast(newest.select(F.col("month").alias("__newest")))).withColumn(end, F.greatest(end, "__newest")).drop("__newest")
