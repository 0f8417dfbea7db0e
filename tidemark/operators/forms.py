"""Fields of exchange forms and accounts of statements, read in bulk by patterns; what cannot be read is kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the delisting form.
CODE, CAUSE, ISIN, DELISTED_ON = "단축코드", "상장폐지 사유", "종목코드", "상장폐지일"
LIQUIDATION, STARTS, ENDS = "정리매매 ?(?:허용)?기간", "시작일", ("종료일", "만료일")

# Statement labels and element ids of each fact.
LABELS = {
    "sales": ("매출액", "매출", "영업수익", "수익"),
    "gross_profit": ("매출총이익", "매출총손익"),
    "operating_profit": ("영업이익", "영업손익"),
    "net_income": ("당기순이익", "당기순손익", "분기순이익", "분기순손익", "반기순이익", "지배기업소유주지분순이익"),
    "assets": ("자산총계", "자산총액", "자산계"),
    "equity": ("자본총계", "자본총액", "자본계"),
    "debt": ("부채총계", "부채총액", "부채계"),
    "cash": ("현금및현금성자산", "기말현금및현금성자산"),
    "operating_cash_flow": ("영업활동현금흐름", "영업활동으로인한현금흐름", "영업활동으로인한순현금흐름"),
    "capex": ("유형자산취득", "자본적지출", "설비투자", "유형자산의취득", "유무형자산취득"),
}
IDS = {
    "sales": ("ifrs-full_Revenue", "ifrs-full_RevenueFromContractsWithCustomers", "ifrs-full_SalesRevenue", "dart_Revenue"),
    "gross_profit": ("ifrs-full_GrossProfit",),
    "operating_profit": ("ifrs-full_OperatingProfit", "ifrs-full_OperatingIncome", "dart_OperatingIncome"),
    "net_income": ("ifrs-full_ProfitLoss", "ifrs-full_ProfitLossAttributableToOwnersOfParent", "ifrs-full_ProfitLossAttributableToOwners", "ifrs-full_ComprehensiveIncome"),
    "assets": ("ifrs-full_Assets",),
    "equity": ("ifrs-full_Equity", "ifrs-full_EquityAttributableToOwnersOfParent"),
    "debt": ("ifrs-full_Liabilities",),
    "cash": ("ifrs-full_CashAndCashEquivalents",),
    "operating_cash_flow": ("ifrs-full_CashFlowsFromOperatingActivities", "ifrs-full_CashFlowsFromUsedInOperatingActivities", "ifrs-full_NetCashFlowsFromOperatingActivities"),
    "capex": ("ifrs-full_PaymentsToAcquirePropertyPlantAndEquipment", "ifrs-full_PaymentsToAcquireIntangibleAssets"),
}


def _named(key: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return reduce(lambda out, item: F.when(key.isin(*item[1]), item[0]).otherwise(out), names.items(), F.lit(None).cast("string"))


def statement_label(label: Column) -> Column:
    """A label without white space, a note's reference at its end, enumerators before it, and brackets around all of it."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", ""), r"\(주석[^)]*\)$", "")
    bare = F.regexp_replace(plain, r"^(?:[(\[]?(?:[IVXLCDMⅠ-Ⅻ]+|\d+|[가-하])[.)])+", "")
    return F.regexp_replace(bare, r"^[(\[]([^()\[\]]*)[)\]]$", "$1")


def account_fact(account_id: Column, label: Column) -> Column:
    """The fact of a statement's row by its element id, or else by its label; NULL for others."""
    return F.coalesce(_named(F.trim(F.coalesce(account_id, F.lit(""))), IDS), _named(statement_label(label), LABELS))


def _dated(text: Column, label: str) -> tuple[Column, Column]:
    """(the date within forty signs of a label's first place, whether a dash stands there instead)."""
    after = F.regexp_extract(text, rf"(?s){label}(.{{0,40}})", 1)
    parts = [F.regexp_extract(after, r"(\d{4})(?:[-.]|년) ?(\d{1,2})(?:[-.]|월) ?(\d{1,2})", i) for i in (1, 2, 3)]
    day = F.when(parts[0] != "", F.try_to_timestamp(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))
    return day, F.ltrim(after).rlike(r"^[-–—]")


def _once(rows: DataFrame) -> DataFrame:
    """rows by a generator of one row each: what follows reads its columns and does not compute their patterns again."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def delisting_forms(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms (notice, tickers, liquidation_start, liquidation_end, delisting_date), unread (notice, reason)) of HTML bodies (notice, html).

    Codes are the A-prefixed ones between their label and the cause, or else those of ISINs. A dash for the day is a decision without an
    end. Unread is a form without a code or without a day, and one that states a start of liquidation without an end, or the reverse.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), "&nbsp;|&#160;", " ")
    section = F.regexp_extract("text", rf"(?s){CODE}(.*?)(?:{CAUSE}|\z)", 1)
    short = F.array_distinct(F.regexp_extract_all(section, F.lit(r"(?<![0-9A-Za-z])A([0-9A-Z]{6})(?![0-9A-Za-z])"), F.lit(1)))
    isin = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"{ISIN}\s*:?\s*KR7([0-9A-Z]{{6}})[0-9]{{3}}"), F.lit(1)))
    read = _once(bodies.select("notice", text.alias("text")))
    read = _once(read.select("notice", "text", F.when(F.size(short) > 0, short).otherwise(isin).alias("tickers")))
    day, dash = _dated(F.col("text"), DELISTED_ON)
    liquidation = F.regexp_extract("text", rf"(?s){LIQUIDATION}(.*?)(?:{DELISTED_ON}|\z)", 1)
    read = _once(read.withColumns({"delisting_date": F.when(~dash, day), "open": dash, "section": liquidation}).drop("text"))
    start, end = _dated(F.col("section"), STARTS)[0], F.coalesce(*(_dated(F.col("section"), e)[0] for e in ENDS))
    read = _once(read.withColumns({"liquidation_start": start, "liquidation_end": end}).drop("section"))
    reason = (
        F.when(F.size("tickers") == 0, "no_code").when(F.col("delisting_date").isNull() & ~F.col("open"), "no_day")
        .when(F.col("liquidation_start").isNull() != F.col("liquidation_end").isNull(), "half_a_period")
    )
    judged = read.withColumn("reason", reason)
    return judged.where("reason is null").select("notice", "tickers", "liquidation_start", "liquidation_end", "delisting_date"), judged.where("reason is not null").select("notice", "reason")
