"""Delisting forms and statement accounts by patterns, on bodies written by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forms

BODIES = {
    "full": "<html><td>단축코드</td><td>A005930</td><td>상장폐지 사유</td><td>A111111 감사의견</td><p>상장폐지 예고기간 시작일 2020-01-01 종료일 2020-01-05</p><p>정리매매 허용기간<br>시작일 : 2020-02-03&nbsp;종료일 : 2020.02.11</p><p>상장폐지일 : 2020년 2월 12일</p>",
    "kosdaq": "단축코드 A035720, A035720 A0001A0 상장폐지 사유 정리매매기간 시작일 2019.12.02 만료일 2019.12.10 상장폐지일 2019.12.11",
    "open": "종목코드 : KR7200050003 상장폐지일 - ",
    "no code": "단축코드 없음 상장폐지 사유 A005930 상장폐지일 2020-01-01",
    "no day": "단축코드 A005930 상장폐지 사유 상장폐지일 미정",
    "half": "단축코드 A005930 상장폐지 사유 정리매매 허용기간 시작일 2020-01-02 상장폐지일 2020-01-09",
    "none": None,
}


def test_delisting_forms(spark):
    read, unread = forms.delisting_forms(spark.createDataFrame(list(BODIES.items()), "notice string, html string"))
    assert {r.notice: (r.tickers, r.liquidation_start, r.liquidation_end, r.delisting_date) for r in read.collect()} == {
        "full": (["005930"], date(2020, 2, 3), date(2020, 2, 11), date(2020, 2, 12)), "kosdaq": (["035720", "0001A0"], date(2019, 12, 2), date(2019, 12, 10), date(2019, 12, 11)),
        "open": (["200050"], None, None, None),
    }
    assert {r.notice: r.reason for r in unread.collect()} == {"no code": "no_code", "no day": "no_day", "half": "half_a_period", "none": "no_code"}


@pytest.mark.parametrize(("label", "fact"), [
    ("Ⅰ. 매출액(주석 3, 29)", "sales"), ("1) 영업이익", "operating_profit"), ("(2)가.당 기 순 이 익", "net_income"), ("(자산총계)", "assets"), ("자산총계", "assets"), ("수익(매출액)", None), ("기타", None), ("", None), (None, None),
])
def test_accounts(spark, label, fact):
    df = spark.createDataFrame([("x", label)], "id string, label string")
    assert df.select(forms.account_fact(F.col("id"), F.col("label"))).first()[0] == fact
