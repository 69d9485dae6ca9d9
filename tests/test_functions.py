"""Scalar semantics, one case per row."""

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import ids, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [(None, ""), ("  Ёлка  и  ЁЖ\n", "елка и еж"), ("a b", "a b"), ("", "")])
def test_normalize(spark, value, want):
    assert one(spark, value, text.normalize) == want


@pytest.mark.parametrize(("value", "want"), [("бумага", "бума"), ("кондиционирование", "кондициони"), ("дом", "дом"), ("насосная", "насосн")])
def test_stem(spark, value, want):
    assert one(spark, value, text.stem) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("1 234,50 руб.", 1234.5), ("1.234.567,8 ₽", 1234567.8), ("2,5 млн руб.", 2_500_000.0), ("300 тыс. руб", 300_000.0), ("$ 500 руб", None), ("500", None), ("без указания цены, 10 руб", None), ("1.2.3 руб", None), (None, None)],
)
def test_price(spark, value, want):
    assert one(spark, value, text.parse_price) == want


@pytest.mark.parametrize(("value", "want"), [("05.06.2026 10:30", "2026-06-05 10:30"), ("05.06.2026", "2026-06-05 00:00"), ("2026-06-05T10:30:00+03:00", "2026-06-05 10:30"), ("31.02.2026", None), ("", None)])
def test_ts(spark, value, want):
    assert one(spark, value, lambda x: F.date_format(text.parse_ts(x), "yyyy-MM-dd HH:mm")) == want


def test_only_times_of_a_format_are_tried(spark):
    """a format that the text cannot have is not tried, since each try that fails raises; a value is worked out once."""
    values = ["05.06.2026 10:30", "05.06.2026 10:30 ", "05.06.2026", "5.6.2026", "2026-06-05 10:30:00", "2026-06-05", "+12026-06-05", "2026-06-05T10:30:00Z", "-05.06.2026", "05.06.2026 1030", "x", "", None]
    old = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in ("dd.MM.yyyy HH:mm", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")], F.regexp_replace("x", "Z$", "").try_cast("timestamp"))
    out = spark.createDataFrame([(v,) for v in values], "x string").select(text.parse_ts("x").eqNullSafe(old))
    assert [v for v, r in zip(values, out.collect(), strict=True) if not r[0]] == []
    x = F.sha2(F.col("id").cast("string"), 256)
    plan = spark.range(1).select(text.parse_ts(x).alias("a"), text.parse_price(x).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2
    assert text.shape("dd.MM.yyyy") == r"^[+-]?\d+\.[+-]?\d+\.[+-]?\d+" and text.shape("d MMM yyyy") is None


@pytest.mark.parametrize(("value", "want"), [("5 июня 2026, 10:00", "2026-06-05 10:00"), ("3 января, 9:05", "2027-01-03 09:05"), ("10 декабря", "2026-12-10 00:00"), ("скоро", None)])
def test_month_name(spark, value, want):
    now = F.lit("2026-12-20 00:00:00").cast("timestamp")
    assert one(spark, value, lambda x: F.date_format(text.parse_month_name(x, now), "yyyy-MM-dd HH:mm")) == want


@pytest.mark.parametrize(("value", "want"), [("закупка: 0123456789012345678 и закупка: 0123456789012345678", ["0123456789012345678"]), ("Закупка: № 31234567890", ["31234567890"]), ("Закупка № 31234567890", []), ("перезакупка: 31234567890", []), ("закупки: 31234567890", []), ("закупка : 81234567890", []), ("номер 0123456789012345678", [])])
def test_official_numbers(spark, value, want):
    assert one(spark, value, ids.official_numbers) == want


@pytest.mark.parametrize(("value", "want"), [("АДМИНИСТРАЦИЯ РЕСПУБЛИК  И КРЫМ", "АДМИНИСТРАЦИЯ РЕСПУБЛИКИ КРЫМ"), ("Завод Запорожск ой области", "Завод Запорожской области"), ("Отдел и Ко", "Отдел и Ко"), ("X- y", "X- y")])
def test_clean_org(spark, value, want):
    assert one(spark, value, ids.clean_org) == want


@pytest.mark.parametrize(("value", "want"), [("root@x.ru", True), ("do-not-reply@x.ru", True), ("a@example.com", True), ("a@localhost", True), ("a@my.example.com", False), ("roots@x.ru", False), (None, False), ("root", False)])
def test_system_email(spark, value, want):
    assert one(spark, value, ids.is_system_email) == want


@pytest.mark.parametrize(("number", "label", "want"), [("1" * 19, "223-ФЗ", "44-ФЗ"), ("3" + "1" * 10, None, "223-ФЗ"), ("8" + "1" * 10, "по 223-фз", "223-ФЗ"), ("8" + "1" * 10, "", None), (None, "44-ФЗ и 223-ФЗ", "44-ФЗ")])
def test_law_by_label(spark, number, label, want):
    df = spark.createDataFrame([(number, label)], "n string, t string")
    assert df.select(ids.law_by_label("n", "t")).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [("Площадка «Щит» №1", "ploschadka-schit-1"), ("Цех", "ceh"), ("  a__b ", "a-b")])
def test_slug(spark, value, want):
    assert one(spark, value, ids.source_slug) == want


def test_marker_fields(spark):
    assert one(spark, "INN=123\nnoise\nEMAIL=a@b.ru\nINN=9\n", ids.marker_fields) == {"INN": "123", "EMAIL": "a@b.ru"}
    assert one(spark, None, ids.marker_fields) == {}


def test_unique_key(spark):
    df = spark.createDataFrame([("s", "7", "http://x/a"), ("s", "", "http://x/a/#top"), ("s", None, None)], "s string, n string, u string")
    assert [r[0] for r in df.select(ids.unique_key("s", "n", "u")).collect()] == ["s:7", "s:http://x/a", "s:"]


@pytest.mark.parametrize(("value", "want"), [("=SUM(A1)", "'=SUM(A1)"), ("a=b", "a=b"), ("\x07x", "x")])
def test_formula_safe(spark, value, want):
    assert one(spark, value, ids.formula_safe) == want


def test_devices(spark):
    from noticeflow.functions import devices

    df = spark.createDataFrame([("Картридж для HP-2035n и лоток 12", "Картридж hp-2035n черный"), ("Стол", None)], "x string, y string")
    kinds = {"картридж": ["картридж", "тонер"], "лоток": ["лоток"]}
    kind, models = devices.item_kind("x", kinds), devices.device_models("x")
    rows = df.select(models.alias("m"), kind.alias("k"), devices.same_kind("x", "y", kinds).alias("s"), devices.search_queries(kind, models, F.array(F.lit("CE505A")), {"картридж": ["тонер"]}).alias("q"), devices.is_any_of(["^стол"], "x").alias("a")).collect()
    assert [r["m"] for r in rows] == [["hp-2035n"], []] and [r["k"] for r in rows] == ["картридж", None] and [r["s"] for r in rows] == ["pass", "unknown"]
    assert rows[0]["q"] == ["CE505A", "картридж hp-2035n", "тонер hp-2035n"] and [r["a"] for r in rows] == [False, True]


def test_sql_functions(spark):
    """The same as the column functions, and inlined."""
    from noticeflow.functions import sql, text

    sql.register(spark)
    xs = ["  Ёлка\u00a0 Большая 12,5 тыс. руб", "Цена 1 234.50 ₽", "5 usd", None, "05.06.2026 10:00", "2026-01-02T03:04:05Z", "1.234,5 млн руб", "hp-2035n a b-c"]
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    df.createOrReplaceTempView("sql_functions")
    got = spark.sql("SELECT nf_normalize(x), nf_stem(x), nf_tokens(x), nf_price(x, true), nf_price(x, false), nf_time(x) FROM sql_functions")
    want = df.select(text.normalize("x"), text.stem("x"), text.search_tokens("x"), text.parse_price("x"), text.parse_price("x", False), text.parse_ts("x"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "nf_" not in plan and "Python" not in plan
