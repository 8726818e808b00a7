"""Scalar functions on golden cases, and operators on edge cases that the tables lack."""

import datetime as dt
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cosecha.functions import columns, text
from cosecha.operators import conform, prices, quality, supply
from cosecha.sources import links


def values(spark, function, cases, kind="string"):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("v"))).collect()]


def test_parse_price(spark):
    cases = ["1.200", "12,5", "n.d.", "0", "12.5", "", None, "-3", " 7 "]
    assert values(spark, text.parse_price, cases) == [1200, 12.5, None, None, 125, None, None, None, 7]


def test_parse_spanish_date(spark):
    cases = ["31 de Diciembre de 2020", "Lunes 28 de abril de 2014", "31 de febrero de 2020", "5 de xyz de 2019", "nada", None]
    day = dt.date
    assert values(spark, text.parse_spanish_date, cases) == [day(2020, 12, 31), day(2014, 4, 28), None, day(2019, 1, 5), None, None]


def test_split_city_market(spark):
    cases = ["Cali, Cavasa", "Bogotá, D.C., Corabastos", "Santa Marta (Magdalena)", "Ipiales (Nariño), Ipiales somos todos"]
    found = [(r["city"], r["market"]) for r in values(spark, text.split_city_market, cases)]
    assert found == [("Cali", "Cavasa"), ("Bogotá, D.C.", "Corabastos"), ("Santa Marta", ""), ("Ipiales", "Ipiales somos todos")]


def test_undouble_and_accents(spark):
    assert values(spark, text.undouble, ["AAhhuuyyaa", "Perro", "abc", "", None]) == ["Ahuya", "Perro", "abc", "", None]
    assert values(spark, text.lower_inner_accents, ["PlÁtano", "CÍtricos", "aÁÉÍb"]) == ["Plátano", "CÍtricos", "aáéíb"]
    assert values(spark, text.comparison_key, ["  Ñandú*, (Rojo) ", None]) == ["nandu rojo", None]


def test_codes_and_labels(spark):
    assert values(spark, lambda c: text.zero_padded(c, 2), ["5", "05", "123"]) == ["05", "05", "123"]
    assert values(spark, text.classification_code, [" '0123' ", "''", None]) == ["0123", None, None]
    assert values(spark, text.compact_number, [1_234_567.0, 1500.0, 12.4], "double") == ["1.2 M", "1.5 K", "12"]


def test_url_dates_and_kinds(spark):
    cases = ["x/24dic2025.xlsx", "mayoristas_noviembre_30_2018", "anex_feb_28_2022", "bol-reg-28-02-2022", "sipsa-08-01-2021", "none", None]
    day = dt.date
    assert values(spark, links.url_date, cases) == [day(2025, 12, 24), day(2018, 11, 30), day(2022, 2, 28), day(2022, 2, 28), day(2021, 1, 8), None, None]
    assert values(spark, links.file_kind, ["a.ZIP", "a.pdf?x", "a.xls", "a"]) == ["zip", "pdf", "excel", None]
    assert values(spark, lambda c: links.link_kind(c, F.lit("")), ["bol-reg-regionales", "bol-reg", "mayoristas_a.xls", "x"]) == ["informes_ciudades", "boletin", "anexo", None]


def test_freshness(spark):
    ledger = spark.createDataFrame([("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00"), ("c", "bad"), ("d", "2024-01-02 00:00:00")], "url string, download_date string")
    headers = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 3)), ("c", dt.datetime(2024, 1, 1)), ("e", dt.datetime(2024, 1, 1))], "url string, last_modified timestamp")
    found = {r["url"]: r["freshness"] for r in links.freshness(ledger, headers).collect()}
    assert found == {"a": "fresh", "b": "stale", "c": "stale", "d": "fresh", "e": "missing"}


def test_month_index_needs_a_hyphen(spark):
    pages = spark.createDataFrame([("x/boletin-mayo-2014/1",), ("x/boletin-mayo-2014/2",), ("x/mayoristas-2014",)], "url string")
    assert [(r["year"], r["month"], len(r["urls"])) for r in links.month_index(pages).collect()] == [(2014, 5, 2)]


def test_trailing_window_has_no_upper_bound(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 30)], "d date")
    assert days.filter(columns.trailing("d", "2024-01-09", 7)).count() == 2
    assert days.filter(columns.trailing("d", "2024-01-09", 0)).count() == 3


def test_summary_of_nothing_is_one_row(spark):
    empty = spark.createDataFrame([], "observation_date date, product_id long, market_id long, city_id long, origin string, quantity_kg decimal(14,2)")
    assert supply.summary(empty, "2024-01-01", 30, market_id=1).collect()[0] == (0.0, 0.0, 0, None, None)
    assert supply.top(empty, "product_id", "2024-01-01", 30, 10).count() == 0


def test_origin_labels_do_not_filter_back(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x",)], "origin string")
    assert [r[0] for r in rows.select(columns.known_origin()).collect()] == ["Desconocido", "Desconocido", "x"]
    assert columns.with_origin(rows, "Desconocido").count() == 0
    assert columns.with_origin(rows, "").count() == 3


def test_positive_price_uses_the_first_known(spark):
    schema = "avg_price decimal(14,2), min_price decimal(14,2), max_price decimal(14,2)"
    from decimal import Decimal as D

    rows = spark.createDataFrame([(D(0), D(5), D(9)), (None, D(0), D(9)), (None, None, D(9)), (None, None, None)], schema)
    assert prices.positive(rows).count() == 1


def test_choropleth_of_equal_values(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 0.0)], "k long, v double")
    assert {r["k"]: r["colour"] for r in prices.choropleth(rows, "k", "v").collect()} == {1: 3, 2: 3, 3: 0, 4: 0}


def test_merge_chains_close_and_rewrite(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 7)], "loser long, winner long")
    assert sorted(tuple(r) for r in conform.closed_merges(merges).collect()) == [(1, 4), (2, 4), (3, 4)]
    facts = spark.createDataFrame([(1, "a"), (4, "b"), (None, "c"), (9, "d")], "k long, v string")
    assert sorted((r["v"], r["k"]) for r in conform.rewrite_keys(facts, "k", conform.closed_merges(merges)).collect()) == [("a", 4), ("b", 4), ("c", None), ("d", 9)]


def test_fuzzy_best_against_all_pairs(spark):
    names = ["papa criolla", "papa pastusa", "platano harton", "yuca", "papaya"]
    wanted = ["papa criola", "platano artón", "yucca", "zzz", None]
    members = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["value"]: (r["name"], r["ratio"]) for r in conform.fuzzy_best(spark.createDataFrame([(w,) for w in wanted], "value string"), members, 0.85).collect()}
    key = lambda w: w.replace("ó", "o")
    best = {w: max((SequenceMatcher(None, key(w), n).ratio(), n) for n in names) for w in wanted if w}
    assert found == {w: (n, pytest.approx(r)) for w, (r, n) in best.items() if r >= 0.85}


def test_fuzzy_best_finds_other_first_letters(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 16))).strip() or "q" for _ in range(60)] + ["papa criolla", "a" * 250]
    wanted = ["xx" + n for n in names] + [n[1:] for n in names] + [n.upper() + " *" for n in names] + [n[:5] + "z" + n[5:] for n in names] + ["hpapa criolla", "??", None]
    members = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["value"]: (r["name"], r["ratio"]) for r in conform.fuzzy_best(spark.createDataFrame([(w,) for w in wanted], "value string"), members, 0.85).collect()}
    key = lambda w: " ".join(re.sub("[^a-z0-9]", " ", w.lower()).split())
    best = {w: min((-SequenceMatcher(None, key(w), key(n)).ratio(), n) for n in names) for w in wanted if w is not None}
    assert found == {w: (n, pytest.approx(-r)) for w, (r, n) in best.items() if -r >= 0.85}
    assert found["xxpapa criolla"][0] == found["hpapa criolla"][0] == "papa criolla"


def test_transient_errors(spark):
    rows = spark.createDataFrame([("database_error", None), ("parse", "Connection RESET by peer"), ("parse", "bad row"), (None, None)], "kind string, message string")
    assert [r[0] for r in rows.select(quality.transient(F.col("kind"), F.col("message"))).collect()] == [True, True, False, False]


def test_strip_accents_of_every_letter(spark):
    plain = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    # Vowel signs made of marks only are none of the table's.
    letters = [v for v in map(chr, (*range(0x20, 0xAC00), *range(0xF900, 0xFFF0))) if plain(v) or unicodedata.combining(v)]
    wanted = [plain(v) for v in letters]
    cases = [f"a{v}b {v}{v}\n" for v in letters] + ["", None, "plain", "\U0001f600ﬀ"]
    assert values(spark, text.strip_accents, cases) == [f"a{w}b {w}{w}\n" for w in wanted] + ["", None, "plain", "\U0001f600ff"]


def test_strip_accents_reads_its_text_once_and_tests_few_ranges(spark):
    # A class of single letters tries each of a thousand at every character of a text.
    assert text._SEVERAL.count(r"\x") < 250
    planned = spark.range(1).select(text.strip_accents(text.strip_accents(text.strip_accents(F.concat(F.lit("x"), F.col("id").cast("string"))))))
    assert planned._jdf.queryExecution().analyzed().toString().count("concat(x, cast(id#") == 1


def test_keys_collapse_any_run_of_blanks(spark):
    cases = ["a b", " a  b ", "a\tb", "a b", "a  \n b", "　a　", "   ", "", None, "a,b", "é,  Ü--x!", "a-b c -d"]
    plain = lambda v: None if v is None else " ".join(v.split())
    assert values(spark, text.collapse_spaces, cases) == [plain(v) for v in cases]
    key = lambda v: None if v is None else " ".join(re.sub("[^a-z0-9]", " ", "".join(c for c in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(c))).split())
    assert values(spark, text.comparison_key, cases) == [key(v) for v in cases]
