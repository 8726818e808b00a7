"""Cases whose results the published rules fix, one call for each function; the queries of these functions run over tables."""

import pytest
from pyspark.sql import functions as F

from cosecha.functions import names
from cosecha.functions import text as fn
from cosecha.operators import quality
from cosecha.sources import bulletins, layouts, links

CASES = []


def golden(name, cases, outputs, build):
    CASES.append(pytest.param(cases, outputs, build, id=name))


_PLACES = ["Cali, Cavasa", "Bogotá, D.C., Corabastos", "Santa Marta (Magdalena)", "Ipiales (Nariño), Ipiales somos todos", "Bogotá, D.C.", "Tunja, Dcasa", " Armenia ", "Pasto, El Potrerillo, norte"]
golden(
    "L3_city_market",
    [[p] for p in _PLACES],
    {
        "city": ["Cali", "Bogotá, D.C.", "Santa Marta", "Ipiales", "Bogotá", "Tunja", "Armenia", "Pasto"],
        "market": ["Cavasa", "Corabastos", "", "Ipiales somos todos", "D.C.", "Dcasa", "", "El Potrerillo, norte"],
    },
    lambda v: {"city": fn.split_city_market(v)["city"], "market": fn.split_city_market(v)["market"]},
)
golden(
    "L4_last_comma",
    [["Cali, Cavasa"], ["Bogotá, D.C., Corabastos"], ["Bogota, D.C., Paloquemao, sur"], ["Bogotá, D.C."], ["Tunja"], ["Pasto, El Potrerillo, norte"], [""]],
    {
        "city": ["Cali", "Bogotá, D.C.", "Bogota, D.C.", "Bogotá", "Tunja", "Pasto, El Potrerillo", ""],
        "market": ["Cavasa", "Corabastos", "Paloquemao, sur", "D.C.", "", "norte", ""],
    },
    lambda v: {"city": fn.split_at_last_comma(v)["city"], "market": fn.split_at_last_comma(v)["market"]},
)
golden(
    "L2_named_months",
    [["31 de Diciembre de 2020"], ["Lunes 28 de abril de 2014"], ["5 de marte de 2014"], ["31 de febrero de 2015"], ["ayer"], [None], ["1 de SEPTIEMBRE de 2019 y 2 de mayo de 2020"]],
    {"date": ["2020-12-31", "2014-04-28", "2014-01-05", None, None, None, "2019-09-01"]},
    lambda v: {"date": fn.parse_spanish_date(v).cast("string")},
)
golden(
    "A5_dated_text",
    [["30 de septiembre de 2021"], ["30 de septiembre 2021"], ["30 de Septiembre"], ["31 de marte"], ["Anexo - 7 de agosto"], ["nada"], [None]],
    {"date": ["2021-09-30", "2021-09-30", None, None, None, None, None], "in_2012": ["2021-09-30", "2021-09-30", "2012-09-30", None, "2012-08-07", None, None]},
    lambda v: {"date": fn.dated_text(v).cast("string"), "in_2012": fn.dated_text(v, F.lit(2012)).cast("string")},
)
golden(
    "L6_inner_accents",
    [["PlÁtano"], ["CÍtricos"], ["azÚcar y frutiÑo"], ["paÁÉÍÓÚÑz"], ["ÁÉ"], [""], [None], ["ñÁ, bÁ"]],
    {"fixed": ["Plátano", "CÍtricos", "azúcar y frutiño", "paáéíóúñz", "ÁÉ", "", None, "ñá, bá"]},
    lambda v: {"fixed": fn.lower_inner_accents(v)},
)
golden(
    "L7_marks_and_forms",
    [["Plátano"], ["ñandú"], ["ﬀ Ｐａｐａ"], ["Ǻńḗ"], ["Ñame²"], [None]],
    {"plain": ["Platano", "nandu", "ff Papa", "Ane", "Name2", None]},
    lambda v: {"plain": fn.strip_accents(v)},
)
golden(
    "L8_encoding_repairs",
    [["Medell¡n"], ["Bogot "], ["Bogota"], ["Bogotá"], ["PlÃ¡tano"], ["lim¢n"], [""], [None]],
    {"repaired": ["Medellín", "Bogotáá", "Bogotáa", "Bogotáá", "Plátano", "limón", "", ""]},
    lambda v: {"repaired": names.repaired(v)},
)
golden(
    "L9_standard_key_cases",
    [["Papa-criolla  (sucia)"], ["PLÁTANO, hartón"], ["Ñame * espino"], ["Яблоко"], [""], [None], ["lim¢n"]],
    {"key": ["papa-criolla sucia", "platano harton", "name  espino", "яблоко", "", "", "limon"]},
    lambda v: {"key": names.standard_key(v)},
)
golden(
    "L10_standard_forms",
    [["citricos  del valle", "category"], ["TUBERCULOS, raices", "category"], ["bogotá,  d.c.", "city"], ["Limon * tahiti", "product"], ["PLATANO harton", "product"], ["Medell¡n", "generic"], [None, "city"]],
    {
        "standardized": ["Cítricos del valle", "Tubérculos, raíces", "bogotá, D.C.", "limón tahiti", "plátano harton", "Medellín", ""],
        "comparison_key": ["citricos del valle", "tuberculos raices", "bogota dc", "limon  tahiti", "platano harton", "medellin", ""],
    },
    lambda v, k: {c: names.standard_forms(v, k)[c] for c in ("standardized", "comparison_key")},
)
golden(
    "L11_normalized",
    [["  Plátano   hartÓn "], ["CÍtricos"], ["a\tb"], [""], [None]],
    {"name": ["Plátano hartón", "CÍtricos", "a b", "", None]},
    lambda v: {"name": names.normalized(v)},
)
golden(
    "L13_group_key",
    [["AAhhuuyyaa*"], ["Papa, criolla."], ["-/Ñame /"], ["A + B"], [""], [None], ["Arroz (sobre)"]],
    {"key": ["ahuya", "papa criolla", "name", "a b", "", "", "arroz (sobre)"]},
    lambda v: {"key": names.group_key(v)},
)
golden(
    "L14_name_quality",
    [["Plátano"], ["PAPA CRIOLLA"], ["papa"], ["Papa criolla"], ["AAhhuuyyaa"], ["Sal Refisal"], ["Mercado de ABEJORRAL"], ["papaCriolla*"], ["Cab. X"], ["Ajo"]],
    {"score": [28, -45, -30, 20, -980, -20, -35, -30, 0, 15]},
    lambda v: {"score": names.name_quality(v)},
)
golden(
    "L16_input_stem",
    [["Regent 200 SC"], ["Regent SC 200"], ["Urea 46% x 50 kg"], ["Glifosato 480 sl 1.5 l"], ["Abono orgánico"], ["K"]],
    {"stem": ["regent", "regent", "urea x", "glifosato", "abono org nico", "k"]},
    lambda v: {"stem": names.input_stem(v)},
)
golden(
    "L20_formats",
    [[0.0], [950.0], [1234.0], [1234567.0], [-20.25], [None]],
    {
        "cop": ["$ 0", "$ 950", "$ 1.234", "$ 1.234.567", "-$ 20", "—"],
        "compact": ["$0", "$950", "$1K", "$1.2M", "$-20", "—"],
        "kg": ["0 kg", "950 kg", "1.2K kg", "1.2M kg", "-20 kg", "—"],
        "pct": ["+0.0%", "+950.0%", "+1234.0%", "+1234567.0%", "-20.3%", "—"],
    },
    lambda v: {"cop": names.pesos(v), "compact": names.compact_pesos(v), "kg": names.kilograms(v), "pct": names.signed_percent(v)},
)
golden(
    "L20_date_and_context_formats",
    [["2021-01-05", "Kilogramo", "1 kg"], ["2019-09-30", "", "12"], ["2020-02-29", None, None]],
    {"short": ["5 ene", "30 sep", "29 feb"], "medium": ["5 de enero 2021", "30 de septiembre 2019", "29 de febrero 2020"], "context": ["Kilogramo · 1 kg", "12", ""]},
    lambda d, p, u: {"short": names.short_date(d.cast("date")), "medium": names.medium_date(d.cast("date")), "context": names.price_context(p, u)},
)
golden(
    "L23_title_case",
    [["san JOSÉ del guaviare"], ["o'higgins"], ["ñame 3x"], [""]],
    {"name": ["San José Del Guaviare", "O'Higgins", "Ñame 3X", ""]},
    lambda v: {"name": names.title_case(v)},
)
golden(
    "A2_url_dates",
    [
        ["/files/anex-SIPSADiario-24dic2025.xlsx"], ["/files/mayoristas_noviembre_30_2018.xlsx"], ["/files/anex_feb_28_2022.xlsx"], ["/files/mayoristas_anexo_sept_28_2012.xls"],
        ["/files/mayoristas_anexo_agosto_31_2012.xls"], ["/files/bol-reg-28-02-2022.zip"], ["/files/sipsa-08-01-2021.zip"], ["/files/mayoristas_julio_31_2012.xls"],
        ["/files/bol-reg-31-02-2022.zip"], ["/files/31xyz2020.pdf"], ["/files/nada.pdf"],
    ],
    {"date": ["2025-12-24", "2018-11-30", "2022-02-28", "2012-09-28", "2012-08-31", "2022-02-28", "2021-01-08", "2012-07-31", None, None, None]},
    lambda v: {"date": links.url_date(v).cast("string")},
)
golden(
    "A27_milk_file_dates",
    [["anex-Leche-2013-2019.xlsx"], ["anex-SIPSALeche-ene2026.xlsx"], ["Leche-SEPT2020.xlsx"], ["leche.xls"], ["xyz2020.xlsx"]],
    {"date": ["2019-01-01", "2026-01-01", "2020-09-01", None, "2020-01-01"]},
    lambda v: {"date": links.milk_file_date(v).cast("string")},
)
golden(
    "A4_link_kinds",
    [
        ["/files/bol-SIPSADiario-regionales-1ene2024.zip", ""], ["/files/x.zip", "Informes por ciudades"], ["/files/bol_feb_28_2022.pdf", ""], ["/files/x.pdf", "Boletín diario"],
        ["/files/mayoristas_julio_1_2012.pdf", ""], ["/files/mayoristas_julio_1_2012.xls", ""], ["/files/anex-1.xlsx", ""], ["/files/region.xlsx", "Bolsa"], ["/files/x", "Anexo"],
    ],
    {
        "category": ["informes_ciudades", "informes_ciudades", "boletin", "boletin", "boletin", "anexo", "anexo", None, "anexo"],
        "kind": ["zip", "zip", "pdf", "pdf", "pdf", "excel", "excel", "excel", "excel"],
    },
    lambda u, t: {"category": links.link_kind(u, t), "kind": links.file_kind(u, t)},
)
golden(
    "C15_transient_errors",
    [["upload_transient", ""], ["row_parse_error", "Errno 35"], ["x", "Connection RESET by peer"], ["x", "no category"], [None, None], ["timeout", "x"], ["x", "Duplicate key"]],
    {"transient": [True, True, True, False, False, False, True]},
    lambda k, m: {"transient": quality.transient(k, m)},
)
_ROWS = [["Papa", "kg", "1", "1.200", "n.d."], ["Frutas"], ["Papa", "kg", "1", "n.d.", "", "0"], ["PRODUCTO", "x"], ["a", "Mínimo", "Máximo"], ["Ajo", "kg", "1", "0,5"], ["x", "1", "2"]]
golden(
    "C18_row_tests",
    [[r] for r in _ROWS],
    {"priced": [True, False, False, False, False, True, False], "heading": [False, False, False, True, True, False, False]},
    lambda r: {"priced": bulletins.has_price(r), "heading": bulletins.is_heading(r)},
)
_TEXTS = [
    "DANE\nPrecios de venta mayorista\nSIPSA\nBogotá, D.C., Corabastos\nLunes 28 de abril de 2014",
    "PRECIOS DE VENTA MAYORISTA\n3 de mayo de 2015\n\nSanta Marta (Magdalena)",
    "Boletín diario\nMercados al alza",
    "SIPSA\nhola",
    "otro texto",
]
golden(
    "A11_document_headers",
    [[t] for t in _TEXTS],
    {
        "city": ["Bogotá, D.C.", "Santa Marta", "", "", ""],
        "market": ["Corabastos", "", "", "", ""],
        "date": ["2014-04-28", "2015-05-03", None, None, None],
        "news": [False, False, True, True, False],
    },
    lambda t: {**{c: bulletins.document_header(t)[c].cast("string") for c in ("city", "market", "date")}, "news": bulletins.is_news(t)},
)
golden(
    "A21_document_names",
    [["Cali, Cavasa-5-3-2014.pdf"], ["x/Tunja-15-12-2019.PDF"], ["Pasto, El Potrerillo, norte-1-1-2020.pdf"], ["sin fecha.pdf"]],
    {"city": ["Cali", "Tunja", "Pasto", "sin fecha"], "market": ["Cavasa", None, "El Potrerillo, norte", None], "date": ["2014-03-05", "2019-12-15", "2020-01-01", None]},
    lambda v: {c: layouts.document_name(v)[c].cast("string") for c in ("city", "market", "date")},
)


def literal(value):
    return F.array(*[F.lit(c).cast("string") for c in value]) if isinstance(value, list) else F.lit(value)


@pytest.mark.parametrize(("cases", "outputs", "build"), CASES)
def test_published_results(spark, cases, outputs, build):
    """The k-th case gives the k-th result of each output."""
    rows = spark.range(len(cases)).select("id", *[F.get(F.array(*map(literal, column)), F.col("id").cast("int")).alias(f"a{k}") for k, column in enumerate(zip(*cases, strict=True))])
    found = rows.orderBy("id").select(*(c.alias(n) for n, c in build(*(F.col(f"a{k}") for k in range(len(cases[0])))).items())).collect()
    assert {n: [r[n] for r in found] for n in outputs} == {n: list(v) for n, v in outputs.items()}
