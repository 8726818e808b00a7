"""Queries of the parsing and naming rules: texts are made of values of the tables, and SQL says what the rules make of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cosecha.functions import names
from cosecha.functions import text as fn
from cosecha.operators import quality
from cosecha.plans.merge_queries import _QUALITY
from cosecha.plans.registry import Registry
from cosecha.plans.views import Views
from cosecha.sources import bulletins, layouts, links

registry = Registry()

_MONTH = f"element_at(array({', '.join(map(repr, fn.MONTHS))}), month(o_orderdate))"
_DAY, _YEAR = "cast(day(o_orderdate) as string)", "cast(year(o_orderdate) as string)"
#: The same in the other dialect.
_MONTHS_SQL = f"list_extract({fn.MONTHS}, month(o_orderdate))"
_FORMS_SQL = f"list_extract({fn.MONTH_FORMS}, month(o_orderdate))"
_DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
_FIRST_SQL = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"


def cases(column: str, texts: Sequence[str]) -> str:
    """The k-th of ``texts`` where ``column`` modulo their number is k, in either dialect."""
    return f"case {column} % {len(texts)} {' '.join(f'when {k} then {t}' for k, t in enumerate(texts))} end"


def rule(name: str, table: str, key: str, made: Sequence[str], wanted: Mapping[str, str], build: Callable[..., Mapping[str, Column]]) -> None:
    """Register ``name``: ``made`` are Spark SQL expressions over ``table`` whose values ``build`` gets, ``wanted`` has the results as DuckDB SQL."""

    @registry.query(name, f"SELECT {key}, {', '.join(f'{sql} AS {column}' for column, sql in wanted.items())} FROM {table}")
    def run(spark, sf_dir):
        rows = Views(spark, sf_dir).table(table).select(key, *[F.expr(e).alias(f"_a{k}") for k, e in enumerate(made)])
        return rows.select(key, *(c.alias(n) for n, c in build(*(F.col(f"_a{k}") for k in range(len(made)))).items()))


def _part(name: str, texts: Sequence[str], wanted: Mapping[str, Sequence[str]], build: Callable[[Column], Mapping[str, Column]]) -> None:
    rule(name, "part", "p_partkey", [cases("p_partkey", texts)], {c: cases("p_partkey", sql) for c, sql in wanted.items()}, build)


def _orders(name: str, texts: Sequence[str], wanted: Mapping[str, Sequence[str]], build: Callable[[Column], Mapping[str, Column]]) -> None:
    rule(name, "orders", "o_orderkey", [cases("o_orderkey", texts)], {c: cases("o_orderkey", sql) for c, sql in wanted.items()}, build)


_part(
    "L3_city_market",
    ["p_name || ', ' || p_brand", "'Bogotá, D.C., ' || p_name", "p_name || ' (' || p_brand || ')'", "p_name || ' (Nariño), ' || p_brand || ' norte'", "'  ' || p_name || '  '", "p_name || ', ' || p_brand || ', norte'"],
    {"city": ["p_name", "'Bogotá, D.C.'", "p_name", "p_name", "p_name", "p_name"], "market": ["p_brand", "p_name", "''", "p_brand || ' norte'", "''", "p_brand || ', norte'"]},
    lambda v: {"city": fn.split_city_market(v)["city"], "market": fn.split_city_market(v)["market"]},
)
_part(
    "L4_last_comma",
    ["p_name || ', a, ' || p_brand", "'Bogotá, D.C., ' || p_name", "'Bogota, D.C., ' || p_name || ', sur'", "p_name", "' ' || p_name || ' ,' || p_brand"],
    {"city": ["p_name || ', a'", "'Bogotá, D.C.'", "'Bogota, D.C.'", "p_name", "p_name"], "market": ["p_brand", "p_name", "p_name || ', sur'", "''", "p_brand"]},
    lambda v: {"city": fn.split_at_last_comma(v)["city"], "market": fn.split_at_last_comma(v)["market"]},
)
_orders(
    "L2_named_months",
    [f"'Lunes ' || {_DAY} || ' de ' || upper({_MONTH}) || ' de ' || {_YEAR}", f"{_DAY} || ' de xyz de ' || {_YEAR} || ' y 1 de mayo de 2001'", f"'31 de febrero de ' || {_YEAR}", f"'sin fecha ' || {_YEAR}"],
    {"date": [_DATE_SQL, "year(o_orderdate) || '-01-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')", "NULL", "NULL"]},
    lambda v: {"date": fn.parse_spanish_date(v).cast("string")},
)
_orders(
    "A5_dated_text",
    [f"'Anexo - ' || {_DAY} || ' de ' || initcap({_MONTH}) || ' de ' || {_YEAR}", f"{_DAY} || ' de ' || {_MONTH} || ' ' || {_YEAR}", f"'Boletín ' || {_DAY} || ' de ' || {_MONTH}", f"{_DAY} || ' de marte'"],
    {"date": [_DATE_SQL, _DATE_SQL, "NULL", "NULL"], "in_2012": [_DATE_SQL, _DATE_SQL, "'2012-' || strftime(o_orderdate, '%m-%d')", "NULL"]},
    lambda v: {"date": fn.dated_text(v).cast("string"), "in_2012": fn.dated_text(v, F.lit(2012)).cast("string")},
)
_part(
    "L6_inner_accents",
    ["p_name || 'Á'", "'Á' || p_name", "p_name || 'ÉÍÓ ' || p_brand || ' Ñ'", "upper(p_name) || 'Ñz'"],
    {"fixed": ["p_name || 'á'", "'Á' || p_name", "p_name || 'éíó ' || p_brand || ' Ñ'", "upper(p_name) || 'Ñz'"]},
    lambda v: {"fixed": fn.lower_inner_accents(v)},
)
_part(
    "L7_marks_and_forms",
    ["'Ñ' || p_name || 'ﬀ'", "'Ａ' || p_name || '²'", "p_name || '\\u0301 ' || p_brand", "'Ǻńḗ' || p_name"],
    {"plain": ["'N' || p_name || 'ff'", "'A' || p_name || '2'", "p_name || ' ' || p_brand", "'Ane' || p_name"]},
    lambda v: {"plain": fn.strip_accents(v)},
)
_part(
    "L8_encoding_repairs",
    ["'Medell¡n ' || p_name", "p_name || ' lim¢n'", "'PlÃ¡tano ' || p_name", "'Bogota ' || p_name", "p_name || ' aÃ±o'"],
    {"repaired": ["'Medellín ' || p_name", "p_name || ' limón'", "'Plátano ' || p_name", "'Bogotáa ' || p_name", "p_name || ' año'"]},
    lambda v: {"repaired": names.repaired(v)},
)
_part(
    "L9_standard_key_cases",
    ["'ÁÉ ' || upper(p_name) || ', Ñ-' || p_brand", "p_name || ' * (' || p_brand || ')'", "' Яблоко\\u00a0' || p_name", "cast(null as string)"],
    {"key": ["'ae ' || p_name || ' n-' || replace(lower(p_brand), '#', '')", "p_name || '  ' || replace(lower(p_brand), '#', '')", "'яблоко ' || p_name", "''"]},
    lambda v: {"key": names.standard_key(v)},
)
rule(
    "L10_standard_forms",
    "part",
    "p_partkey",
    [cases("p_partkey", ["'citricos  ' || p_name", "p_name || ',  d.c.'", "'Limon * ' || p_name", "'Medell¡n ' || p_name"]), cases("p_partkey", ["'category'", "'city'", "'product'", "'other'"])],
    {
        "standardized": cases("p_partkey", ["'Cítricos ' || p_name", "p_name || ', D.C.'", "'limón ' || p_name", "'Medellín ' || p_name"]),
        "comparison_key": cases("p_partkey", ["'citricos ' || p_name", "p_name || ' dc'", "'limon  ' || p_name", "'medellin ' || p_name"]),
    },
    lambda v, k: {c: names.standard_forms(v, k)[c] for c in ("standardized", "comparison_key")},
)
_part(
    "L11_normalized",
    ["'  ' || p_name || '   hartÓn '", "'CÍtricos\\u00a0 ' || p_name", "p_name || '\\t' || p_brand"],
    {"name": ["p_name || ' hartón'", "'CÍtricos ' || p_name", "p_name || ' ' || p_brand"]},
    lambda v: {"name": names.normalized(v)},
)
_part(
    "L13_group_key",
    ["'-/' || upper(p_name) || '*, ' || p_brand || ' /'", "regexp_replace(p_name, '(.)', '$1$1')", "p_name || ' + (' || p_brand || ').'", "'Ñ' || p_name"],
    {"key": ["p_name || ' ' || lower(p_brand)", "p_name", "p_name || ' (' || lower(p_brand) || ')'", "'n' || p_name"]},
    lambda v: {"key": names.group_key(v)},
)


_SPELT = ["p_name || ' ' || p_brand", "upper(p_name || ' ' || p_brand) || ' *'", "upper(substring(p_name, 1, 1)) || substring(p_name, 2)", "p_name || ' x ' || upper(p_name)", "replace(p_name, ' ', 'X')"]


@registry.query("L14_name_quality", f"""
SELECT p_partkey, {_QUALITY} AS score FROM (SELECT *, length(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS al, length(regexp_replace(name, '[^A-Z]', '', 'g')) AS up FROM (SELECT p_partkey, {cases('p_partkey', _SPELT)} AS name FROM part))""")
def name_quality(spark, sf_dir):
    rows = Views(spark, sf_dir).table("part").select("p_partkey", F.expr(cases("p_partkey", _SPELT)).alias("name"))
    return rows.select("p_partkey", names.name_quality(F.col("name")).alias("score"))


_part(
    "L16_input_stem",
    ["p_name || ' 200 SC'", "p_name || ' 46% x 50 kg'", "upper(p_name) || ' 480 sl 1.5 l'", "'Abono orgánico ' || p_name"],
    {"stem": ["p_name", "p_name || ' x'", "p_name", "'abono org nico ' || p_name"]},
    lambda v: {"stem": names.input_stem(v)},
)
_WHOLE = "CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 9 ELSE 1 END // CASE o_orderkey % 5 WHEN 0 THEN 1000 ELSE 1 END"
_TENTHS = "CAST((({0}) + {1} // 20) // ({1} // 10) // 10 AS VARCHAR) || '.' || CAST((({0}) + {1} // 20) // ({1} // 10) % 10 AS VARCHAR)"
rule(
    "L20_formats",
    "orders",
    "o_orderkey",
    ["cast(floor(o_totalprice) as bigint) * (case o_orderkey % 3 when 0 then 9 else 1 end) div (case o_orderkey % 5 when 0 then 1000 else 1 end)"],
    {
        "cop": f"'$ ' || replace(format('{{:,}}', {_WHOLE}), ',', '.')",
        "compact": f"CASE WHEN {_WHOLE} >= 1000000 THEN '$' || {_TENTHS.format(_WHOLE, 1000000)} || 'M' WHEN {_WHOLE} >= 1000 THEN '$' || CAST(({_WHOLE} + 500) // 1000 AS VARCHAR) || 'K' ELSE '$' || CAST({_WHOLE} AS VARCHAR) END",
        "kg": f"CASE WHEN {_WHOLE} >= 1000000 THEN {_TENTHS.format(_WHOLE, 1000000)} || 'M kg' WHEN {_WHOLE} >= 1000 THEN {_TENTHS.format(_WHOLE, 1000)} || 'K kg' ELSE CAST({_WHOLE} AS VARCHAR) || ' kg' END",
        "pct": f"'+' || CAST({_WHOLE} AS VARCHAR) || '.0%'",
    },
    lambda v: {"cop": names.pesos(v.cast("double")), "compact": names.compact_pesos(v.cast("double")), "kg": names.kilograms(v.cast("double")), "pct": names.signed_percent(v.cast("double"))},
)
rule(
    "L20_date_and_context_formats",
    "orders",
    "o_orderkey",
    ["cast(o_orderdate as date)", "case when o_orderkey % 3 > 0 then o_orderpriority else '' end", "case when o_orderkey % 2 > 0 then o_orderstatus end"],
    {
        "short": f"day(o_orderdate) || ' ' || {_FORMS_SQL}",
        "medium": f"day(o_orderdate) || ' de ' || {_MONTHS_SQL} || ' ' || year(o_orderdate)",
        "context": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END || CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 > 0 THEN ' · ' ELSE '' END || CASE WHEN o_orderkey % 2 > 0 THEN o_orderstatus ELSE '' END",
    },
    lambda d, p, u: {"short": names.short_date(d), "medium": names.medium_date(d), "context": names.price_context(p, u)},
)
_TITLED = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_part(
    "L23_title_case",
    ["upper(p_name) || ' o''x 3y'", "p_name || ' ÑAME'", "'san JOSÉ ' || p_name"],
    {"name": [f"{_TITLED} || ' O''X 3Y'", f"{_TITLED} || ' Ñame'", f"'San José ' || {_TITLED}"]},
    lambda v: {"name": names.title_case(v)},
)
_orders(
    "A2_url_dates",
    [
        f"'/files/anex-SIPSADiario-' || {_DAY} || left({_MONTH}, 3) || {_YEAR} || '.xlsx'", f"'/files/mayoristas_' || {_MONTH} || '_' || {_DAY} || '_' || {_YEAR} || '.pdf'",
        "'/files/bol-reg-' || date_format(o_orderdate, 'dd-MM-yyyy') || '.zip'", "'/files/sipsa-' || date_format(o_orderdate, 'dd-MM-yyyy') || '.zip'",
        f"'/files/mayoristas_anexo_' || {_MONTH} || '_' || {_DAY} || '_' || {_YEAR} || '.xls'", f"'/files/nada-' || {_YEAR} || '.pdf'",
    ],
    {"date": [_DATE_SQL, _DATE_SQL, _DATE_SQL, _DATE_SQL, _DATE_SQL, "NULL"]},
    lambda v: {"date": links.url_date(v).cast("string")},
)
_orders(
    "A27_milk_file_dates",
    [f"'anex-Leche-2013-' || {_YEAR} || '.xlsx'", f"'anex-SIPSALeche-' || left({_MONTH}, 3) || {_YEAR} || '.xlsx'", "'leche.xls'"],
    {"date": ["year(o_orderdate) || '-01-01'", _FIRST_SQL, "NULL"]},
    lambda v: {"date": links.milk_file_date(v).cast("string")},
)
rule(
    "A4_link_kinds",
    "part",
    "p_partkey",
    [
        cases("p_partkey", ["'/files/bol-SIPSADiario-regionales-' || p_partkey || '.zip'", "'/files/' || p_partkey || '.zip'", "'/files/bol_' || p_partkey || '.pdf'", "'/files/' || p_partkey || '.pdf'", "'/files/mayoristas_julio_1_' || p_partkey || '.xls'", "'/files/' || p_partkey || '.xlsx'"]),
        cases("p_partkey", ["p_name", "'Informes por ciudades ' || p_name", "p_name", "'Boletín diario ' || p_name", "p_name", "p_name"]),
    ],
    {"category": cases("p_partkey", ["'informes_ciudades'", "'informes_ciudades'", "'boletin'", "'boletin'", "'anexo'", "NULL"]), "kind": cases("p_partkey", ["'zip'", "'zip'", "'pdf'", "'pdf'", "'excel'", "'excel'"])},
    lambda u, t: {"category": links.link_kind(u, t), "kind": links.file_kind(u, t)},
)
rule(
    "C15_transient_errors",
    "part",
    "p_partkey",
    [cases("p_partkey", ["'upload_transient'", "p_type", "p_type", "cast(null as string)"]), cases("p_partkey", ["p_name", "'Connection RESET by ' || p_name", "'no category: ' || p_name", "p_name || ' Errno 35'"])],
    {"transient": cases("p_partkey", ["TRUE", "TRUE", "FALSE", "TRUE"])},
    lambda k, m: {"transient": quality.transient(k, m)},
)
rule(
    "C18_row_tests",
    "part",
    "p_partkey",
    [cases("p_partkey", ["array(p_name, 'kg', '1', cast(p_size + 1 as string) || '.000', 'n.d.')", "array(p_name)", "array(p_name, 'kg', '1', 'n.d.', '', '0')", "array('PRODUCTO', p_name)", "array(p_name, 'Mínimo', 'Máximo')"])],
    {"priced": cases("p_partkey", ["TRUE", "FALSE", "FALSE", "FALSE", "FALSE"]), "heading": cases("p_partkey", ["FALSE", "FALSE", "FALSE", "TRUE", "TRUE"])},
    lambda r: {"priced": bulletins.has_price(r), "heading": bulletins.is_heading(r)},
)
# Only dates from 2000 on, or in December or January, are looked for.
_HEADED_SQL = f"CASE WHEN year(o_orderdate) >= 2000 OR month(o_orderdate) IN (1, 12) THEN {_DATE_SQL} END"
_TEXTS = [
    f"'DANE\\nPrecios de venta mayorista\\nSIPSA\\nBogotá, D.C., Plaza ' || o_custkey || '\\nLunes ' || {_DAY} || ' de ' || {_MONTH} || ' de ' || {_YEAR}",
    f"'PRECIOS DE VENTA MAYORISTA\\n' || {_DAY} || ' de ' || {_MONTH} || ' de ' || {_YEAR} || '\\n\\nCiudad ' || o_custkey || ' (Magdalena)'",
    "'Boletín diario\\nMercados al alza ' || o_custkey",
]
_orders(
    "A11_document_headers",
    _TEXTS,
    {"city": ["'Bogotá, D.C.'", "'Ciudad ' || o_custkey", "''"], "market": ["'Plaza ' || o_custkey", "''", "''"], "date": [_HEADED_SQL, _HEADED_SQL, "NULL"], "news": ["FALSE", "FALSE", "TRUE"]},
    lambda t: {**{c: bulletins.document_header(t)[c].cast("string") for c in ("city", "market", "date")}, "news": bulletins.is_news(t)},
)
_orders(
    "A21_document_names",
    [f"'x/Ciudad ' || o_custkey || ', Plaza, norte-' || {_DAY} || '-' || cast(month(o_orderdate) as string) || '-' || {_YEAR} || '.pdf'", f"'Ciudad ' || o_custkey || '-' || date_format(o_orderdate, 'dd-MM-yyyy') || '.PDF'", "'Ciudad ' || o_custkey || '.pdf'"],
    {"city": ["'Ciudad ' || o_custkey"] * 3, "market": ["'Plaza, norte'", "NULL", "NULL"], "date": [_DATE_SQL, _DATE_SQL, "NULL"]},
    lambda v: {c: layouts.document_name(v)[c].cast("string") for c in ("city", "market", "date")},
)
