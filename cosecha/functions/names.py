"""Standard forms, keys and scores of raw names, and the formats in which numbers are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cosecha.functions.text import MONTH_FORMS, MONTHS, collapse_spaces, is_doubled, lower_inner_accents, slug, strip_accents, stripped, undouble

# Text that other encodings left, and what it becomes, in the order of replacement.
ENCODING_REPAIRS = {
    "Medell¡n": "Medellín",
    "Bogot ": "Bogotá",
    "Bogot": "Bogotá",
    "Bogota": "Bogotá",
    "BogotÃ¡": "Bogotá",
    "Ã¡": "á",
    "Ã©": "é",
    "Ã\xad": "í",
    "Ã³": "ó",
    "Ãº": "ú",
    "Ã±": "ñ",
    "Ã": "í",
    "¡": "í",
    "¢": "ó",
    "£": "ú",
}
# Spellings and their standard form, in the order of replacement.
SPELLINGS = {
    "tuberculos": "tubérculos",
    "tuberculos, raices y platanos": "tubérculos, raíces y plátanos",
    "raices": "raíces",
    "platanos": "plátanos",
    "platano": "plátano",
    "citricos": "cítricos",
    "citrico": "cítrico",
    "limon": "limón",
    "papa criolla": "papa criolla",
    "oregano": "orégano",
}
# Brands that a product's name should not have.
BRANDS = ["quaker", "incauca", "bastilla", "nieve", "super arepa", "corona", "dagusto", "frutiño", "soberana", "refisal", "fruco", "doria", "día", "3 tacos"]
# Pack sizes, formulation codes and numbers in the names of inputs.
SUFFIXES = [
    r"\b\d+(\.\d+)?\s*(kg|gr?|g|ml|l|lt|cc|oz|lb)\b",
    r"\b\d+\s*(sl|sc|ec|ew|wg|wp|cs|od|sp|gr|se|dp|fs|ls)\b",
    r"\b(sl|sc|ec|ew|wg|wp|cs|od|sp|gr|se|dp|fs|ls)\b",
    r"\b\d+(%|\.\d+)?\b",
]
# Words that say how fish is sold, and where produce comes from.
FISH_WORDS = ["entero", "entera", "fresco", "fresca", "congelado", "congelada", "importado", "importada", "precocido", "seco", "seca"]
REGION_WORDS = [
    "bogotana", "bogotano", "pastusa", "pastuso", "valluna", "valluno", "huilense", "antiqueño", "santandereano", "regional", "importada", "importado",
    "nacional", "ecuatoriano", "llanero", "llanera", "aquitania", "berlín", "tenerife", "ocañera", "peruana",
]


def repaired(value: Column) -> Column:
    """Literal repairs one after another; as each sees what the last one made, 'Bogotá' gains a letter. Null is empty."""
    return reduce(lambda v, pair: F.replace(v, F.lit(pair[0]), F.lit(pair[1])), ENCODING_REPAIRS.items(), F.coalesce(value, F.lit("")))


def standard_key(value: Column) -> Column:
    """Repaired, lower case, no accents, single blanks; then signs other than hyphens go, which may leave two blanks."""
    return F.trim(F.regexp_replace(collapse_spaces(strip_accents(F.lower(repaired(value)))), r"[^\p{L}\p{N}_\s-]", ""))


def group_key(value: Column) -> Column:
    """The key that groups duplicates: undoubled, no accents, lower case, without * + , and ., without hyphens and slashes at the ends."""
    plain = F.translate(F.lower(strip_accents(stripped(undouble(F.coalesce(value, F.lit("")))))), "*+,.", "")
    return F.regexp_replace(collapse_spaces(plain), "^[-/ ]+|[-/ ]+$", "")


def _spelled(value: Column) -> Column:
    return reduce(lambda v, pair: F.regexp_replace(v, f"(?i){pair[0]}", pair[1]), SPELLINGS.items(), value)


def standard_category(value: Column) -> Column:
    """Repaired and respelled; the first word gets one capital, other words stay."""
    text = collapse_spaces(_spelled(repaired(value)))
    first = F.regexp_extract(text, r"^\S*", 0)
    return F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substring(first, F.lit(2), F.length(first))), F.substring(text, F.length(first) + 1, F.length(text)))


def standard_city(value: Column) -> Column:
    """Repaired, single blanks, 'D.C.' in capitals."""
    return F.regexp_replace(collapse_spaces(repaired(value)), r"(?i)d\.c\.", "D.C.")


def standard_product(value: Column) -> Column:
    """Repaired and respelled, without asterisks."""
    return collapse_spaces(_spelled(F.translate(repaired(value), "*", "")))


def standard_forms(value: Column, kind: Column) -> Column:
    """(original, standardized, comparison_key); ``kind`` is category, city, product or anything else."""
    form = F.when(kind == "category", standard_category(value)).when(kind == "city", standard_city(value)).when(kind == "product", standard_product(value))
    return F.struct(value.alias("original"), form.otherwise(repaired(value)).alias("standardized"), standard_key(value).alias("comparison_key"))


def normalized(value: Column) -> Column:
    """Single blanks, and accented capitals inside words lower-cased."""
    return collapse_spaces(lower_inner_accents(value))


def title_case(value: Column) -> Column:
    """Each run of letters with one capital, also after digits and apostrophes."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def name_quality(name: Column) -> Column:
    """How well a text would do as the name of a group: accents and a capital first count for it, capitals, doubled letters, brands and signs against it."""
    letters, capitals = F.length(F.regexp_replace(name, r"\P{L}", "")), F.length(F.regexp_replace(name, r"\P{Lu}", ""))
    share = capitals / F.nullif(letters, F.lit(0))
    lower, upper = F.lower(name), F.upper(name)
    all_capitals = (name == upper) & (lower != upper)
    rules = [
        (F.coalesce((share > 0.6) & (letters > 5), F.lit(False)), -50),
        (F.coalesce((share > 0.4) & (letters > 10) & ~((share > 0.6) & (letters > 5)), F.lit(False)), -30),
        ((name == lower) & (F.length(name) > 3), -30),
        (is_doubled(name), -1000),
        (name.rlike("[a-z][A-Z]"), -20),
        (lower.rlike("[a-záéíóúñ]{16,}") & ~name.contains(" "), -30),
        (name.rlike(r"^\p{Lu}") & ~all_capitals, 15),
        (name.contains("*") | name.contains("+"), -15),
        (name.contains("Cab."), -20),
        (name.rlike("[A-ZÁÉÍÓÚÑ]{5,}") & ~all_capitals, -25),
        ((F.length(name) > 5) & (F.length(name) < 50), 5),
        *((name.contains(c), 8) for c in "áéíóúñ"),
        *((name.contains(c), 3) for c in "ÁÉÍÓÚÑ"),
        *((lower.contains(b), -40) for b in BRANDS),
    ]
    return reduce(lambda total, rule: total + F.when(rule[0], rule[1]).otherwise(0), rules, F.lit(0))


def input_stem(name: Column) -> Column:
    """An input's name in lower case without pack sizes, formulation codes and numbers; every other sign, accented letters too, is a blank."""
    bare = reduce(lambda v, pattern: F.regexp_replace(v, pattern, " "), SUFFIXES, F.lower(name))
    return collapse_spaces(F.regexp_replace(bare, r"[^a-z0-9\s]", " "))


def _picture_text(name: Column) -> Column:
    return collapse_spaces(F.lower(F.regexp_replace(name, r"[*+]+$", "")))


def base_product(name: Column, category: Column) -> Column:
    """The key of a product's picture: the slug of what it is, without cut, state or region."""
    text = _picture_text(name)
    head = F.trim(F.substring_index(text, ",", 1))
    fish = reduce(lambda v, word: F.trim(F.regexp_replace(v, rf"\b{word}\b", "")), FISH_WORDS, head)
    produce = F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(REGION_WORDS)), " ")
    return F.when(category == "Carnes", slug(head)).when(text.contains("huevo"), "huevo").when(category == "Pescados", slug(fish)).otherwise(slug(produce))


def searched_product(name: Column, category: Column) -> Column:
    """The words by which a product's picture is sought: as ``base_product``, but with rules for cheese, processed food and grain, and no slug."""
    text = _picture_text(name)
    head = F.trim(F.substring_index(text, ",", 1))
    fish = reduce(lambda v, word: F.trim(F.replace(v, F.lit(word), F.lit(""))), FISH_WORDS, head)
    produce = F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(REGION_WORDS)), " ")
    rules = [(category == "Carnes", head), (text.contains("huevo"), F.lit("huevo")), (text.contains("queso"), text), (category == "Pescados", fish), (category == "Procesados", text)]
    rules += [(text.rlike("fr[ií]jol"), F.lit("frijol")), (text.contains("arroz"), F.lit("arroz")), (text.rlike("ma[ií]z"), F.lit("maiz"))]
    return F.coalesce(*(F.when(rule, words) for rule, words in rules), produce)


def _fixed(value: Column, places: int) -> Column:
    """``value`` with ``places`` decimals, halves away from zero."""
    return F.round(value.cast("decimal(38,12)"), places).cast(f"decimal(38,{places})").cast("string")


def pesos(value: Column) -> Column:
    """Whole pesos with dots for thousands; a dash for null."""
    return F.coalesce(F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$ "), F.translate(F.format_number(F.abs(F.round(value.cast("decimal(38,12)"), 0)), 0), ",", ".")), F.lit("—"))


def compact_pesos(value: Column) -> Column:
    """'$1.2M', '$3K' or '$900'; a dash for null."""
    big = F.when(value >= 1_000_000, F.concat(F.lit("$"), _fixed(value / 1_000_000, 1), F.lit("M"))).when(value >= 1000, F.concat(F.lit("$"), _fixed(value / 1000, 0), F.lit("K")))
    return F.coalesce(big.otherwise(F.concat(F.lit("$"), _fixed(value, 0))), F.lit("—"))


def kilograms(value: Column) -> Column:
    """'1.2M kg', '3.4K kg' or '900 kg'; a dash for null."""
    big = F.when(value >= 1_000_000, F.concat(_fixed(value / 1_000_000, 1), F.lit("M kg"))).when(value >= 1000, F.concat(_fixed(value / 1000, 1), F.lit("K kg")))
    return F.coalesce(big.otherwise(F.concat(_fixed(value, 0), F.lit(" kg"))), F.lit("—"))


def signed_percent(value: Column) -> Column:
    """'+1.5%' or '-2.0%'; a dash for null."""
    return F.coalesce(F.concat(F.when(value >= 0, "+").otherwise(""), _fixed(value, 1), F.lit("%")), F.lit("—"))


def short_date(date: Column) -> Column:
    """'<day> <month form>'."""
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), F.get(F.array(*map(F.lit, MONTH_FORMS)), F.month(date) - 1))


def medium_date(date: Column) -> Column:
    """'<day> de <month> <year>'."""
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(" de "), F.get(F.array(*map(F.lit, MONTHS)), F.month(date) - 1), F.lit(" "), F.year(date).cast("string"))


def price_context(presentation: Column, units: Column) -> Column:
    """Both that are neither null nor empty, with a dot between them."""
    return F.concat_ws(" · ", F.nullif(presentation, F.lit("")), F.nullif(units, F.lit("")))
