"""Text functions: number and date parsing, clean-up, comparison keys and formatting, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their usual three-letter forms.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
MONTH_FORMS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]

#: White space of any script, as a class of regular expressions.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """By compatibility decomposition without marks: letters that become one other, these others, and letters that become several.

    The marks, which stand for nothing, end the first text. Syllables of Hangul, which a rule composes, stay.
    """
    letters, plain, marks, several = [], [], [], {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0)):
        char = chr(code)
        rest = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if unicodedata.combining(char):
            marks.append(char)
        elif len(rest) == 1 and rest != char:
            letters.append(char)
            plain.append(rest)
        elif len(rest) > 1:
            several[char] = rest
    return "".join(letters + marks), "".join(plain), several


ACCENTED, PLAIN, SEVERAL = _plain_letters()


def _runs(chars: list[str]) -> str:
    """Sorted ``chars`` as ranges of a class: a class tries its parts one after another, so it should have few."""
    runs: list[list[int]] = []
    for code in map(ord, chars):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in runs)


# Plain letters fail at the first part and never reach the ranges.
_SEVERAL = rf"[\x{{{ord(min(SEVERAL)):X}}}-\x{{FFFF}}&&[{_runs(sorted(SEVERAL))}]]"
# Letters that canonical decomposition reduces to one of ASCII.
_LATIN = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x2200) if unicodedata.normalize("NFD", chr(c))[0].isascii()}


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of ``value``, which is worked out once however often ``build`` names it; branches would work it out again."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def stripped(value: Column) -> Column:
    """A text without white space of any script at its ends."""
    return F.regexp_replace(value, f"^{BLANK}+|{BLANK}+$", "")


def parse_price(value: Column) -> Column:
    """A positive number from text with dots for thousands and a comma for decimals; otherwise null, also for words such as 'nan'."""
    plain = F.translate(F.translate(stripped(value), ".", ""), ",", ".")
    # What is no number is extracted as an empty text, and that is none.
    number = F.regexp_extract(plain, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0).try_cast("double")
    return F.when(number > 0, number)


def month_number(name: Column) -> Column:
    """1 to 12 by the name's first three letters; null if they name no month."""
    place = F.array_position(F.array(*map(F.lit, MONTH_FORMS)), F.lower(F.left(name, F.lit(3))))
    return F.nullif(place, F.lit(0)).cast("int")


def named_month(name: Column) -> Column:
    """1 to 12 by the whole Spanish name, whatever its case; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)), F.lit(0)).cast("int")


def short_month(name: Column) -> Column:
    """1 to 12 by a form of three letters, or 'sept'; null for anything else."""
    form = F.when(F.lower(name) == "sept", "sep").otherwise(F.lower(name))
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTH_FORMS)), form), F.lit(0)).cast("int")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers as text or int; null if there is none."""
    joined = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(joined, F.lit("yyyy-MM-dd")).cast("date"))


def parse_spanish_date(value: Column) -> Column:
    """The date of '<day> de <month> de <year>' anywhere in a text; an unknown month counts as January, an impossible date is null."""
    pattern = r"(?i)(\d{1,2})\s+de\s+([\p{L}\p{N}_]+)\s+de\s+(\d{4})"
    part = lambda v, k: F.nullif(F.regexp_extract(v, pattern, k), F.lit(""))
    found = lambda v: calendar_date(part(v, 3), F.coalesce(named_month(part(v, 2)), F.lit(1)), part(v, 1))
    # The parts are looked for in the date alone, and only where there is one.
    return once(F.regexp_extract(value, pattern, 0), lambda v: F.when(v != "", found(v)))


def dated_text(value: Column, default_year: Column | None = None) -> Column:
    """The date of '<day> de <month> [de] <year>', or of '<day> de <month>' in ``default_year``; unknown months give none."""
    return once(F.lower(F.trim(value)), lambda text: _dated_text(text, default_year))


def _dated_text(text: Column, default_year: Column | None) -> Column:
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    whole, short = r"(\d{1,2})\s+de\s+([a-záéíóú]+)(?:\s+de)?\s+(\d{4})", r"(\d{1,2})\s+de\s+([a-záéíóú]+)"
    found = calendar_date(part(whole, 3), named_month(part(whole, 2)), part(whole, 1))
    if default_year is None:
        return found
    return F.coalesce(found, calendar_date(default_year, named_month(part(short, 2)), part(short, 1)))


def split_city_market(value: Column) -> Column:
    """(city, market): 'City (Region), Market', 'City (Region)', 'City, D.C., Market' at the last comma, else at the first comma."""
    return once(F.trim(value), _city_market)


def _city_market(text: Column) -> Column:
    region_market, region = r"^(.+?)\s*\([^)]+\)\s*,\s*(.+)$", r"^(.+?)\s*\([^)]+\)$"
    parts = F.split(text, ",")
    capital = text.contains("D.C.") & (F.size(parts) >= 3)
    cut = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ",")
    part = lambda pattern, k: F.trim(F.regexp_extract(text, pattern, k))
    city = F.when(text.rlike(region_market), part(region_market, 1)).when(text.rlike(region), part(region, 1)).when(capital, F.trim(cut)).otherwise(F.trim(F.substring_index(text, ",", 1)))
    after = F.trim(F.regexp_replace(text, r"^[^,]*,?", ""))
    market = F.when(text.rlike(region_market), part(region_market, 2)).when(text.rlike(region), "").when(capital, F.trim(F.substring_index(text, ",", -1))).otherwise(after)
    return F.struct(city.alias("city"), market.alias("market"))


def split_at_last_comma(value: Column) -> Column:
    """(city, market) at the last comma; 'Bogotá, D.C.,' keeps its own."""
    text = F.trim(value)
    capital = text.rlike("^Bogot[áa], D\\.C\\.,")
    tail = F.when(capital, F.regexp_replace(text, r"^[^,]*,[^,]*,", "")).otherwise(F.substring_index(text, ",", -1))
    head = F.when(capital, F.regexp_replace(F.regexp_extract(text, r"^([^,]*,[^,]*),", 1), r"\s*,\s*", ", ")).otherwise(F.regexp_replace(text, r",[^,]*$", ""))
    return F.struct(F.trim(head).alias("city"), F.when(text.contains(","), F.trim(tail)).otherwise("").alias("market"))


def collapse_spaces(value: Column) -> Column:
    """Runs of white space of any script as one blank, none at the ends."""
    # Single blanks, by far most of the runs, are not matched.
    other = rf"[\x00-\x1F\x{{80}}-\x{{3000}}&&{BLANK}]"
    return F.trim(F.regexp_replace(value, f" {BLANK}+|{other}{BLANK}*", " "))


def strip_accents(value: Column) -> Column:
    """Letters without their accents and forms, and no marks: compatibility decomposition; ligatures become their letters."""
    letters = F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in SEVERAL.items() if "\n" not in b and "\t" not in b)), F.lit("\n"), F.lit("\t"))
    # Few texts have such letters, and only these are taken apart, and only around them.
    pieces = lambda v: F.regexp_extract_all(v, F.lit(f"{_SEVERAL}|[^{_SEVERAL}]+"), F.lit(0))
    whole = lambda v: F.array_join(F.transform(pieces(v), lambda p: F.coalesce(F.when(F.octet_length(p) <= 3, F.element_at(letters, p)), p)), "")
    plain = lambda v: F.translate(F.when(v.rlike(_SEVERAL), whole(v)).otherwise(v), ACCENTED, PLAIN)
    return once(value, lambda v: F.when(v.rlike(r"[^\x00-\x7F]"), plain(v)).otherwise(v))


def lower_inner_accents(value: Column) -> Column:
    """Upper-case accented letters after a lower-case letter, lower-cased, also in runs: a corrected letter counts as lower-case."""
    run = r"((?<=\p{Ll})[ÁÉÍÓÚÑ]+)"
    pieces = F.regexp_extract_all(value, F.lit(rf"(?s){run}|((?:(?!(?<=\p{{Ll}})[ÁÉÍÓÚÑ]).)+)"), F.lit(0))
    inner = F.regexp_extract_all(value, F.lit(run), F.lit(1))
    # Pieces alternate, so a piece of accented capitals after a first piece that ends in a lower-case letter is a run.
    lowered = F.transform(pieces, lambda p, i: F.when((i > 0) & p.rlike("^[ÁÉÍÓÚÑ]+$") & F.get(pieces, i - 1).rlike(r"\p{Ll}$"), F.lower(p)).otherwise(p))
    return F.when(F.size(inner) > 0, F.array_join(lowered, "")).otherwise(value)


def comparison_key(value: Column) -> Column:
    """Lower case, no accents, only letters, digits and single blanks."""
    # Whatever is no letter or digit becomes a blank, and runs of blanks become one: in one pass that leaves single blanks alone.
    return F.trim(F.regexp_replace(strip_accents(F.lower(value)), " [^a-z0-9]+|[^a-z0-9 ][^a-z0-9]*", " "))


def norm_key(value: Column) -> Column:
    """The key of duplicate candidates: undoubled, no accents, lower case; signs and white space are single blanks. Letters of any script count."""
    plain = F.lower(strip_accents(stripped(undouble(F.coalesce(value, F.lit(""))))))
    return collapse_spaces(F.regexp_replace(plain, r"[^\p{L}\p{N}_]", " "))


def slug(value: Column) -> Column:
    """A name for a file: no accents, lower case, words joined by underscores; other signs than hyphens go."""
    plain = F.regexp_replace(F.translate(value, "".join(_LATIN), "".join(_LATIN.values())), r"[\u0300-\u036F]", "")
    words = F.regexp_replace(stripped(F.lower(plain)), rf"[^A-Za-z0-9_\-{BLANK[1:-1]}]", "")
    joined = F.regexp_replace(F.regexp_replace(words, rf"[_{BLANK[1:-1]}]+", "_"), "-+", "-")
    return F.regexp_replace(joined, "^[_-]+|[_-]+$", "")


def is_doubled(value: Column) -> Column:
    """Whether at least three tenths of the letters at even places are followed by themselves, among four letters or more."""
    size = F.length(value)
    even = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)), F.lit(2))
    pairs = F.size(F.filter(even, lambda i: F.substring(value, i, F.lit(1)) == F.substring(value, i + 1, F.lit(1))))
    return (size >= 4) & (pairs >= size * 0.3)


def undouble(value: Column) -> Column:
    """A text whose letters are doubled ('AAbb') with each pair as one letter; others as they are."""
    return F.when(is_doubled(value), F.regexp_replace(value, r"(?s)(.)\1", "$1")).otherwise(value)


def zero_padded(code: Column, size: int) -> Column:
    """``code`` padded with zeros; longer codes stay whole."""
    return F.when(F.length(code) < size, F.lpad(code, size, "0")).otherwise(code)


def classification_code(value: Column) -> Column:
    """A code without blanks and quotes around it; empty is null."""
    return F.nullif(F.regexp_replace(F.trim(value), "^['\"]+|['\"]+$", ""), F.lit(""))


def compact_number(value: Column) -> Column:
    """Millions as 'x.x M', thousands as 'x.x K', smaller numbers whole."""
    tenth = lambda by: F.format_string("%.1f", F.floor(value / by * 10 + 0.5) / 10)
    whole = F.floor(value + 0.5).cast("string")
    return F.when(F.abs(value) >= 1_000_000, F.concat(tenth(1_000_000), F.lit(" M"))).when(F.abs(value) >= 1000, F.concat(tenth(1000), F.lit(" K"))).otherwise(whole)


def spanish_date(date: Column) -> Column:
    """'<day> <month form> <year>'."""
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), F.get(F.array(*map(F.lit, MONTH_FORMS)), F.month(date) - 1), F.year(date).cast("string"))


def storage_path(date: Column, kind: Column, name: Column) -> Column:
    """yyyy/mm/dd/kind/name, the name without accents and with only safe characters."""
    safe = F.regexp_replace(strip_accents(name), r"[^A-Za-z0-9_ \-.,()]", "")
    return F.concat_ws("/", F.date_format(date, "yyyy/MM/dd"), kind, safe)
