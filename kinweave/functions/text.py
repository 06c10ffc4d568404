"""Text normalization as column expressions.

Latin, Cyrillic and Greek letters are reduced to plain ones by one mapping, the scripts of India by syllables; text of other scripts
stays as it is. NFKC, for which
there is no built-in function, is a pandas UDF that files of records go through once, when they are loaded.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import scripts

# Word lists and mappings that results depend on.
BLANKS = ["nan", "none", "null"]
LEGAL_SUFFIXES = ["llc", "llp", "inc", "incorporated", "corp", "corporation", "company", "co", "limited", "ltd", "private", "pvt", "plc", "pc", "l l c"]
ABBREVIATIONS = [
    ("road", "rd"), ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("highway", "hwy"), ("route", "rte"),
    ("apartment", "apt"), ("suite", "ste"), ("floor", "fl"), ("madhya pradesh", "mp"), ("uttar pradesh", "up"),
]
LATIN = ("øłđħŧıðŋ", "oldhtidn")
CYRILLIC = ("абвгдезийклмнопрстуфыэёіїґў", "abvgdeziiklmnoprstufyeeiigu")
GREEK = ("αβγδεζηικλμνξορσςτυωάέήίόύώϊϋΐΰ", "abgdezeiklmnxorsstuoaeeiouoiuiu")
SILENT = "ьъ"
DOUBLES = [
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "iu"), ("я", "ia"), ("є", "ie"),
    ("θ", "th"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("π", "p"),
]
# By rule: a small Latin letter with marks is the letter that its decomposition begins with.
MARKED = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
MARKED = [(a, b) for a, b in MARKED if a != b and "a" <= b <= "z"]
ACCENTED = "".join(a for a, _ in MARKED) + LATIN[0] + CYRILLIC[0] + GREEK[0] + SILENT  # those without a counterpart go
PLAIN = "".join(b for _, b in MARKED) + LATIN[1] + CYRILLIC[1] + GREEK[1]
SEPARATORS = r"[^\p{L}\p{N}_\s]"


def nfkc(text: Column) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(text)


def cleaned(text: Column) -> Column:
    """Null and the words for it become '', others are trimmed and lower-cased."""
    text = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(text.isin(BLANKS), "").otherwise(text)


def squeezed(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    for pattern in (r"https?://|www\.", SEPARATORS, r"\s+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


def normalize_text(text: Column) -> Column:
    return squeezed(cleaned(text))


def normalize_latin(text: Column) -> Column:
    text = F.translate(scripts.latin(cleaned(text)), ACCENTED, PLAIN)
    for a, b in DOUBLES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return squeezed(cleaned(text))


def tokens(text: Column) -> Column:
    """Words of a normalized text; '' has none."""
    return F.array_remove(F.split(text, " "), "")


def core_name(name: Column) -> Column:
    """A normalized name without legal suffixes."""
    return F.array_join(F.filter(tokens(name), lambda t: ~t.isin(LEGAL_SUFFIXES)), " ")


def normalize_address(text: Column) -> Column:
    text = normalize_latin(text)
    for a, b in ABBREVIATIONS:
        text = F.regexp_replace(text, rf"\b{a}\b", b)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+)"))


def country_key(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))
