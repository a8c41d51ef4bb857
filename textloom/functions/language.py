"""Language-aware text functions as native expressions.

Tags, keys, tokens, shingles and content flags of a corpus row.  Only Unicode
compatibility normalisation needs Python (Arrow batches, ASCII left alone).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

TOKEN = r"[\p{L}\p{N}_]+"
#: Strip of Unicode white space; Spark's trim knows only the blank.
STRIP = r"(?U)^\s+|\s+$"

# Digits and letters of Arabic script that are written in several ways, and marks that are left out.
ARABIC_FROM, ARABIC_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹يكةۀأإ", "01234567890123456789یکههاا"
ARABIC_MARKS = "[\u064b-\u0652\u0670\u0640\u200c\u200d\u200e\u200f]"
# Script of each language that content flags know, and its characters.
SCRIPTS = {"en": "Latin", "ru": "Cyrillic", "fa": "Arabic", "ar": "Arabic"}
SCRIPT_RANGE = {"Latin": "[A-Za-zÀ-ɏ]", "Cyrillic": "[Ѐ-ӿ]", "Arabic": "[؀-ۿݐ-ݿﭐ-\ufdffﹰ-\ufeff]"}
# Units that make a number a quantity, by language.
LATIN_UNITS = "%|mm|cm|km|kg|mg|g|ml|l|s|ms|hz|khz|mhz|ghz|k|°c|°f|kpa|mpa|mol|ppm|db|nm|µm|um|ev|kev|mev|gev|w|kw|mw|v|mv|a|ma"
CYRILLIC_UNITS = "%|мм|см|км|м|кг|мг|г|мл|л|мс|с|мин|ч|тыс|млн|млрд|°с|гц|кгц|мгц|ггц|вт|квт|мвт|в|мв|а|ма|моль"
PERSIAN_UNITS = "%|درصد|میلیمتر|سانتیمتر|کیلومتر|متر|کیلوگرم|میلیگرم|گرم|میلیلیتر|لیتر|ثانیه|دقیقه|ساعت|هرتز|ولت|وات|مول"
UNITS = {"en": LATIN_UNITS, "ru": CYRILLIC_UNITS, "fa": PERSIAN_UNITS, "ar": PERSIAN_UNITS}
# Acronyms, where the script has case; mathematics and statistics.
ACRONYM = {"en": r"\b[A-Z]{2,6}s?\b", "ru": r"\b[А-ЯЁ]{2,6}\b|\b[A-Z]{2,6}s?\b"}
MATH = r"(\$[^$]+\$|\\\(|\\\[|\\frac|\\sum|\\int|\\alpha|\\beta|\\gamma|\\lambda|\\sigma|[=<>≤≥±∓×÷√∞∈∉⊂⊆∪∩∑∏∫∂∇Δ∆]|\b[a-zA-Z]\s*\^\s*[0-9n]|\b[xyz]\s*=)"
STATISTICS = r"\b[pP]\s*[<>=]\s*0?\.\d+|\bn\s*=\s*\d+|\bCI\b|\br\s*=\s*[-0.]|\bF\(\d"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def language_tag(c: Column) -> Column:
    """Primary subtag: lower case, stripped, before '-' or '_'; 'und' if empty."""
    return F.coalesce(F.nullif(F.lower(F.element_at(F.split(strip(c), "[-_]"), 1)), F.lit("")), F.lit("und"))


def pair_key(src: Column, tgt: Column) -> Column:
    return F.concat_ws("-", language_tag(src), language_tag(tgt))


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def folded(c: Column, lang: Column) -> Column:
    """*c* with the spellings of its language made one: Arabic-script letters, digits and marks; Russian yo."""
    arabic = F.regexp_replace(F.translate(c, ARABIC_FROM, ARABIC_TO), ARABIC_MARKS, "")
    return F.when(lang.isin("fa", "ar"), arabic).when(lang == "ru", F.translate(c, "ёЁ", "еЕ")).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def text_key(c: Column) -> Column:
    """Words joined by one blank: the canonical key of a text."""
    return F.array_join(tokens(c), " ")


def language_key(c: Column, lang: Column) -> Column:
    """Canonical key after normalisation and folding by language."""
    return text_key(folded(nfkc(c), lang))


def let(value: Column, body) -> Column:
    """body(value) with *value* computed once: inside lambdas an expression would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(words: Column, n: int) -> Column:
    """Word n-grams in order; *words* must be a column or a lambda variable."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams; a shorter text is one shingle of all its words, none of none."""
    def body(w: Column) -> Column:
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.coalesce(F.array_distinct(grams(w, n)), short)

    return let(words, body)


def length_bucket(n: Column, edges: tuple[int, ...] = (0, 15, 40, 80, 999_999)) -> Column:
    """Label of the half-open bucket of a number of words; from the last edge on the last label."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = (n >= lo) & (n < hi)
        out = F.when(cond, f"len_{lo}_{hi}") if out is None else out.when(cond, f"len_{lo}_{hi}")
    return out.otherwise(f"len_{edges[-2]}_{edges[-1]}")


def document_key(document_id: Column, sample_id: Column, namespace: Column | None, prefix: str = "src", separator: str = ":") -> Column:
    """Document of a row: what stands before the separator, within its source or batch; a row without one is its own."""
    name = F.split_part(document_id, F.lit(separator), F.lit(1))
    named = name if namespace is None else F.concat(F.lit(prefix), F.coalesce(namespace.cast("string"), F.lit("None")), F.lit(":"), name)
    return F.when(document_id.isNull() | (document_id == ""), F.concat(F.lit("sample:"), sample_id.cast("string"))).otherwise(named)


def has_math(c: Column) -> Column:
    return F.coalesce(c.rlike("(?U)" + MATH), F.lit(False))


def has_numbers_units(c: Column, lang: Column) -> Column:
    """A number with a unit of the language, or statistical notation."""
    units = F.lit(False)
    for tag, names in UNITS.items():
        units = F.when(lang == tag, c.rlike(rf"(?iU)\b\d+(\.\d+)?\s*({names})\b")).otherwise(units)
    return F.coalesce(units | c.rlike("(?U)" + STATISTICS), F.lit(False))


def has_acronyms(c: Column, lang: Column) -> Column:
    """Two to six capitals; only in languages whose script has case."""
    out = F.lit(False)
    for tag, pattern in ACRONYM.items():
        out = F.when(lang == tag, c.rlike("(?U)" + pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def has_mixed_script(source: Column, target: Column, src: Column, tgt: Column) -> Column:
    """The other side's script in a text, where both scripts are known and differ."""
    out = F.lit(False)
    for a, sa in SCRIPTS.items():
        for b, sb in SCRIPTS.items():
            if sa != sb:
                out = F.when((src == a) & (tgt == b), source.rlike(SCRIPT_RANGE[sb]) | target.rlike(SCRIPT_RANGE[sa])).otherwise(out)
    return F.coalesce(out, F.lit(False))


def supported_features(src: str, tgt: str) -> set[str]:
    """Flags that a language pair can have; all but mixed script are the source's."""
    known = {"has_math", "is_rare_term"}
    if src in UNITS:
        known.add("has_numbers_units")
    if src in ACRONYM:
        known.add("has_acronyms")
    if src in SCRIPTS and tgt in SCRIPTS and SCRIPTS[src] != SCRIPTS[tgt]:
        known.add("has_mixed_script")
    return known


def comparison_group(scope: str, src: Column, tgt: Column) -> Column:
    """Key within which texts are compared: language pair, one side's language, or everything."""
    if scope == "pair":
        return pair_key(src, tgt)
    if scope == "source":
        return language_tag(src)
    if scope == "target":
        return language_tag(tgt)
    if scope == "any":
        return F.lit("any")
    raise ValueError(f"unknown comparison scope {scope!r}")


def cosine_thresholds(scope: str) -> dict[str, float]:
    """Least cosine of each side: stricter where the side's language is free."""
    same, free = 0.92, 0.97
    return {"source": same if scope in ("pair", "source") else free, "target": same if scope in ("pair", "target") else free}
