"""Text functions of names, addresses and countries, as Columns. Null is the empty string throughout."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Legal suffixes by canonical form.
SUFFIXES = {
    "limited liability company": ["limited liability company", "limited liability co", "l.l.c", "llc", "l l c"],
    "limited liability partnership": ["limited liability partnership", "l.l.p", "llp", "l l p"],
    "incorporated": ["incorporated", "inc", "inc."],
    "corporation": ["corporation", "corp", "corp."],
    "limited": ["limited", "ltd", "ltd."],
    "company": ["company", "co", "co."],
    "private limited": ["private limited", "pvt ltd", "pvt. ltd", "pvt. ltd.", "pvt ltd.", "private ltd", "p ltd", "p. ltd"],
    "public limited company": ["public limited company", "plc", "p.l.c"],
    "gesellschaft mit beschränkter haftung": ["gesellschaft mit beschränkter haftung", "gmbh", "g.m.b.h"],
    "société à responsabilité limitée": ["société à responsabilité limitée", "sarl", "s.a.r.l"],
    "société anonyme": ["société anonyme", "sa", "s.a"],
    "enterprises": ["enterprises", "enterprise", "ent", "ents"],
    "brothers": ["brothers", "bros", "bros."],
    "and sons": ["and sons"],
    "trading": ["trading", "trdg"],
    "industries": ["industries", "ind", "inds"],
    "services": ["services", "svc", "svcs"],
    "solutions": ["solutions", "soln", "solns"],
    "international": ["international", "intl", "int'l"],
    "associates": ["associates", "assoc", "assocs"],
    "group": ["group", "grp"],
}
# Abbreviations of addresses, in order.
ABBREVIATIONS = [
    (r"\bst\b\.?", "street"), (r"\bave?\b\.?", "avenue"), (r"\bblvd\b\.?", "boulevard"), (r"\brd\b\.?", "road"), (r"\bdr\b\.?", "drive"),
    (r"\bln\b\.?", "lane"), (r"\bct\b\.?", "court"), (r"\bpl\b\.?", "place"), (r"\bsq\b\.?", "square"), (r"\bpky\b\.?", "parkway"),
    (r"\bpkwy\b\.?", "parkway"), (r"\bflr\b\.?", "floor"), (r"\bapt\b\.?", "apartment"), (r"\bste\b\.?", "suite"), (r"\bno\b\.?(?=\s*\d)", "number"),
]
# Countries by their aliases.
COUNTRIES = {
    "usa": "united states", "us": "united states", "u.s.": "united states", "u.s.a.": "united states", "united states of america": "united states", "united states": "united states", "america": "united states",
    "india": "india", "in": "india", "bharat": "india", "ind": "india",
    "france": "france", "fr": "france", "french republic": "france",
    "uk": "united kingdom", "u.k.": "united kingdom", "united kingdom": "united kingdom", "great britain": "united kingdom", "england": "united kingdom", "britain": "united kingdom",
    "germany": "germany", "de": "germany", "deutschland": "germany",
    "canada": "canada", "ca": "canada",
    "australia": "australia", "au": "australia",
    "china": "china", "cn": "china", "prc": "china",
    "japan": "japan", "jp": "japan",
}
# Words left out of core names and of addresses.
NAME_STOPWORDS = "the and of for in to at a an on by services solutions traders enterprise enterprises international retail group holdings management industries associates global national center centre".split()
ADDRESS_STOPWORDS = "street st road rd avenue ave drive dr lane ln blvd boulevard court ct way highway hwy floor fl suite ste unit apt apartment building bldg room rm nagar colony marg chowk bazar bazaar district dist state city near opposite opp behind north south east west po box pobox pvt ltd".split()
# Invisible characters, white space, separators of tokens, repeated punctuation, domains.
INVISIBLE = r"[​-‍­﻿‎‏‪-‮]"
SPACES = r"(?U)[\s\x1c-\x1f  　]+"
SEPARATORS = r"(?U)[\s\x1c-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"


REPEATED = r"(?U)([.,\-/()])(?:\s*\1)+"
SCHEME = r"^(https?://)?(www\.)?"
DOMAINS = r"(?U)(\.com|\.org|\.net|\.in|\.co|\.io|\.biz|\.info|\.us|\.fr)\b"
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _composed(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFC", x)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(_composed)


@F.pandas_udf(ArrayType(StringType()))
def _nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [_composed(x) for x in xs])


def composed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns: texts without invisible characters, in NFC. One call of Python for all of them."""
    both = df.withColumn("_nfc", _nfc_each(F.array(*[visible(c) for c in columns.values()])))
    return both.withColumns({name: F.col("_nfc")[i] for i, name in enumerate(columns)}).drop("_nfc")


def to_string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACES, " "))


def visible(c: Column) -> Column:
    return F.regexp_replace(to_string(c), INVISIBLE, "")


def strip(c: Column) -> Column:
    """No white space at the ends, whichever it is."""
    return F.regexp_replace(c, ENDS, "")


def clean_text(c: Column, nfc: bool = True) -> Column:
    """Without invisible characters, composed (NFC), white space squeezed; the case stays. nfc=False: c is composed already."""
    return squeeze(_nfc(visible(c)) if nfc else visible(c))


def _single_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, REPEATED, "$1")


def clean_business_name(c: Column, nfc: bool = True) -> Column:
    s = _single_punctuation(F.lower(clean_text(c, nfc)))
    s = F.regexp_replace(s, r"(?U)(?<=\s)&(?=\s)|^&(?=\s)|(?<=\s)&$", "and")
    return squeeze(F.btrim(s, F.lit(".,;:!?\"'")))


normalize_business_name = clean_business_name


def _suffix_pattern() -> str:
    variants = sorted({v for vs in SUFFIXES.values() for v in vs}, key=lambda v: (-len(v), v))
    return r"(?U)[\s\x1c-\x1f,]+(?:" + "|".join(re.escape(v).replace("\\'", "'") for v in variants) + r")[\s\x1c-\x1f]*$"


def strip_legal_suffixes(c: Column) -> Column:
    """One trailing suffix less, the longest that fits, with dots, commas and colons off the end; a name without one is only stripped. Suffixes are in lower case, so the name must be."""
    s = strip(to_string(c))
    pattern = _suffix_pattern()
    return F.when(s.rlike(pattern), F.btrim(strip(F.regexp_replace(s, pattern, "")), F.lit(".,;: "))).otherwise(s)


fast_strip_legal_suffixes = strip_legal_suffixes


def strip_all_suffixes(c: Column, nfc: bool = True) -> Column:
    """Suffixes off until none is left. Each takes a separator with it, so there are no more rounds than separators."""
    s = clean_business_name(c, nfc)
    rounds = F.sequence(F.lit(1), F.greatest(F.regexp_count(s, F.lit(r"(?U)[\s\x1c-\x1f,]+")), F.lit(1)))
    return F.aggregate(rounds, s, lambda name, _: strip_legal_suffixes(name))


def clean_address(c: Column, nfc: bool = True) -> Column:
    s = reduce(lambda x, p: F.regexp_replace(x, "(?U)" + p[0], p[1]), ABBREVIATIONS, F.lower(clean_text(c, nfc)))
    return squeeze(_single_punctuation(s))


normalize_address = clean_address


def normalize_country(c: Column, nfc: bool = True) -> Column:
    s = F.lower(clean_text(c, nfc))
    table = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, s), s)


def extract_tokens(c: Column, nfc: bool = True) -> Column:
    """Different tokens, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(clean_text(c, nfc)), SEPARATORS), lambda x: x != "")))


def extract_numeric_tokens(c: Column, nfc: bool = True) -> Column:
    """Different digit runs, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(clean_text(c, nfc), F.lit(r"(?U)(\d+)"), F.lit(1))))


def strip_domains_and_noise(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(to_string(c)), SCHEME, ""), DOMAINS, " ")


def core_name(c: Column) -> Column:
    """The name of which core tokens are made."""
    return strip_legal_suffixes(strip_domains_and_noise(c))


def core_tokens(c: Column, nfc: bool = True) -> Column:
    """Tokens of a core_name that tell names apart."""
    stop = F.array(*[F.lit(w) for w in NAME_STOPWORDS])
    return F.filter(extract_tokens(c, nfc), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def extract_core_name_tokens(c: Column, nfc: bool = True) -> Column:
    return core_tokens(core_name(c), nfc)


fast_extract_core_name_tokens = extract_core_name_tokens


def without_leading_zeros(numbers: Column) -> Column:
    """One number for each digit run of an array: 06 and 6 give two."""
    return F.transform(numbers, lambda n: F.regexp_replace(n, r"^0+(?=.)", ""))


def extract_normalized_numbers(c: Column, nfc: bool = True) -> Column:
    """Different digit runs without leading zeros, in the order of the runs as they were."""
    return F.array_distinct(without_leading_zeros(extract_numeric_tokens(c, nfc)))


def extract_distinctive_address_tokens(c: Column, nfc: bool = True) -> Column:
    stop = F.array(*[F.lit(w) for w in ADDRESS_STOPWORDS])
    return F.filter(extract_tokens(c, nfc), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike(r"(?U)^\d+$"))


def source_label(c: Column) -> Column:
    return F.when(c.startswith("S1-"), "source1").when(c.startswith("S2-"), "source2").when(c.startswith("S3-"), "source3").otherwise("unknown")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Different substrings of n characters; a shorter text is its only one."""
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))))


def preprocess_dataframe(records: DataFrame) -> DataFrame:
    """records with nine derived columns; a column that is absent counts as empty, the others stay as they are."""
    have = lambda c: F.col(c) if c in records.columns else F.lit("")
    d = composed(records, {"norm_business_name": have("business_name"), "norm_address": have("business_address"), "norm_country": have("country")})
    d = d.withColumns({"norm_business_name": clean_business_name(F.col("norm_business_name"), False), "norm_address": clean_address(F.col("norm_address"), False), "norm_country": normalize_country(F.col("norm_country"), False)})
    d = d.withColumn("norm_business_name_no_suffix", strip_legal_suffixes(F.col("norm_business_name")))
    return d.withColumns({
        "name_tokens": extract_tokens(F.col("norm_business_name"), False), "name_tokens_no_suffix": extract_tokens(F.col("norm_business_name_no_suffix"), False),
        "name_numeric_tokens": extract_numeric_tokens(F.col("norm_business_name"), False), "address_tokens": extract_tokens(F.col("norm_address"), False),
        "address_numeric_tokens": extract_numeric_tokens(F.col("norm_address"), False),
    })


def normalize_records(records: DataFrame) -> DataFrame:
    """records with the three fields replaced by their normal forms."""
    d = preprocess_dataframe(records)
    return d.select(*[F.col({"business_name": "norm_business_name", "business_address": "norm_address", "country": "norm_country"}.get(c, c)).alias(c) for c in records.columns])
