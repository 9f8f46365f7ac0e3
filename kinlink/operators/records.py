"""What blocking and matching need of a record, made once per record and not once per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns that pairs are blocked by, and those that they are compared by.
BLOCKING = ("core_tokens", "address_words", "address_numbers", "name_words", "country")
MATCHING = ("name", "core", "address", "country", "name_tokens", "address_tokens", "numbers", "name_grams", "address_grams")


def prepare(records: DataFrame) -> DataFrame:
    """entity_id, pos and raw_country of records, and the derived columns above; an absent column is empty.

    All text is composed in one call of Python; everything else is built in."""
    have = lambda c: F.col(c) if c in records.columns else F.lit("")
    keep = {"entity_id": F.col("entity_id"), "pos": F.col("pos") if "pos" in records.columns else F.lit(0).cast("long"), "raw_country": T.strip(T.to_string(have("country")))}
    texts = {"name": have("business_name"), "address": have("business_address"), "country": have("country"), "core_name": T.core_name(have("business_name"))}
    d = T.composed(records.select(*[c.alias(n) for n, c in keep.items()], *[c.alias(n) for n, c in texts.items()]), {n: F.col(n) for n in texts})
    name, address = F.col("name"), F.col("address")
    d = d.withColumns({
        "core_tokens": T.core_tokens(F.col("core_name"), False), "address_words": T.extract_distinctive_address_tokens(address, False), "address_numbers": T.extract_normalized_numbers(address, False),
        "name_words": F.filter(T.extract_tokens(T.clean_address(name, False), False), lambda t: F.length(t) >= 3), "country": T.normalize_country(F.col("country"), False),
        "core": T.strip_all_suffixes(name, False), "name": T.clean_business_name(name, False), "address": T.clean_address(address, False),
    })
    d = d.withColumns({
        "name_tokens": T.extract_tokens(name, False), "address_tokens": T.extract_tokens(address, False), "numbers": F.array_union(T.extract_numeric_tokens(address, False), T.extract_numeric_tokens(name, False)),
        "name_grams": T.char_ngrams(name), "address_grams": T.char_ngrams(address),
    })
    return d.select(*keep, *dict.fromkeys([*BLOCKING, *MATCHING]))
