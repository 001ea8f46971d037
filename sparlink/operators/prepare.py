"""Prepared records: all text functions of an entity in one projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W


def steps() -> list[dict[str, Column]]:
    """The derived columns, step by step: each step's columns are looked up by the next ones."""
    c = F.col
    join = F.array_join("core_toks", " ")
    bare = F.replace("core", F.lit(" "), F.lit(""))
    cut = lambda n: F.when(F.length(bare) >= n, F.substring(bare, 1, n)).otherwise("")
    return [
        {"norm": X.normalize(c("name")), "norm_addr": X.normalize(c("address")), "cc": X.country_code(c("country")), "non_ascii": X.is_non_ascii_name(c("name")),
         "phones_raw": X.phone_tokens(F.concat(X.blank(c("address")), F.lit(" "), X.blank(c("name"))))},
        {"exp_norm": X.expand_abbreviations(c("norm")), "core_toks": X.core_tokens(c("norm")), "postal": X.first_postal(c("norm_addr")), "clean_addr": X.clean_address(c("norm_addr")),
         "dist_addr": X.distinctive_address(c("norm_addr")), "aliases": X.alias_cores(c("norm")), "cat": X.category_mask(c("norm"))},
        {"core": F.when(join != "", join).otherwise(c("norm")), "exp_core": X.core_name(c("exp_norm")), "sorted_key": F.array_join(F.sort_array("core_toks"), " "),
         "concat_key": F.array_join("core_toks", ""), "brand": X.distinctive_tokens(c("norm")), "num": X.house_number(c("norm_addr"), c("postal")), "phones_addr": X.phone_tokens(c("clean_addr"))},
        {"prefix3": cut(3), "prefix4": cut(4), "bigram": X.bigram_key(c("brand")), "addr_keys": X.address_keys(c("num"), c("dist_addr"))},
        {"num_prefix": X.both(c("num"), c("prefix3")), "post_prefix": X.both(c("postal"), c("prefix3")), "post_num": X.both(c("postal"), c("num")), "pfx4_country": X.both(c("prefix4"), c("cc")),
         "post_prefix4": X.both(c("postal"), c("prefix4"))},
    ]


def calibrated_steps() -> list[dict[str, Column]]:
    """The same columns as the calibrated profile makes them: shorter word lists, nine domains, no core where all words are
    legal forms, aliases as they stand, addresses and countries as normalized, keys with the start of the postal code.
    Columns that none of its routes and scores use are empty."""
    c = F.col
    none, no = F.array().cast("array<string>"), F.lit("")
    generic = W.generic_words_calibrated()
    norm = lambda x: X.normalize(c(x), tuple(W.DOMAINS_CALIBRATED))
    cut = lambda n: F.when(F.length("core") >= n, F.substring("core", 1, n)).otherwise("")
    return [
        {"norm": norm("name"), "norm_addr": norm("address"), "cc": norm("country"), "non_ascii": X.is_non_ascii_name(c("name")), "phones_raw": none, "phones_addr": none, "exp_norm": no, "bigram": no},
        {"core_toks": X.core_tokens(c("norm"), W.LEGAL_CALIBRATED), "postal": X.postal_in_two_formats(c("norm_addr")), "clean_addr": c("norm_addr"), "dist_addr": X.distinctive_address_words(c("norm_addr")),
         "aliases": X.alias_parts(c("norm"), W.ALIAS_WORDS_CALIBRATED), "cat": X.category_mask_inside(c("norm")), "num": X.street_number(c("norm_addr"))},
        {"core": F.array_join("core_toks", " "), "exp_core": no, "sorted_key": F.array_join(F.sort_array("core_toks"), " "), "concat_key": F.array_join("core_toks", ""),
         "brand": F.slice(F.filter("core_toks", lambda x: ~x.isin(*generic) & (F.length(x) >= 4)), 1, 5)},
        {"prefix3": cut(3), "prefix4": cut(4)},
        {"num_prefix": X.both(c("num"), F.substring("postal", 1, 3)), "post_prefix": X.both(c("postal"), c("prefix3")), "post_num": X.both(c("postal"), c("num")), "pfx4_country": no,
         "post_prefix4": X.both(c("postal"), c("prefix4"))},
        {"addr_keys": F.when((c("post_num") != "") & (c("prefix3") != ""), F.array(F.concat_ws("_", "num", "postal", "prefix3"))).otherwise(none)},
    ]


#: The ways of making records, by the name that a profile gives.
TEXTS = {"standard": steps, "calibrated": calibrated_steps}


def prepare_all(*entities: DataFrame, text: str = "standard") -> list[DataFrame]:
    """Tables of entities(entity_id, name, address, country, ...) with the derived columns of a record.

    Nulls count as missing (""). No shuffle; the expressions are made once for all tables.
    """
    out = list(entities)
    for columns in TEXTS[text]():
        out = [e.withColumns(columns) for e in out]
    return out


def prepare(entities: DataFrame, text: str = "standard") -> DataFrame:
    return prepare_all(entities, text=text)[0]
