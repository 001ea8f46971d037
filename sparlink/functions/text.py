"""Normalisation of names and addresses, as Column functions. Missing values are empty strings, never null."""
from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import words as W


@lru_cache
def _folds() -> tuple[str, str]:
    """Latin letters with marks and the ASCII letter that their compatibility form leaves."""
    pairs = []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        bare = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(bare) == 1:
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_ascii(text: Column) -> Column:
    """Latin letters without their marks; other non-ASCII characters go. Exact for Latin letters with single-letter bases."""
    return F.regexp_replace(F.translate(text, *_folds()), r"[^\x00-\x7F]", "")


@lru_cache
def _exact_fold():
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return run


def fold_ascii_exact(text: Column) -> Column:
    """The compatibility decomposition's ASCII part for all of Unicode; Arrow batches, for data beyond Latin."""
    return _exact_fold()(text)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_basic(text: Column) -> Column:
    """ASCII, lower case, & spelled out, other marks to spaces, single spaces."""
    low = F.replace(F.lower(fold_ascii(blank(text))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(low, r"[^a-z0-9\s]", " "))


def normalize(text: Column, domains: Sequence[str] = tuple(W.DOMAINS), exact: bool = False) -> Column:
    """As normalize_basic, and without id notes ("[id: 12]"), domain suffixes and @."""
    low = F.replace(F.lower(fold_ascii_exact(blank(text)) if exact else fold_ascii(blank(text))), F.lit("&"), F.lit(" and "))
    low = F.regexp_replace(low, r"[\(\[\{]\s*id\s*:\s*\d+\s*[\)\]\}]", " ")
    low = F.regexp_replace(low, r"\bid\s*:\s*\d+\b", " ")
    low = F.regexp_replace(low, "(" + "|".join(d.replace(".", r"\.") for d in domains) + r")\b", "")
    return squeeze(F.regexp_replace(F.replace(low, F.lit("@"), F.lit(" ")), r"[^a-z0-9\s]", " "))


# Fixed value: the marks that count as spaces there.
PUNCTUATION = r"""[&@#.!?*()\[\]{};:,"'\\/\-_+=|~`]"""


def normalize_punctuation(text: Column) -> Column:
    """Lower-cased ASCII with listed marks as spaces; other symbols stay."""
    return squeeze(F.regexp_replace(F.lower(fold_ascii(blank(text))), PUNCTUATION, " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda x: x != "")


def _mapped(table: dict[str, str]) -> Column:
    """A literal map, as one SQL expression: literals made one by one cost a call each."""
    quoted = lambda xs: ",".join("'" + x.replace("'", "\\'") + "'" for x in xs)
    return F.expr(f"map_from_arrays(array({quoted(table)}), array({quoted(table.values())}))")


def core_tokens(norm: Column, legal: Sequence[str] = W.LEGAL) -> Column:
    return F.filter(tokens(norm), lambda x: ~x.isin(*legal))


def core_name(norm: Column, legal: Sequence[str] = W.LEGAL) -> Column:
    """The core tokens, or the whole normalised name where none is left."""
    core = F.array_join(core_tokens(norm, legal), " ")
    return F.when(core != "", core).otherwise(norm)


def sorted_key(norm: Column) -> Column:
    return F.array_join(F.sort_array(core_tokens(norm)), " ")


def concat_key(norm: Column) -> Column:
    return F.array_join(core_tokens(norm), "")


def distinctive_tokens(norm: Column, least: int = 3) -> Column:
    generic = W.generic_words()
    return F.filter(tokens(norm), lambda x: ~x.isin(*generic) & (F.length(x) >= least))


def alias_parts(norm: Column, words: Sequence[str] = W.ALIAS_WORDS) -> Column:
    """The names around alias words, of three letters and more; empty where the name has no alias word."""
    parts = F.split(norm, r"\b(?:" + "|".join(words) + r")\b")
    return F.when(F.size(parts) > 1, F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 3)).otherwise(F.array().cast("array<string>"))


def alias_cores(norm: Column) -> Column:
    return F.filter(F.transform(alias_parts(norm), lambda x: core_name(x)), lambda x: x != "")


def expand_abbreviations(norm: Column) -> Column:
    table = _mapped(W.ABBREVIATIONS)
    return F.array_join(F.transform(tokens(norm), lambda x: F.coalesce(table[x], x)), " ")


def country_code(country: Column) -> Column:
    c = F.lower(F.trim(blank(country)))
    return F.coalesce(_mapped(W.COUNTRIES)[c], F.substring(c, 1, 2))


def is_non_ascii_name(name: Column) -> Column:
    n = blank(name)
    return (F.length(F.regexp_replace(n, "[^a-zA-Z]", "")) < 3) & (F.length(F.trim(n)) >= 3)


def is_latin(text: Column) -> Column:
    return ~blank(text).rlike(r"[^\x00-\x7F]")


def first_postal(norm_address: Column) -> Column:
    return F.regexp_extract(norm_address, r"\b(\d{5,6})\b", 1)


def postal_in_two_formats(norm_address: Column) -> Column:
    """The first number of five digits, else of six that doesn't begin with 0."""
    five, six = F.regexp_extract(norm_address, r"\b(\d{5})\b", 1), F.regexp_extract(norm_address, r"\b([1-9]\d{5})\b", 1)
    return F.when(five != "", five).otherwise(six)


def distinctive_address_words(norm_address: Column, n: int = 8) -> Column:
    """The first n words of three letters and more that are neither common nor numbers, in their order, with repeats."""
    common = W.generic_address_words_calibrated()
    return F.slice(F.filter(tokens(norm_address), lambda x: (F.length(x) >= 3) & ~x.isin(*common) & ~x.rlike(r"^\d+$")), 1, n)


def house_number(norm_address: Column, postal: Column) -> Column:
    """The first number of up to five digits and a letter that isn't the postal code."""
    return F.coalesce(F.get(F.filter(F.regexp_extract_all(norm_address, F.lit(r"\b(\d{1,5}[a-z]?)\b"), F.lit(1)), lambda x: x != postal), F.lit(0)), F.lit(""))


def clean_address(norm_address: Column) -> Column:
    table = _mapped(W.STATES | W.STREETS)
    return F.array_join(F.transform(tokens(norm_address), lambda x: F.coalesce(table[x], x)), " ")


def distinctive_address(norm_address: Column) -> Column:
    """The sorted set of words of three letters and more that are neither common nor numbers."""
    common = W.generic_address_words()
    return F.array_sort(F.array_distinct(F.filter(tokens(norm_address), lambda x: (F.length(x) >= 3) & ~x.isin(*common) & ~x.rlike(r"^\d+$"))))


def phone_tokens(raw: Column) -> Column:
    """Runs of ten digits and more, then runs of seven to nine (also cut out of longer ones)."""
    bare = F.regexp_replace(blank(raw), r"[\s\-\(\)\+\.]", "")
    return F.concat(F.regexp_extract_all(bare, F.lit(r"(\d{10,})"), F.lit(1)), F.regexp_extract_all(bare, F.lit(r"(\d{7,9})"), F.lit(1)))


def prefix_key(norm: Column, n: int) -> Column:
    core = F.replace(core_name(norm), F.lit(" "), F.lit(""))
    return F.when(F.length(core) >= n, F.substring(core, 1, n)).otherwise("")


def first_token_prefix(norm: Column, n: int, least: int) -> Column:
    first = F.coalesce(F.get(core_tokens(norm), F.lit(0)), F.lit(""))
    return F.when(F.length(first) >= least, F.substring(first, 1, n)).otherwise("")


def bigram_key(distinctive: Column) -> Column:
    return F.array_join(F.sort_array(F.slice(distinctive, 1, 2)), "_")


def smallest_pair_key(core: Column) -> Column:
    return F.when(F.size(core) >= 2, F.array_join(F.slice(F.sort_array(core), 1, 2), "_")).otherwise("")


def address_keys(number: Column, distinctive: Column, n: int = 2) -> Column:
    keys = F.transform(F.slice(F.array_sort(distinctive), 1, n), lambda x: F.concat(number, F.lit("_"), x))
    return F.when(number != "", keys).otherwise(F.array().cast("array<string>"))


def both(a: Column, b: Column) -> Column:
    """Two parts of a key, or no key where one is missing."""
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("_"), b)).otherwise("")


def city(norm_address: Column) -> Column:
    """The last word of four letters and more that is neither common nor a number."""
    common = W.generic_address_words()
    return F.coalesce(F.try_element_at(F.filter(tokens(norm_address), lambda x: (F.length(x) >= 4) & ~x.isin(*common) & ~x.rlike(r"^\d+$")), F.lit(-1)), F.lit(""))


def domain_token(text: Column) -> Column:
    """The name in a URL or mail address: without scheme, mailbox, host suffix and path; four letters and more."""
    t = F.regexp_replace(F.lower(fold_ascii(blank(text))), r"^https?://", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^[^@/]*@", ""), r"^(www|m)\.", "")
    t = F.regexp_replace(F.regexp_replace(t, r"/.*$", ""), r"\.[a-z.]+$", "")
    t = F.regexp_replace(t, r"[^a-z0-9]", "")
    return F.when(F.length(t) >= 4, t).otherwise("")


def char_grams(text: Column, n: int = 3) -> Column:
    """The set of a string's n-grams; a shorter string is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(F.array_distinct(grams))


def padded_grams(text: Column) -> Column:
    """All 2- and 3-grams of the text between two spaces, with repeats."""
    t = F.concat(F.lit(" "), text, F.lit(" "))
    of = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(of(2), of(3))


def category_mask(norm: Column) -> Column:
    """The bits of the lines of business whose words the name has."""
    bits = W.category_bits()
    table = F.expr("map(" + ",".join(f"'{w}',{b}" for w, b in bits.items()) + ")")
    return F.aggregate(tokens(norm), F.lit(0), lambda a, x: a.bitwiseOR(F.coalesce(table[x], F.lit(0))))


def category_mask_inside(norm: Column) -> Column:
    """The same for words found anywhere in the name."""
    out = F.lit(0)
    for i, ws in enumerate(W.CATEGORY_PARTS):
        hit = F.lit(False)
        for w in ws:
            hit = hit | norm.contains(w)
        out = out + F.when(hit, 1 << i).otherwise(0)
    return out


def category_set(norm: Column) -> Column:
    """The sorted classes (the first word of each) that the name has."""
    table = _mapped({w: ws[0] for ws in W.CATEGORY_WORDS for w in ws})
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens(norm), lambda x: table[x]), lambda x: x.isNotNull())))


def soundex_code(token: Column) -> Column:
    """Letters' codes where a vowel, h or w between two equal codes keeps both; empty for other than ASCII letters."""
    t = F.upper(token)
    digits = F.translate(t, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    chars = F.split(digits, "")
    kept = F.filter(F.transform(chars, lambda c, i: F.when((i > 0) & (c != "0") & (c != F.get(chars, i - 1)), c)), lambda c: c.isNotNull())
    return F.when(t.rlike("^[A-Z]+$"), F.rpad(F.concat(F.substring(t, 1, 1), F.array_join(F.slice(kept, 1, 3), "")), 4, "0")).otherwise("")


def composite_core(name: Column) -> Column:
    """Abbreviations spelled out, then legal forms and generic words left out; all of it where nothing is left."""
    table, out = _mapped(W.COMPOSITE_ABBREVIATIONS), {*W.COMPOSITE_LEGAL, *W.COMPOSITE_GENERIC}
    full = F.array_join(F.transform(tokens(normalize_punctuation(name)), lambda x: F.coalesce(table[x], x)), " ")
    core = F.array_join(F.filter(F.split(full, " "), lambda x: ~x.isin(*sorted(out))), " ")
    return F.when(core != "", core).otherwise(full)


def composite_aliases(name: Column) -> Column:
    """The parts of the raw name around alias words, the first one too, of three letters and more."""
    parts = F.split(blank(name), r"(?i)\b(?:" + "|".join(W.COMPOSITE_ALIAS_WORDS) + r")\b")
    return F.filter(F.transform(parts, lambda x: normalize_punctuation(x)), lambda x: F.length(x) > 2)


def composite_country(address: Column, *fields: Column) -> Column:
    """The code of the first field that isn't empty, else of the first country name found in the address."""
    given = F.coalesce(*(F.nullif(normalize_punctuation(f), F.lit("")) for f in fields))
    inside = F.lit("")
    for name, code in reversed(W.COMPOSITE_COUNTRIES.items()):
        inside = F.when(normalize_punctuation(address).contains(name), code).otherwise(inside)
    return F.when(given.isNotNull(), F.coalesce(_mapped(W.COMPOSITE_COUNTRIES)[given], F.substring(given, 1, 2))).otherwise(inside)


def composite_fields(address: Column, postal: Column, phone: Column) -> dict[str, Column]:
    """Postal code of five characters, leading street number, last ten digits of the phone."""
    return {"postal": F.substring(F.replace(normalize_punctuation(postal), F.lit(" "), F.lit("")), 1, 5), "street": F.regexp_extract(normalize_punctuation(address), r"^(\d+)", 1),
            "phone": F.right(F.regexp_replace(blank(phone), r"[^\d]", ""), F.lit(10))}


def address_clean_parts(norm_address: Column) -> tuple[Column, Column]:
    """Postal code and number as the first digits of the cleaned address; leading zeros of the number go."""
    clean = clean_address(norm_address)
    return F.regexp_extract(clean, r"\b(\d{5,6})\b", 1), F.regexp_extract(clean, r"\b0*(\d{1,6})\b", 1)


def address_raw_parts(address: Column) -> tuple[Column, Column]:
    """From the raw text: the last number of five or six digits is the postal code, unless it is the only one and leads;
    the number follows a word for one, else leads, else is the first of one to four digits, the postal code left out.

    Digits and word ends are Unicode's, as the raw text isn't folded."""
    a = blank(address)
    last = F.regexp_extract(a, r"(?U)^.*\b(\d{5,6})\b", 1)
    several = F.size(F.regexp_extract_all(a, F.lit(r"(?U)\b(\d{5,6})\b"), F.lit(1))) > 1
    postal = F.when(several | ~a.rlike(r"(?U)^\s*\d{5,6}\b"), last).otherwise("")
    rest = F.when(postal != "", F.regexp_replace(a, r"(?U)^(.*)\b\d{5,6}\b", "$1 ")).otherwise(a)
    word = F.lower(F.regexp_extract(rest, r"(?Ui)\b(?:no\.?|h\.?no\.?|#|plot|flat|door|suite|bldg)\s*(\d{1,5}[a-z]?)\b", 1))
    lead = F.lower(F.regexp_extract(rest, r"(?Ui)^\s*(\d{1,5}[a-z]?)\b", 1))
    return postal, F.when(word != "", word).when(lead != "", lead).otherwise(F.regexp_extract(rest, r"(?U)\b(\d{1,4})\b", 1))


def street_number(norm_address: Column) -> Column:
    """A leading number, else one after a word for it, else one before a street word."""
    lead = F.regexp_extract(norm_address, r"^(\d+)\b", 1)
    word = F.regexp_extract(norm_address, r"\b(?:no|hno|plot|shop|flat|door)\s*(\d+)\b", 1)
    street = F.regexp_extract(norm_address, r"\b(\d{1,5})\s+(?:[a-z]+\s+)?(?:st|street|rd|road|ave|avenue|blvd|lane|dr|drive|way|court|ct|boulevard|rue|all|imp)\b", 1)
    return F.when(lead != "", lead).when(word != "", word).otherwise(street)


def _cut(w: Column, n: int):
    return lambda i: F.substring(w, i, F.lit(n))


def word_grams(text: Column, least: int = 3, most: int = 4) -> Column:
    """All n-grams within words, each word between two spaces; a word shorter than n is one gram, once."""
    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        parts = [F.when((F.length(w) >= n) if n > least else F.lit(True), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), _cut(w, n)))
                 .otherwise(F.array().cast("array<string>")) for n in range(least, most + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(tokens(text), of))
