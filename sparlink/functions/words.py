"""Word lists and lookup tables of business names and addresses."""
from __future__ import annotations

# Words that name a legal form and are no part of a name's core.
LEGAL = [
    "inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "co", "company", "dba", "lp", "pllc", "pvt", "private", "llp", "opc",
    "lnc", "1nc", "sarl", "sas", "sa", "eurl", "sci", "snc", "sasu", "gie", "ei", "sep", "gmbh", "ag", "kg", "ohg", "gbr", "ug", "plc", "cic", "pty",
]

# The shorter list of the feature profile.
LEGAL_FEATURES = [
    "inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "co", "company", "dba", "lp", "pllc", "pvt", "private", "llp", "opc",
    "sarl", "sas", "sa", "eurl", "sci", "snc", "sasu", "gie", "ei", "sep",
]

# That list with two misreadings of "inc", for the calibrated profile.
LEGAL_CALIBRATED = [*LEGAL_FEATURES, "lnc", "1nc"]

# Words too common in business names to tell two apart.
GENERIC_FEATURES = [
    "center", "services", "solutions", "technologies", "group", "holdings", "enterprises", "international", "global", "consulting", "associates",
    "management", "products", "systems", "partners", "digital", "developers", "allied", "ventures", "industries", "commercial", "logistics",
    "trading", "retail", "marketing", "agency", "care", "health", "works", "consultancy", "enterprise", "labs", "studio",
]
GENERIC_MORE = [
    "network", "networks", "resource", "resources", "property", "properties", "service", "technology", "construction", "design", "media",
    "development", "investment", "finance", "financial",
]
GENERIC = [*GENERIC_FEATURES, *GENERIC_MORE]

# Business abbreviations and what they stand for.
ABBREVIATIONS = {
    "intl": "international", "int": "international", "natl": "national", "nat": "national", "mgmt": "management", "mgt": "management",
    "svc": "service", "svcs": "services", "dept": "department", "assoc": "associates", "assn": "association", "tech": "technology",
    "techs": "technologies", "engr": "engineering", "engg": "engineering", "mfg": "manufacturing", "mfr": "manufacturer", "dist": "distribution",
    "distrib": "distribution", "adv": "advertising", "fin": "financial", "med": "medical", "pharm": "pharmaceutical", "comm": "communications",
    "comms": "communications", "prop": "properties", "props": "properties", "dev": "development", "devs": "developments", "inv": "investment",
    "invs": "investments", "sys": "systems", "soln": "solution", "solns": "solutions", "res": "resources", "prod": "products", "prods": "products",
    "serv": "services", "srv": "services", "ind": "industries", "inds": "industries", "bldg": "building", "bldgs": "buildings", "ctr": "center",
    "ctrs": "centers", "mkt": "market", "mkts": "markets", "hlth": "health", "hosp": "hospital", "grp": "group", "ent": "enterprises",
    "ents": "enterprises", "hldg": "holdings", "hldgs": "holdings", "hld": "holdings", "corp": "corporation", "maint": "maintenance",
    "acct": "accounting", "acctg": "accounting", "biz": "business", "hr": "human resources", "it": "information technology",
}

# Street words and their abbreviations.
STREETS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "bvd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "rte": "route", "sq": "square", "r": "rue", "all": "allee",
    "imp": "impasse", "crs": "cours",
}

# States of the USA by postal abbreviation.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware",
    "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas",
    "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
    "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey",
    "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon",
    "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah",
    "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}

# Other words too common in addresses to tell two apart; the calibrated profile's list is shorter.
ADDRESS_COMMON = [
    "suite", "ste", "apt", "unit", "fl", "floor", "building", "bldg", "po", "box", "north", "south", "east", "west", "n", "s", "e", "w", "city",
    "near", "opp", "opposite", "behind", "dist", "district", "state", "road", "street", "highway", "county", "hno", "no", "plot", "shop", "flat",
    "block", "sector", "phase", "nagar", "colony", "layout", "cross", "main", "market",
]
ADDRESS_COMMON_CALIBRATED = [
    "suite", "ste", "apt", "unit", "fl", "floor", "building", "bldg", "po", "box", "north", "south", "east", "west", "n", "s", "e", "w", "city",
    "near", "opp", "opposite", "behind", "dist", "district", "state", "road", "street", "highway", "county", "hno", "no", "plot", "shop", "flat",
]

# Names of countries and their codes.
COUNTRIES = {
    "usa": "us", "united states": "us", "united states of america": "us", "u.s.a.": "us", "u.s.": "us", "america": "us", "india": "in",
    "bharat": "in", "republic of india": "in", "france": "fr", "republique francaise": "fr", "french republic": "fr", "uk": "gb",
    "united kingdom": "gb", "great britain": "gb", "england": "gb", "britain": "gb", "scotland": "gb", "wales": "gb", "germany": "de",
    "deutschland": "de", "bundesrepublik deutschland": "de", "canada": "ca", "australia": "au", "commonwealth of australia": "au",
}

# The profile of composite scores; legal forms, generic words, abbreviations and countries of its own.
COMPOSITE_LEGAL = [
    "inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "co", "company", "dba", "lp", "pllc", "pvt", "private", "llp", "opc",
    "lnc", "1nc", "sarl", "sas", "sa", "eurl", "sci", "snc", "sasu", "gie", "ei", "sep", "gmbh", "ag", "kg", "ohg", "gbr", "ug", "plc", "bv", "nv",
    "ab", "oy", "pty",
]
COMPOSITE_GENERIC = [
    "center", "services", "solutions", "technologies", "group", "holdings", "enterprises", "international", "global", "consulting", "associates",
    "management", "products", "systems", "partners", "digital", "developers", "allied", "ventures", "industries", "commercial", "logistics",
    "trading", "retail", "marketing", "agency", "care", "health", "works", "labs", "studio", "network", "networks",
]
COMPOSITE_ABBREVIATIONS = {
    "st": "saint", "intl": "international", "natl": "national", "corp": "corporation", "dept": "department", "mfg": "manufacturing",
    "svcs": "services", "svc": "service", "tech": "technology", "techs": "technologies", "mgmt": "management", "assoc": "associates",
    "univ": "university", "hosp": "hospital", "med": "medical", "fin": "financial", "ins": "insurance", "grp": "group", "hdg": "holdings",
    "hdgs": "holdings",
}
COMPOSITE_COUNTRIES = {
    "usa": "us", "united states": "us", "america": "us", "u.s.a": "us", "u.s": "us", "india": "in", "ind": "in", "uk": "gb", "united kingdom": "gb",
    "great britain": "gb", "france": "fr", "germany": "de", "canada": "ca", "australia": "au", "china": "cn",
}
COMPOSITE_ALIAS_WORDS = [
    "dba", r"d\.b\.a\.?", "doing business as", "formerly", "f/k/a", "t/a", "trading as", "also known as", "aka",
]

# Suffixes of domains, in the order in which they are tried; the calibrated profile knows the first nine.
DOMAINS = [
    ".com", ".in", ".org", ".net", ".co", ".io", ".fr", ".co.uk", ".eu", ".de", ".ca", ".au",
]
DOMAINS_CALIBRATED = DOMAINS[:9]

# Words before another name of the same business; the calibrated profile knows the first five.
ALIAS_WORDS = [
    "aka", "dba", "fka", "doing business as", "trading as", "formerly", "also known as",
]
ALIAS_WORDS_CALIBRATED = ALIAS_WORDS[:5]

# Words that name a line of business, a class for each line; a class's bit is its place.
CATEGORY_WORDS = [
    ["pharmacy", "pharma"],
    ["clinic", "hospital", "medical"],
    ["hotel", "motel", "hospitality"],
    ["restaurant", "cafe", "bakery", "pizza", "burger", "diner"],
    ["bank", "finance", "insurance"],
    ["realty", "real"],
    ["school", "college", "university", "academy"],
    ["salon", "spa", "barber"],
    ["gym", "fitness"],
    ["auto", "motors", "car", "garage"],
    ["tech", "software", "computers"],
    ["dental", "dentist"],
    ["law", "attorney", "legal"],
]

# The same for profiles that look for them inside names.
CATEGORY_PARTS = [
    ["pharmacy", "pharma"],
    ["clinic", "hospital", "medical"],
    ["hotel", "motel", "inn", "resort"],
    ["restaurant", "cafe", "bakery", "diner", "grill", "bistro", "pizza"],
    ["bank", "credit", "financial"],
    ["realty", "real estate", "properties"],
    ["school", "academy", "college", "university"],
    ["salon", "spa", "barber", "beauty"],
    ["gym", "fitness", "crossfit"],
    ["auto", "motors", "collision", "towing"],
    ["tech", "software", "digital"],
    ["dental", "dentist", "orthodontics"],
    ["law", "attorney", "legal"],
]


def generic_words() -> list[str]:
    return list(dict.fromkeys([*GENERIC, *LEGAL]))


def generic_words_calibrated() -> list[str]:
    return list(dict.fromkeys([*GENERIC_FEATURES, *LEGAL_CALIBRATED]))


def generic_address_words() -> list[str]:
    return list(dict.fromkeys([*STREETS, *STREETS.values(), *STATES, *STATES.values(), *ADDRESS_COMMON]))


def generic_address_words_calibrated() -> list[str]:
    streets = {k: v for k, v in STREETS.items() if k != "crs"} | {"saint": "street"}
    return list(dict.fromkeys([*streets, *streets.values(), *STATES, *STATES.values(), *ADDRESS_COMMON_CALIBRATED]))


def category_bits() -> dict[str, int]:
    return {w: 1 << i for i, ws in enumerate(CATEGORY_WORDS) for w in ws}
