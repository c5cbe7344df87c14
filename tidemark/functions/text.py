"""Cleaning and matching of labels, names, symbols, numbers and codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minor units that are told from the major one by their letters' case, with the major code and the scale.
MINOR_UNITS = {
    "GBX": ("GBP", 0.01), "GBP": ("GBP", 1.0), "GBPENCE": ("GBP", 0.01), "GBPENNY": ("GBP", 0.01), "GBPEN": ("GBP", 0.01), "GBp": ("GBP", 0.01), "ZAC": ("ZAR", 0.01), "ZAc": ("ZAR", 0.01),
    "ILA": ("ILS", 0.01), "KWF": ("KWD", 0.001), "USC": ("USD", 0.01), "USc": ("USD", 0.01), "CAD": ("CAD", 1.0), "USD": ("USD", 1.0),
}
#: Listing suffixes and their currencies.
SUFFIX_CURRENCY = {
    ".TW": "TWD", ".TWO": "TWD", ".KS": "KRW", ".KQ": "KRW", ".HK": "HKD", ".T": "JPY", ".L": "GBp", ".SW": "CHF", ".DE": "EUR", ".PA": "EUR", ".AS": "EUR", ".BR": "EUR",
    ".MI": "EUR", ".MC": "EUR", ".LS": "EUR", ".HE": "EUR", ".VI": "EUR", ".IR": "EUR", ".PR": "EUR", ".AT": "EUR", ".ST": "SEK", ".CO": "DKK", ".OL": "NOK", ".AX": "AUD",
    ".TO": "CAD", ".V": "CAD", ".NS": "INR", ".BO": "INR", ".SA": "BRL", ".MX": "MXN", ".SR": "SAR", ".JO": "ZAc", ".TA": "ILA", ".SI": "SGD", ".KL": "MYR", ".JK": "IDR",
    ".BK": "THB", ".IS": "TRY", ".NZ": "NZD", ".WA": "PLN", ".BD": "HUF", ".SS": "CNY", ".SZ": "CNY", ".QA": "QAR", ".KW": "KWD", ".AD": "AED", ".CA": "EGP", ".SN": "CLP",
    ".AE": "AED", ".CL": "COP", ".NE": "CAD", ".IC": "ISK", ".MU": "EUR", ".XD": "EUR", ".RO": "RON", ".SG": "EUR", ".IL": "USD",
}
#: Countries and the currencies of their listings.
COUNTRY_CURRENCY = {
    "US": "USD", "CA": "CAD", "GB": "GBp", "JP": "JPY", "CN": "CNY", "HK": "HKD", "TW": "TWD", "KR": "KRW", "AU": "AUD", "NZ": "NZD", "IN": "INR", "BR": "BRL", "MX": "MXN",
    "CH": "CHF", "SE": "SEK", "DK": "DKK", "NO": "NOK", "PL": "PLN", "HU": "HUF", "CZ": "CZK", "TR": "TRY", "ZA": "ZAc", "IL": "ILA", "SA": "SAR", "AE": "AED", "QA": "QAR",
    "KW": "KWD", "SG": "SGD", "MY": "MYR", "ID": "IDR", "TH": "THB", "PH": "PHP", "VN": "VND", "CL": "CLP", "CO": "COP", "PE": "PEN", "AR": "ARS", "EG": "EGP", "PK": "PKR",
    "BD": "BDT", "FR": "EUR", "DE": "EUR", "NL": "EUR", "BE": "EUR", "IT": "EUR", "ES": "EUR", "PT": "EUR", "IE": "EUR", "FI": "EUR", "AT": "EUR", "GR": "EUR", "LU": "EUR",
    "EE": "EUR", "LV": "EUR", "LT": "EUR", "SK": "EUR", "SI": "EUR", "IS": "ISK", "RO": "RON",
}
#: Words of exchange names and their currencies; the first that is found counts.
EXCHANGE_CURRENCY = [
    ("NASDAQ", "USD"), ("NMS", "USD"), ("NGM", "USD"), ("NCM", "USD"), ("NYQ", "USD"), ("PCX", "USD"), ("ASE", "USD"), ("NYSE", "USD"), ("NEW YORK STOCK EXCHANGE", "USD"),
    ("NYSE ARCA", "USD"), ("NYSE AMERICAN", "USD"), ("OTC", "USD"), ("TORONTO", "CAD"), ("TSX", "CAD"), ("NEO", "CAD"), ("STUTTGART", "EUR"), ("MUNICH", "EUR"),
    ("DUSSELDORF", "EUR"), ("DÜSSELDORF", "EUR"), ("INTERNATIONAL ORDERBOOK - LONDON", "USD"), ("DFM", "AED"), ("DUBAI FINANCIAL MARKET", "AED"), ("ABU DHABI", "AED"),
    ("NASDAQ ICELAND", "ISK"), ("ICELAND", "ISK"), ("BUCHAREST", "RON"), ("BVB", "RON"), ("BOLSA DE VALORES DE COLOMBIA", "COP"), ("BVC", "COP"),
]
#: Words of cash positions' names.
CASH_WORDS = ["cash", "currency", "dollar", "yen", "sheqel", "shekel", "rupee", "krone", "riyal", "lira", "rupiah"]
#: What stands for a missing symbol.
PLACEHOLDERS = ["", "-", "--", "---", "N/A", "NA", "NONE", "NULL", "1", "2"]
#: The listing suffixes of countries, the likeliest first.
COUNTRY_SUFFIXES = {
    "US": [""], "CA": [".TO", ".V", ".NE"], "GB": [".L", ".IL"], "JP": [".T"], "HK": [".HK"], "TW": [".TW", ".TWO"], "KR": [".KS", ".KQ"], "CN": [".SS", ".SZ", ".BJ"], "AU": [".AX"],
    "NZ": [".NZ"], "CH": [".SW"], "DE": [".DE"], "FR": [".PA"], "NL": [".AS"], "BE": [".BR"], "IT": [".MI"], "ES": [".MC"], "PT": [".LS"], "AT": [".VI"], "IE": [".IR", ".L"],
    "SE": [".ST"], "DK": [".CO"], "NO": [".OL"], "FI": [".HE"], "PL": [".WA"], "GR": [".AT"], "HU": [".BD"], "CZ": [".PR"], "BR": [".SA"], "MX": [".MX"], "ZA": [".JO"],
    "IN": [".NS", ".BO"], "ID": [".JK"], "MY": [".KL"], "SG": [".SI"], "TH": [".BK"], "PH": [".PS"], "IL": [".TA"], "SA": [".SR"], "AE": [".AE", ".AD", ".DU"], "QA": [".QA"],
    "KW": [".KW"], "TR": [".IS"], "EG": [".CA"], "CL": [".SN"],
}
#: The market codes of countries, the likeliest first.
COUNTRY_MICS = {
    "US": ["XNYS", "XNAS", "XASE"], "CA": ["XTSE", "XTSX"], "GB": ["XLON"], "JP": ["XTKS"], "HK": ["XHKG"], "TW": ["XTAI", "ROCO"], "KR": ["XKRX", "XKOS"], "CN": ["XSHG", "XSHE"],
    "AU": ["XASX"], "NZ": ["XNZE"], "CH": ["XSWX"], "DE": ["XETR", "XFRA"], "FR": ["XPAR"], "NL": ["XAMS"], "BE": ["XBRU"], "IT": ["XMIL"], "ES": ["XMAD"], "PT": ["XLIS"],
    "AT": ["XWBO"], "IE": ["XDUB", "XLON"], "SE": ["XSTO"], "DK": ["XCSE"], "NO": ["XOSL"], "FI": ["XHEL"], "PL": ["XWAR"], "BR": ["BVMF"], "MX": ["XMEX"], "ZA": ["XJSE"],
    "IN": ["XNSE", "XBOM"], "ID": ["XIDX"], "MY": ["XKLS"], "SG": ["XSES"], "TH": ["XBKK"], "PH": ["XPHS"], "IL": ["XTAE"], "SA": ["XSAU"],
}
#: Names of exchanges, as labels, and their market codes.
EXCHANGE_MIC = {
    "new york stock exchange": "XNYS", "nyse": "XNYS", "nasdaq": "XNAS", "nasdaq global select market": "XNGS", "nasdaq global market": "XNAS", "nasdaq capital market": "XNCM",
    "nyse american": "XASE", "toronto stock exchange": "XTSE", "tsx": "XTSE", "london stock exchange": "XLON", "lse": "XLON", "euronext paris": "XPAR", "euronext amsterdam": "XAMS",
    "xetra": "XETR", "frankfurt": "XFRA", "six swiss exchange": "XSWX", "milan": "XMIL", "borsa italiana": "XMIL", "madrid": "XMAD", "tokyo stock exchange": "XTKS", "tokyo": "XTKS",
    "hong kong stock exchange": "XHKG", "hong kong": "XHKG", "shanghai stock exchange": "XSHG", "shenzhen stock exchange": "XSHE", "taiwan stock exchange": "XTAI",
    "taipei exchange": "ROCO", "korea exchange": "XKRX", "kospi": "XKRX", "kosdaq": "XKOS", "australian securities exchange": "XASX", "asx": "XASX", "new zealand exchange": "XNZE",
    "singapore exchange": "XSES", "sgx": "XSES", "bursa malaysia": "XKLS", "stock exchange of thailand": "XBKK", "indonesia stock exchange": "XIDX", "philippine stock exchange": "XPHS",
    "national stock exchange of india": "XNSE", "nse": "XNSE", "bombay stock exchange": "XBOM", "bse": "XBOM", "b3": "BVMF", "mexican stock exchange": "XMEX",
    "johannesburg stock exchange": "XJSE", "tel aviv stock exchange": "XTAE", "saudi exchange": "XSAU",
}


def _table(values: dict[str, object]) -> Column:
    """A constant table as a map column: one look-up a row, no join."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), lit(v))))


def clean(c: Column) -> Column:
    """Trimmed; null and the words nan and None are blank."""
    x = F.trim(F.coalesce(c, F.lit("")))
    return F.when(x.isin("nan", "None"), "").otherwise(x)


def label(c: Column) -> Column:
    """Lower case, & as and, dashes alike, all but letters, digits and % to single spaces."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "&", "and"), "[‐-―]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9%]+", " "), " +", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def number(c: Column) -> Column:
    """Digits out of a cell: separators, signs of money and percent gone, (x) is -x, dashes alone are null."""
    x = F.trim(F.regexp_replace(c, "[,$%— ]", ""))
    negative = x.rlike(r"^\(.*\)$")
    v = F.regexp_replace(x, "[()]", "").try_cast("double")
    return F.when(negative, -v).otherwise(v)


def name_and_ticker(c: Column) -> Column:
    """'Name (TICK)' in two. A ticker is compact: 25 characters at most, no spaces, so that other words in brackets stay in the name."""
    x, p = F.trim(F.coalesce(c, F.lit(""))), r"^(.*?)\s*\(([A-Za-z0-9][A-Za-z0-9./_-]{0,24})\)\s*$"
    before, has = F.trim(F.regexp_extract(x, p, 1)), x.rlike(p)
    return F.struct(F.when(has & (before != ""), before).otherwise(x).alias("name"), F.when(has, F.regexp_extract(x, p, 2)).otherwise(F.lit("")).alias("ticker"))


def currency(c: Column) -> Column:
    """(code, scale): the exact spelling first, for minor units, and only then in upper case without spaces."""
    x = F.trim(F.coalesce(c, F.lit("")))
    upper = F.replace(F.upper(x), F.lit(" "), F.lit(""))
    known = _table({k: v[0] for k, v in MINOR_UNITS.items()}), _table({k: v[1] for k, v in MINOR_UNITS.items()})
    code, scale = (F.coalesce(F.try_element_at(t, x), F.try_element_at(t, upper)) for t in known)
    return F.struct(F.coalesce(code, upper).alias("code"), F.coalesce(scale, F.lit(1.0)).alias("scale"))


def listing_currency(symbol: Column, country: Column) -> Column:
    """(code, source): the currency of the longest suffix that fits, else the country's, else blank and 'missing'."""
    t, land = F.upper(F.trim(F.coalesce(symbol, F.lit("")))), F.upper(F.trim(F.coalesce(country, F.lit(""))))
    suffix = F.when(F.lit(False), "")
    for s in sorted(SUFFIX_CURRENCY, key=len, reverse=True):
        suffix = suffix.when(t.endswith(s), s)
    suffix = suffix.otherwise(F.lit(None))
    by_suffix, by_country = F.try_element_at(_table(SUFFIX_CURRENCY), suffix), F.try_element_at(_table(COUNTRY_CURRENCY), land)
    source = F.when(suffix.isNotNull(), F.concat(F.lit("yahoo_suffix:"), suffix)).when(by_country.isNotNull(), F.concat(F.lit("country:"), land)).otherwise("missing")
    return F.struct(F.coalesce(by_suffix, by_country, F.lit("")).alias("code"), source.alias("source"))


def exchange_currency(exchange: Column) -> Column:
    """(code, source): that of the first word, in the table's order, that the name contains."""
    x, code, source = F.upper(F.trim(F.coalesce(exchange, F.lit("")))), F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for word, currency_ in EXCHANGE_CURRENCY:
        code, source = code.when(x.contains(word), currency_), source.when(x.contains(word), f"exchange:{word}")
    return F.struct(code.otherwise("").alias("code"), source.otherwise("missing").alias("source"))


def first_filled(*choices: tuple[str, Column]) -> Column:
    """(value, source): the first that is not blank, and which it was."""
    filled = [(n, F.nullif(clean(c), F.lit(""))) for n, c in choices]
    source = F.when(F.lit(False), "")
    for n, c in filled:
        source = source.when(c.isNotNull(), n)
    return F.struct(F.coalesce(*(c for _, c in filled)).alias("value"), source.alias("source"))


def is_cash(instrument: Column, country: Column, ticker: Column, name: Column) -> Column:
    """No instrument type, no country, a three-letter code for a ticker, and a word of cash in the name."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return (F.coalesce(instrument, F.lit("")) == "") & (blank(country) == "") & F.upper(blank(ticker)).rlike("^[A-Z]{3}$") & blank(name).rlike(rf"(?i)\b(?:{'|'.join(CASH_WORDS)})\b")


def _digest_id(*parts: Column) -> Column:
    return F.concat(F.lit("VT-"), F.upper(F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 18)))


def stable_id(given: Column, cusip: Column, sedol: Column, isin: Column, *parts: Column) -> Column:
    """The given id, or one made of the first code there is, or a digest of the fields."""
    of = lambda c, p: F.when(clean(c) != "", F.concat(F.lit(p), clean(c)))
    return F.coalesce(of(given, ""), of(cusip, "CUSIP-"), of(sedol, "SEDOL-"), of(isin, "ISIN-"), _digest_id(*map(clean, parts)))


def unique_ids(df: DataFrame, id_col: str, *parts: str) -> DataFrame:
    """``df`` where each id that several rows have is replaced, in all of them, by a digest of the id and the further fields."""
    twice = df.groupBy(id_col).agg(F.count("*").alias("n__")).filter("n__ > 1").select(F.col(id_col).alias("id__"))
    got = df.join(twice, F.col(id_col) == F.col("id__"), "left")
    anew = _digest_id(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, *parts)))
    return got.withColumn(id_col, F.when(F.col("id__").isNotNull(), anew).otherwise(F.col(id_col))).drop("id__")


def symbol(c: Column) -> Column:
    """Upper case, without stars and white space."""
    return F.regexp_replace(F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("*"), F.lit("")), r"\s+", "")


def symbol_suffix(c: Column) -> Column:
    x = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x.contains("."), F.concat(F.lit("."), F.substring_index(x, ".", -1))).otherwise("")


def symbol_variants(c: Column, country: Column) -> Column:
    """The spellings to try, in order: with dashes for slashes and dots, without a trailing slash or /F, Hong Kong numbers padded to 4 in front, Nordic
    share classes split off. Placeholders have none.
    """
    s, land = symbol(c), F.upper(F.trim(F.coalesce(country, F.lit(""))))
    dashed = F.replace(s, F.lit("/"), F.lit("-"))
    tried = [
        F.when((land == "HK") & s.rlike(r"^\d{1,4}$"), F.lpad(s, 4, "0")),
        F.when(land.isin("US", "CA") & s.contains("/"), dashed),
        s,
        F.replace(s, F.lit("."), F.lit("-")),
        dashed,
        F.when(s.endswith("/"), F.regexp_replace(s, "/$", "")),
        F.when(s.endswith("/F"), F.regexp_replace(s, "/F$", "")),
        F.when(land.isin("SE", "DK", "NO", "FI") & s.rlike("^[A-Z0-9]{4,}[ABC]$"), F.regexp_replace(s, "(.)$", "-$1")),
    ]
    good = F.filter(F.array_distinct(F.array_compact(F.array(*tried))), lambda v: ~v.isin(*PLACEHOLDERS))
    return F.when(s.isin(*PLACEHOLDERS), F.array().cast("array<string>")).otherwise(good)


def symbol_suffixes(c: Column, country: Column) -> Column:
    """The suffixes to try: the country's; of Chinese six-digit numbers those of the exchange that the first digit tells."""
    s, land = symbol(c), F.upper(F.trim(F.coalesce(country, F.lit(""))))
    none = F.array().cast("array<string>")
    china = F.when(s.rlike("^[569]"), F.array(F.lit(".SS"))).otherwise(F.array(F.lit(".SZ"), F.lit(".BJ")))
    return F.when((land == "CN") & s.rlike(r"^\d{6}$"), china).otherwise(F.coalesce(F.try_element_at(_table(COUNTRY_SUFFIXES), land), none))


def compatible(country: Column, ticker: Column) -> Column:
    """Whether a listing may be of a country: no index, slash or star, and a suffix of the country's, if it is known; in the US none."""
    land, t = F.upper(F.trim(F.coalesce(country, F.lit("")))), F.upper(F.trim(F.coalesce(ticker, F.lit(""))))
    allowed = F.try_element_at(_table(COUNTRY_SUFFIXES), land)
    fits = F.when(allowed.isNull(), True).when(land == "US", ~t.contains(".")).otherwise(F.array_contains(F.coalesce(allowed, F.array().cast("array<string>")), symbol_suffix(t)))
    return (t != "") & ~t.startswith("^") & ~t.contains("/") & ~t.contains("*") & fits


def market_code(mic: Column, exchange: Column) -> Column:
    """The given market code, if it is one, else that of the exchange's name, else blank."""
    m = F.upper(F.trim(F.coalesce(mic, F.lit(""))))
    return F.when(m.rlike("^[A-Z0-9]{4}$"), m).otherwise(F.coalesce(F.try_element_at(_table(EXCHANGE_MIC), label(F.coalesce(exchange, F.lit("")))), F.lit("")))


def candidate_symbols(given: Column, c: Column, country: Column) -> Column:
    """The listings to try, in order, each once and only if compatible: the given one, each spelling with each suffix, and in the US, or
    without a country, the bare spellings.
    """
    land = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    bases, suffixes = symbol_variants(c, country), symbol_suffixes(c, country)
    padded = lambda b, x: F.when((x == ".HK") & b.rlike(r"^\d{1,4}$"), F.lpad(b, 4, "0")).otherwise(b)
    listed = F.flatten(F.transform(bases, lambda b: F.transform(suffixes, lambda x: F.concat(padded(b, x), x))))
    bare = F.when(land.isin("US", ""), bases).otherwise(F.array().cast("array<string>"))
    tried = F.array_distinct(F.concat(F.array(F.upper(F.trim(F.coalesce(given, F.lit(""))))), listed, bare))
    return F.filter(tried, lambda t: (t != "") & ((land == "") | compatible(country, t)))


def candidate_score(kind: Column, ticker: Column, country: Column, source: Column, similarity: Column) -> Column:
    """8 x the names' similarity + 2, 3 more if the symbols are the same, 1 more if one holds the other; -100 if it is no share or of another country."""
    k, t = F.upper(F.coalesce(kind, F.lit(""))), F.upper(F.trim(F.coalesce(ticker, F.lit(""))))
    bare = lambda x: F.regexp_replace(x, "[^A-Z0-9]", "")
    s, base = bare(symbol(source)), bare(F.substring_index(t, ".", 1))
    extra = F.when((s != "") & (s == base), 3.0).when((s != "") & base.contains(s), 1.0).otherwise(0.0)
    other = (k != "") & ~k.contains("EQUITY") & ~k.contains("STOCK")
    land = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    return F.when(other | (t == "") | ((land != "") & ~compatible(country, ticker)), -100.0).otherwise(8.0 * similarity + 2.0 + extra)


def json_pick(first: Column, second: Column, *keys: str) -> Column:
    """The first value that is not blank, by key and then by object."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(o, f"$.{k}")), F.lit("")) for k in keys for o in (first, second)))


def file_type(disposition: Column, path: Column, content: Column) -> Column:
    """By the name it is sent under, else by the path, else by the type it is sent as."""
    ext = lambda c: F.nullif(F.regexp_extract(F.lower(c), r"\.(csv|xlsx|xls|json|zip|txt|html)\b", 1), F.lit(""))
    said = F.when(content.contains("csv"), "csv").when(content.contains("json"), "json").when(content.contains("html"), "html").when(content.contains("zip"), "zip")
    return F.coalesce(ext(disposition), ext(path), said, F.lit("bin"))


def snapshot_date(c: Column) -> Column:
    """The date after 'as of': month/day/year if there is one anywhere, else year-month-day; null if it is no date."""
    said = lambda p: F.regexp_extract(c, rf"(?i)as\s+of\s*[:\-]?\s*({p})", 1)
    us, iso = said(r"\d{1,2}/\d{1,2}/\d{4}"), said(r"\d{4}-\d{2}-\d{2}")
    parsed = F.to_date(F.try_to_timestamp(us, F.lit("M/d/yyyy")))
    return F.coalesce(F.when(us != "", parsed), iso.try_cast("date"))
