"""Answers that were worked out by hand from the rules, and share no code with the operators."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import special, text
from tidemark.operators import relational as R

#: A holding as it is written, its name and its ticker.
HOLDINGS = [
    ("Berkshire Hathaway Inc (BRK/B)", "Berkshire Hathaway Inc", "BRK/B"), ("Taiwan Semiconductor Manufacturing Co Ltd (2330)", "Taiwan Semiconductor Manufacturing Co Ltd", "2330"), ("Plain name", "Plain name", ""),
    (" Two (words here) ", "Two (words here)", ""), ("HSBC Holdings plc (HSBA.L) ", "HSBC Holdings plc", "HSBA.L"), ("Under_score (A_B-1)", "Under_score", "A_B-1"), ("(ABC)", "(ABC)", "ABC"), ("Leading dot (.AB)", "Leading dot (.AB)", ""),
    ("Foo (X) Bar (Y1)", "Foo (X) Bar", "Y1"), ("Long (ABCDEFGHIJKLMNOPQRSTUVWXY)", "Long", "ABCDEFGHIJKLMNOPQRSTUVWXY"), ("Long (ABCDEFGHIJKLMNOPQRSTUVWXYZ)", "Long (ABCDEFGHIJKLMNOPQRSTUVWXYZ)", ""), (None, "", ""),
]

#: Worked by hand: a symbol as given, its country, the spellings to try, the suffixes to try, and the listings that come of them.
SYMBOLS = [
    ("BRK/B", "US", "BRK-B,BRK/B", "", "BRK-B"), ("brk/b*", "", "BRK/B,BRK-B", "", "BRK/B,BRK-B"), ("VOLVB", "SE", "VOLVB,VOLV-B", ".ST", "VOLVB.ST,VOLV-B.ST"), ("NOVOB", "dk", "NOVOB,NOVO-B", ".CO", "NOVOB.CO,NOVO-B.CO"),
    ("ABB", "SE", "ABB", ".ST", "ABB.ST"), ("700", "HK", "0700,700", ".HK", "0700.HK"), ("1398", "HK", "1398", ".HK", "1398.HK"), ("600000", "CN", "600000", ".SS", "600000.SS"), ("510050", "CN", "510050", ".SS", "510050.SS"),
    ("000001", "CN", "000001", ".SZ,.BJ", "000001.SZ,000001.BJ"), ("830799", "CN", "830799", ".SZ,.BJ", "830799.SZ,830799.BJ"), ("BT/A", "GB", "BT/A,BT-A", ".L,.IL", "BT-A.L,BT-A.IL"), ("RR/", "GB", "RR/,RR-,RR", ".L,.IL", "RR-.L,RR-.IL,RR.L,RR.IL"),
    ("PTT/F", "TH", "PTT/F,PTT-F,PTT", ".BK", "PTT-F.BK,PTT.BK"), ("BRK.B", "US", "BRK.B,BRK-B", "", "BRK-B"), ("N/A", "US", "", "", ""), ("--", "JP", "", ".T", ""), ("1", "HK", "", ".HK", ""), ("RCI/B", "CA", "RCI-B,RCI/B", ".TO,.V,.NE", "RCI-B.TO,RCI-B.V,RCI-B.NE"),
    ("2330", "TW", "2330", ".TW,.TWO", "2330.TW,2330.TWO"), (" aapl ", "US", "AAPL", "", "AAPL"), ("GOLD", "ZZ", "GOLD", "", ""), ("HSBA", "GB", "HSBA", ".L,.IL", "HSBA.L,HSBA.IL"), (None, "US", "", "", ""),
]

#: Worked by hand: two names, and the Ratcliff-Obershelp ratio of what is left of them: 2 x matching characters / all characters.
NAMES = [
    ("Foo Inc", "foo corp", 1.0), ("Apple Incorporated", "Apple", 1.0), ("The Alpha Company Limited", "ALPHA CO LTD", 1.0), ("AT&T Inc", "ATandT Corporation", 1.0), ("abcd", "bcde", 0.75), ("abc", "xyz", 0.0), ("Inc", "Ltd", 1.0),
    ("Ordinary Shares plc", "x", 0.0), ("ab cd", "cd ab", 0.4), ("Nestle SA", "Nestle AG class A", 12 / 14), (None, "", 1.0), ("Group", "Groupe", 10 / 11),
]

#: Worked by hand: quote type, listing, country, source symbol, similarity of the names, and the score.
CANDIDATES = [
    ("EQUITY", "BRK-B", "US", "BRK/B", 1.0, 13.0), ("equity", "2330.TW", "TW", "2330", 0.5, 9.0), ("", "VOLV-B.ST", "SE", "VOLVB", 0.75, 11.0), ("ETF", "2330.TW", "TW", "2330", 1.0, -100.0), ("EQUITY", "2330.HK", "TW", "2330", 1.0, -100.0),
    ("EQUITY", "", "TW", "2330", 1.0, -100.0), ("Common Stock", "AAPL34.SA", "BR", "AAPL", 0.25, 5.0), ("EQUITY", "MSFT", "US", "AAPL", 0.5, 6.0), ("EQUITY", "MSFT", "", "", 0.0, 2.0), (None, "HSBA.L", "GB", "HSBA*", 0.9, 12.2),
]

#: Worked by hand: listing, country, given market code, exchange; and the symbol, its suffix, whether it may be of the country, and the market code.
LISTED = [
    (" hsba.l", "GB", "", "London Stock Exchange", "HSBA.L", ".L", True, "XLON"), ("BRK-B", "US", "xnys", "Nasdaq", "BRK-B", "", True, "XNYS"), ("BRK.B", "US", "", "NYSE", "BRK.B", ".B", False, "XNYS"),
    ("2330.TW", "HK", "TW", "Taiwan Stock Exchange", "2330.TW", ".TW", False, "XTAI"), ("A B*", "", "", "KOSDAQ", "AB", "", False, "XKOS"), ("^GSPC", "US", "", "", "^GSPC", "", False, ""), ("BT/A.L", "GB", None, "LSE", "BT/A.L", ".L", False, "XLON"),
    ("ABC.Q", "ZZ", "XXXXX", "Borsa Italiana", "ABC.Q", ".Q", True, "XMIL"), ("", "US", "", "Hong Kong", "", "", False, "XHKG"), (None, "JP", "XTKS", None, "", "", False, "XTKS"), ("SAN.MC", "es", "", "MADRID!", "SAN.MC", ".MC", True, "XMAD"),
]

LISTINGS = [
    ("2330.TW", "TW", "TWD", "yahoo_suffix:.TW"), ("6488.TWO", "TW", "TWD", "yahoo_suffix:.TWO"), ("005930.KS", "KR", "KRW", "yahoo_suffix:.KS"), ("091990.KQ", "", "KRW", "yahoo_suffix:.KQ"),
    ("0700.hk", "CN", "HKD", "yahoo_suffix:.HK"), ("7203.T", "JP", "JPY", "yahoo_suffix:.T"), ("HSBA.L", "US", "GBp", "yahoo_suffix:.L"), ("NESN.SW", "CH", "CHF", "yahoo_suffix:.SW"),
    ("NBK.KW", "KW", "KWD", "yahoo_suffix:.KW"), ("TEVA.TA", "IL", "ILA", "yahoo_suffix:.TA"), ("NPN.JO", "ZA", "ZAc", "yahoo_suffix:.JO"), ("RY.TO", "CA", "CAD", "yahoo_suffix:.TO"),
    ("ABC.V", "CA", "CAD", "yahoo_suffix:.V"), ("XYZ.NE", "CA", "CAD", "yahoo_suffix:.NE"), ("COMI.CA", "EG", "EGP", "yahoo_suffix:.CA"), ("SQM.SN", "CL", "CLP", "yahoo_suffix:.SN"),
    ("ECOPETROL.CL", "CO", "COP", "yahoo_suffix:.CL"), ("SMSN.IL", "GB", "USD", "yahoo_suffix:.IL"), ("TLV.RO", "RO", "RON", "yahoo_suffix:.RO"), ("MARL.IC", "IS", "ISK", "yahoo_suffix:.IC"),
    ("SAP.MU", "DE", "EUR", "yahoo_suffix:.MU"), ("CEZ.PR", "CZ", "EUR", "yahoo_suffix:.PR"), ("OTP.BD", "HU", "HUF", "yahoo_suffix:.BD"), ("600000.SS", "CN", "CNY", "yahoo_suffix:.SS"),
    ("EMAAR.AE", "AE", "AED", "yahoo_suffix:.AE"), ("FAB.AD", "AE", "AED", "yahoo_suffix:.AD"), ("THYAO.IS", "TR", "TRY", "yahoo_suffix:.IS"), ("AAPL", "us", "USD", "country:US"),
    ("VOD", "GB", "GBp", "country:GB"), ("SQUARE", "BD", "BDT", "country:BD"), ("OGDC", "PK", "PKR", "country:PK"), ("VNM", "VN", "VND", "country:VN"), ("GGAL", "AR", "ARS", "country:AR"),
    ("CEZ", "CZ", "CZK", "country:CZ"), ("NBK", "KW", "KWD", "country:KW"), ("TEVA", "IL", "ILA", "country:IL"), ("WHO", "XX", "", "missing"), ("WHO", "", "", "missing"), ("", "", "", "missing"),
]

#: Worked by hand: an exchange's name, and the currency with the word that tells it.
EXCHANGES = [
    ("NasdaqGS - Nasdaq Real Time", "USD", "exchange:NASDAQ"), ("NMS", "USD", "exchange:NMS"), ("NYSE Arca", "USD", "exchange:NYSE"), ("New York Stock Exchange", "USD", "exchange:NEW YORK STOCK EXCHANGE"),
    ("OTC Markets", "USD", "exchange:OTC"), ("Toronto Stock Exchange", "CAD", "exchange:TORONTO"), ("TSXV", "CAD", "exchange:TSX"), ("Stuttgart", "EUR", "exchange:STUTTGART"),
    ("Düsseldorf", "EUR", "exchange:DÜSSELDORF"), ("International Orderbook - London", "USD", "exchange:INTERNATIONAL ORDERBOOK - LONDON"), ("London", "", "missing"),
    ("Dubai Financial Market", "AED", "exchange:DUBAI FINANCIAL MARKET"), ("Nasdaq Iceland", "USD", "exchange:NASDAQ"), ("Iceland", "ISK", "exchange:ICELAND"), ("Bucharest", "RON", "exchange:BUCHAREST"),
    ("Bolsa de Valores de Colombia", "COP", "exchange:BOLSA DE VALORES DE COLOMBIA"), ("Taipei Exchange", "", "missing"), (" ", "", "missing"), ("Base exchange", "USD", "exchange:ASE"), ("AMERICA", "", "missing"),
]

#: Worked by hand: a currency as quoted, its code and the scale.
UNITS = [
    ("GBp", "GBP", 0.01), ("GBX", "GBP", 0.01), ("GBP", "GBP", 1.0), ("gbp", "GBP", 1.0), ("gbx", "GBP", 0.01), ("GB pence", "GBP", 0.01), ("ZAc", "ZAR", 0.01), ("ZAC", "ZAR", 0.01), ("ILA", "ILS", 0.01), ("KWF", "KWD", 0.001),
    ("USc", "USD", 0.01), ("usc", "USD", 0.01), ("eur", "EUR", 1.0), (" US D ", "USD", 1.0), ("", "", 1.0), (None, "", 1.0),
]

#: Worked by hand: name, ticker, instrument type, country, and whether it is a cash position.
CASH = [
    ("US Dollar", "USD", "", "", True), ("Japanese yen balance", "jpy", "", "", True), ("EURO CURRENCY", "EUR", "", "", True), ("Israeli Shekel", "ILS", "", "", True), ("Indian Rupee", "INR", "", " ", True),
    ("Cash America", "CSH", "EQUITY", "", False), ("Cash America", "CSH", "", "US", False), ("Cashew Farms", "CFM", "", "", False), ("Dollarama", "DOL", "", "", False), ("US Dollar", "USDX", "", "", False),
    ("Deposit Bank", "DEP", "", "", False), ("Margin receivable", "MAR", "", "", False), ("Turkish Lira", "TRY", None, None, True), ("Swedish krone; cash", "SEK", "", "", True), (None, "USD", "", "", False),
]

#: Worked by hand: ticker, country, method, name, resolved name, whether verified, and why the mapping goes, if it does.
MAPPINGS = [
    ("AAPL", "US", "direct_symbol", "Apple Inc", "Apple Inc.", True, None), ("", "US", "search", "Apple Inc", "Apple Inc.", True, "blank"), ("VOD", "GB", "direct_symbol", "Vodafone Group", "", True, "bare_symbol"),
    ("VOD.L", "GB", "country_suffix:GB", "Vodafone Group plc", "Vodafone Group", True, None), ("VOD.PA", "GB", "search", "Vodafone Group", "Vodafone Group", True, "suffix_mismatch"),
    ("7203.T", "JP", "search", "Toyota Motor Corp", "Kirin Holdings", True, "name_mismatch"), ("7203.T", "JP", "search", "Toyota Motor Corp", "", True, None), ("BRK.B", "US", "search", "Berkshire", "Berkshire", True, "suffix_mismatch"),
    ("7203.T", "JP", "search", "Toyota Motor Corp", "Kirin Holdings", False, None), ("XYZ", "", "direct_symbol", "Any Name", "Other Thing", True, None), ("^FTSE", "GB", "search", "FTSE", "FTSE", True, "suffix_mismatch"),
    ("ABC.QQ", "ZZ", "search", "The Alpha Company Limited", "ALPHA CO LTD", True, None),
]


def answers(spark, names, rows, given, *columns):
    """The rows' given columns, all strings unless they are numbers or truths, through the operator; in the rows' order."""
    kind = lambda i: next(({bool: "boolean", float: "double"}.get(type(r[i]), "string") for r in rows if r[i] is not None), "string")
    df = spark.createDataFrame([(n, *r[:given]) for n, r in enumerate(rows)], ", ".join(["n int", *(f"{c} {kind(i)}" for i, c in enumerate(names[:given]))]))
    return [tuple(r)[1:] for r in df.select("n", *columns).orderBy("n").collect()]


def test_holdings(spark):
    s = text.name_and_ticker(F.col("x"))
    assert answers(spark, ["x"], HOLDINGS, 1, s["name"], s["ticker"]) == [r[1:] for r in HOLDINGS]


def test_symbols(spark):
    x, land = F.col("x"), F.col("country")
    got = answers(spark, ["x", "country"], SYMBOLS, 2, *(F.array_join(c, ",") for c in (text.symbol_variants(x, land), text.symbol_suffixes(x, land), text.candidate_symbols(F.lit(""), x, land))))
    assert got == [r[2:] for r in SYMBOLS]


def test_names(spark):
    got = answers(spark, ["a", "b"], NAMES, 2, special.name_similarity(F.col("a"), F.col("b")))
    assert [v for (v,) in got] == pytest.approx([r[2] for r in NAMES])


def test_candidates(spark):
    columns = ["kind", "ticker", "country", "source", "similarity"]
    got = answers(spark, columns, CANDIDATES, 5, text.candidate_score(*map(F.col, columns)))
    assert [v for (v,) in got] == pytest.approx([r[5] for r in CANDIDATES])


def test_listed(spark):
    x = F.col("x")
    got = answers(spark, ["x", "country", "mic", "exchange"], LISTED, 4, text.symbol(x), text.symbol_suffix(x), text.compatible(F.col("country"), x), text.market_code(F.col("mic"), F.col("exchange")))
    assert got == [r[4:] for r in LISTED]


def test_listings(spark):
    c = text.listing_currency(F.col("symbol"), F.col("country"))
    assert answers(spark, ["symbol", "country"], LISTINGS, 2, c["code"], c["source"]) == [r[2:] for r in LISTINGS]


def test_exchanges(spark):
    c = text.exchange_currency(F.col("x"))
    assert answers(spark, ["x"], EXCHANGES, 1, c["code"], c["source"]) == [r[1:] for r in EXCHANGES]


def test_units(spark):
    c = text.currency(F.col("x"))
    assert answers(spark, ["x"], UNITS, 1, c["code"], c["scale"]) == [r[1:] for r in UNITS]


def test_cash(spark):
    got = answers(spark, ["name", "ticker", "instrument", "country"], CASH, 4, text.is_cash(*map(F.col, ("instrument", "country", "ticker", "name"))))
    assert [v for (v,) in got] == [r[4] for r in CASH]


def test_mappings(spark):
    columns = ["ticker", "country", "method", "name", "resolved", "was"]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(MAPPINGS)], "n int, ticker string, country string, method string, name string, resolved string, was boolean, expected string")
    got = R.audit_mappings(df.select("n", *columns), special.name_similarity(F.col("name"), F.col("resolved"))).orderBy("n").collect()
    assert [r["reason"] for r in got] == [r[6] for r in MAPPINGS]
    assert all(r["ticker"] == ("" if r["reason"] else m[0]) and r["was"] == (m[5] and r["reason"] is None) for r, m in zip(got, MAPPINGS, strict=True))
