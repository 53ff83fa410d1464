"""Ordered rules. A rule is (label, kind, words): `word` for whole words, `sub` for substrings; the first that fits decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import ENTITIES
from .text import has_value, title_case, u

# Every rule list below, in the order of evaluation.
MODE = (
    ("UPI", "word", "UPI"), ("NEFT", "word", "NEFT"), ("RTGS", "word", "RTGS"), ("IMPS", "word", "IMPS"), ("ATM", "word", "ATM"), ("Cash / BNA", "word", "CASH|BNA"),
    ("Cheque / Clearing", "word", "CHQ|CHEQUE|CLEARING|MICR|CLG"), ("NetBanking", "word", "NETBANKING|ONLINE BANKING"), ("Bank Charges", "word", "SERVICE CHARGES|CHARGES|FEE"),
)
PURPOSE = (
    ("ATM Withdrawal", "word", "ATM WDL|ATM WITHDRAWAL|ATM CASH|ATM-WDL"),
    ("Bank Charges", "word", "SERVICE CHARGES|BANK CHARGES|STATEMENT CHARGES|CHEQUE BOOK CHARGES|ANNUAL FEE|SMS CHARGES|MARKUP|ONLINE BANKING CHARGES|PROCESSING FEE|ACCOUNT MAINTENANCE"),
    ("Salary / Payroll", "word", "SALARY|PAYROLL|WAGES|REMUNERATION|SALARY TRF|IMPS BRN SALARY|NEFT SALARY"),
    ("Investment / Wealth", "word", "MUTUAL FUND|SECURITIES|SIP|ZERODHA|GROWW|UPSTOX|TRADING|DEMAT|DIVIDEND|EQUITY SHARES|NIFTY|SENSEX|STOCKS|SHARES|NSE|BSE"),
    ("Healthcare / Medical", "word", "APOLLO PHARMACY|MEDPLUS|NETMEDS|PHARMEASY|TATA MED|HEALTHKART|WELLNESS FOREVER|DIAGNOSTIC|PATHOLOGY|SCAN CENTRE|HOSPITAL|NURSING HOME"),
    ("Food & Dining", "word", "ZOMATO|SWIGGY|BLINKIT FOOD|AMUL|ZEROX|PARLOUR|BAKERY|JUICE|RESTAURANT|CAFE|CANTEEN|DHABA|HOTEL FOOD|SNACKS|PIZZA|BURGER|DOMINOES|MCDONALDS|STARBUCKS|CHAAYOS"),
    ("Utility / Bills", "word", "ELECTRICITY|MSEB|BESCOM|TNEB|TORRENT POWER|TPDDL|BSES|BEST ELECTRIC|WATER BILL|GAS BILL|PIPED GAS|BROADBAND|WIFI BILL|TELEPHONE BILL|JIOFIBER|BSNL|AIRTEL FIBER|MOBILE RECHARGE|DTH RECHARGE"),
    ("Rent / Lease", "word", "RENT PAYMENT|MONTHLY RENT|HOUSE RENT|OFFICE RENT|PROPERTY RENT|LEASE PAYMENT|LANDLORD|RENTAL DEPOSIT|ACCOMMODATION"),
    ("Software / SaaS", "word", "SUBSCRIPTION|SAAS|SOFTWARE LICENSE|CLOUD HOSTING|AWS|GOOGLE CLOUD|AZURE|ADOBE|GITHUB|CANVA|NETFLIX|HOTSTAR|PRIME VIDEO|SPOTIFY|DROPBOX|NOTION|SLACK|ZOOM"),
    ("Daily Needs / Retail", "word", "BIGBASKET|BLINKIT|ZEPTO|DUNZO|DMART|RELIANCE FRESH|JIOMART|GROFERS|SWIGGY INSTAMART|MORE RETAIL|SPAR|NATURA|HYPERCITY|WALMART|COSTCO"),
    ("Travel & Transport", "word", "UBER|OLA CAB|RAPIDO|IRCTC|RAILWAY|AIRLINE|SPICEJET|INDIGO|AIR INDIA|MAKEMYTRIP|YATRA|OYO|GOIBIBO|PETROL|FUEL STATION|SHELL|BHARAT PETROLEUM|HP PETROL"),
)
BANK = (
    ("HDFC Bank", "sub", "HDFC"), ("Citi Bank", "sub", "CITI"), ("Citi Bank", "word", "CIT"), ("ICICI Bank", "sub", "ICICI"), ("State Bank of India (SBI)", "sub", "SBI|STATE BANK"), ("Axis Bank", "sub", "AXIS"),
    ("Kotak Mahindra Bank", "sub", "KOTAK"), ("Bank of Baroda", "sub", "BARODA"), ("Clearing House (MICR)", "sub", "MICR|DEL ACCTS|CLEARING"), ("Branch BNA", "sub", "BNA"),
)
WEAK_MODE = (
    *MODE[:6], ("Cheque / Clearing", "word", "CHQ|CHEQUE|CLG|MICR|CLEARING|BY CLG"), ("NetBanking", "word", "NETBANKING|IB BILL|BILLPAY|ONLINE BANK"),
    ("Bank Charges", "word", "SERVICE CHARGE|CHARGES|MARKUP|STATEMENT CHG|CHEQUE BOOK"),
)
WEAK_PURPOSE = (
    ("ATM Withdrawal", "word", "ATM WDL|ATM WITHDRAWAL|ATM CASH"), ("Bank Charges", "word", "SERVICE CHARGES|BANK CHARGES|STATEMENT CHARGES|CHEQUE BOOK CHARGES|MARKUP|ANNUAL FEE|SMS CHARGES"),
    ("Salary / Payroll", "word", "SALARY|PAYROLL|WAGES|REMUNERATION|IMPS BRN SALARY"),
    ("Investment / Wealth", "word", "MUTUAL FUND|SIP|DIVIDEND|SECURITIES|TRADING|DEMAT|ZERODHA|GROWW|EQUITY SHARES|STOCKS|SHARES"),
    ("Healthcare / Medical", "word", "APOLLO PHARMACY|MEDPLUS|NETMEDS|PHARMEASY|HEALTHKART|DIAGNOSTIC|HOSPITAL|NURSING HOME|PATHOLOGY"),
    ("Food & Dining", "word", "ZOMATO|SWIGGY|AMUL|ZEROX|PARLOUR|BAKERY|JUICE|RESTAURANT|CAFE|CANTEEN|DHABA|PIZZA|BURGER|DOMINOES|MCDONALDS|STARBUCKS"),
    ("Utility / Bills", "word", "ELECTRICITY|MSEB|BESCOM|TNEB|TORRENT POWER|TPDDL|BSES|WATER BILL|GAS BILL|BROADBAND|JIOFIBER|BSNL|AIRTEL FIBER|DTH RECHARGE|MOBILE RECHARGE"),
    ("Rent / Lease", "word", "RENT PAYMENT|MONTHLY RENT|HOUSE RENT|OFFICE RENT|LEASE PAYMENT|LANDLORD|RENTAL DEPOSIT"),
    ("Software / SaaS", "word", "SUBSCRIPTION|SAAS|SOFTWARE LICENSE|CLOUD HOSTING|AWS|AZURE|GOOGLE CLOUD|ADOBE|GITHUB|NETFLIX|HOTSTAR|PRIME VIDEO|SPOTIFY"),
    ("Daily Needs / Retail", "word", "BIGBASKET|BLINKIT|ZEPTO|DUNZO|DMART|RELIANCE FRESH|JIOMART|GROFERS"), ("Travel & Transport", "word", "UBER|OLA CAB|RAPIDO|IRCTC|MAKEMYTRIP|YATRA|OYO|GOIBIBO|PETROL|FUEL STATION"),
)
WEAK_BANK = (
    ("HDFC Bank", "sub", "HDFC"), ("Citi Bank", "sub", "CITI"), ("Citi Bank", "word", "CIT"), ("ICICI Bank", "sub", "ICICI"), ("State Bank of India (SBI)", "word", "SBI"), ("State Bank of India (SBI)", "sub", "STATE BANK"),
    ("Axis Bank", "sub", "AXIS"), ("Kotak Mahindra Bank", "sub", "KOTAK"), ("Bank of Baroda", "sub", "BARODA"), ("Bank of Baroda", "word", "BOB"), ("Clearing House (MICR)", "word", "MICR"),
    ("Clearing House (MICR)", "sub", "CLEARING|CLG"), ("Branch BNA", "word", "BNA"),
)
CHANNEL = (
    ("UPI", "sub", "UPI"), ("RTGS", "sub", "RTGS"), ("NEFT", "sub", "NEFT"), ("IMPS", "sub", "IMPS"), ("Cash / ATM", "sub", "CASH-BNA|ATM WDL|CASH WITHDRAWAL|ATM CASH|CASH"),
    ("Cheque / Clearing", "sub", "CHQ|CHEQUE|CLEARING|BY CLG"),
)
CATEGORY = (
    ("Salary / Payroll", "sub", "SALARY"), ("Rent Payment", "sub", "RENT"), ("Software & Subscriptions", "sub", "SUBSCRIPTION|SOFTWARE"), ("Cash & ATM", "sub", "CASH|ATM|BNA|WITHDRAWAL"),
    ("Vendor / Business", "sub", "LTD|CORP|PVT|ENTERPRISES|INDUSTRIES|TRADING|SOLUTIONS|INFOTECH|HEALTHCARE|PHARMA|PROPERTIES"), ("Cheque Clearing", "sub", "CHQ|CHEQUE|CLEARING"),
)
DEBIT_PHRASES = "CHQ PAID|CHEQUE PAID|ATM WDL|WITHDRAWAL|WDL|BILLPAY DR|UPI DR|NEFT DR|RTGS DR|IMPS DR"
CREDIT_WORDS = "CR|CREDIT|DEPOSIT|INWARD|REFUND|SALARY TRF|UPI CR|NEFT CR|RTGS CR|IMPS CR"
DEBIT_WORDS = "DR|DEBIT|PAID|OUTWARD"
SALUTED = r"\b(MR|MS|MRS|DR|SHRI|SHREE|KU|MISS)\s+[A-Z]{2,}\s+[A-Z]{2,}\b"
NOT_PERSONS = "GOOGLE|AMAZON|FLIPKART|PAYTM|PHONE|HDFC|ICICI|AXIS|SBI|BANK|STORE|SHOP|MART|INDIA|PVT|LTD|CORP|ZEROX|AMUL|BLINKIT|ZOMATO|SWIGGY|DIGITAL|SERVICES|PAYMENT|GATEWAY|NETWORK|SOLUTIONS"
WEAK_NOT_PERSONS = "GOOGLE|AMAZON|FLIPKART|PAYTM|HDFC|ICICI|AXIS|SBI|BANK|STORE|SHOP|MART|INDIA|PVT|LTD|CORP|ZEROX|AMUL|BLINKIT|ZOMATO|SWIGGY"
SEGMENT_NOISE = "UPI|CR|DR|NEFT|RTGS|IMPS|CASH|BNA|ATM|WDL|CHQ|PAID|MICR|INWARD|CLEARING|SALARY|RENT|TRF|BY|TRANSFER|GPAY|PAYTM|PHONEPE|NONE|URGENT"
SEGMENT_VETO = "BANK|CHARGES|SERVICE|STATEMENT|SUBSCRIPTION|PAYMENT|ACCTS|LIMITED|LTD|PVT|CORP"
NAME_NOISE = "GPAY|PAYTM|PHONEPE|BHIM|COLLECT REQUEST|UPI|DR|CR"
PERSON = r"^UPI-([A-Z][A-Z ]{3,35}?)(?:-[A-Z0-9@.]+|-[A-Z0-9]{2,}@|@|$)"
WEAK_PERSON = r"^UPI-([A-Z][A-Z ]{3,30})-"
DEBIT_COLUMNS = ("Debit", "Withdrawal", "Withdrawal Amt.", "Withdrawal Amount", "Dr", "Debit Amt", "Debit Amount")
CREDIT_COLUMNS = ("Credit", "Deposit", "Deposit Amt.", "Deposit Amount", "Cr", "Credit Amt", "Credit Amount")
FLAG_COLUMNS = ("Cr/Dr", "CR/DR", "Direction", "Txn Type", "Type", "CR_DR")


def word(text: Column, words: str) -> Column:
    return text.rlike(u(rf"\b({words})\b"))


def first_rule(text: Column, rules: tuple, default: str | None = None) -> Column:
    """The label of the first rule that fits upper-cased text; one pass for all rules.

    A look-ahead meets every place of the text and takes the first rule's words that begin there, so places may overlap;
    of all places the first rule counts.
    """
    ranks: dict[str, int] = {}
    for i, (label, _, words) in enumerate(rules):
        for w in words.split("|"):
            if ranks.setdefault(w, i) != i and rules[ranks[w]][0] != label:
                raise ValueError(f"{w!r} stands in two rules")
    pattern = "|".join(rf"\b(?:{words})\b" if kind == "word" else words for _, kind, words in rules)
    found = F.regexp_extract_all(F.upper(text), F.lit(u(f"(?=({pattern}))")), F.lit(1))
    rank_of = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    rank = F.array_min(F.transform(found, lambda w: F.element_at(rank_of, w)))
    label = F.get(F.array(*[F.lit(label) for label, _, _ in rules]), rank)
    return F.coalesce(label, F.lit(default)) if default is not None else label


def first_named(columns: list[str], names: tuple[str, ...]) -> list[Column]:
    """The columns of a table that have one of the names, in the order of the names."""
    return [F.col(f"`{n}`") for n in names if n in columns]


def direction_of_table(columns: list[str]) -> Column:
    """Direction by whatever columns for either side and for flags a table has; null where they don't tell.

    A side has a value if any of its columns has; of the flags the first that says credit or debit counts.
    """
    filled = lambda names: reduce(lambda a, b: a | b, map(has_value, first_named(columns, names)), F.lit(False))
    debit, credit = filled(DEBIT_COLUMNS), filled(CREDIT_COLUMNS)
    said = [direction_of_columns(F.lit(False), F.lit(False), c.cast("string")) for c in first_named(columns, FLAG_COLUMNS)]
    return F.coalesce(direction_of_columns(debit, credit), *said)


def direction_of_columns(debit: Column, credit: Column, flag: Column | None = None) -> Column:
    """Debit or credit if exactly one side has a value, else by the flag, else null."""
    out = F.when(debit & ~credit, "Debit").when(credit & ~debit, "Credit")
    if flag is not None:
        f = F.upper(F.btrim(flag))
        out = out.when(f.isin("CR", "CREDIT"), "Credit").when(f.isin("DR", "DEBIT"), "Debit")
    return out


def direction_of_text(text: Column) -> Column:
    t = F.upper(text)
    return F.when(word(t, DEBIT_PHRASES), "Debit").when(word(t, CREDIT_WORDS) & ~word(t, DEBIT_WORDS), "Credit").when(word(t, DEBIT_WORDS), "Debit")


def weak_direction(debit: Column, credit: Column, flag: Column) -> Column:
    """For training: a debit counts first, even if both sides have a value."""
    f = F.upper(F.btrim(flag))
    return F.when(debit, "Debit").when(credit, "Credit").when(f.isin("CR", "CREDIT"), "Credit").when(f.isin("DR", "DEBIT"), "Debit")


def _named(text: Column, pattern: str, veto: str) -> Column:
    name = F.btrim(F.regexp_extract(F.upper(text), pattern, 1))
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("^[A-Z]+$")) & ~word(name, veto)


def is_person(raw: Column) -> Column:
    return _named(raw, PERSON, NOT_PERSONS) | F.upper(raw).rlike(u(SALUTED))


def purpose_rule(raw: Column) -> Column:
    return F.coalesce(first_rule(raw, PURPOSE), F.when(is_person(raw), "Personal / P2P Transfer"))


def weak_purpose(raw: Column) -> Column:
    return F.coalesce(first_rule(raw, WEAK_PURPOSE), F.when(_named(raw, WEAK_PERSON, WEAK_NOT_PERSONS), "Personal / P2P Transfer"))


def channel(raw: Column) -> Column:
    return F.when(raw.isNull(), "Unknown").otherwise(first_rule(raw, CHANNEL, "Bank Transfer"))


def category(cleaned: Column, raw: Column) -> Column:
    return first_rule(F.concat(cleaned, F.lit(" "), raw), CATEGORY, "Personal / Transfer")


def counterparty(raw: Column) -> Column:
    """Known entity, `Self`, the name run of a UPI narration, or the last telling segment."""
    up = F.upper(raw)
    known = F.get(F.filter(F.array(*map(F.lit, ENTITIES)), lambda e: F.contains(up, e)), F.lit(0))
    segments = F.transform(F.split(F.substr(raw, F.lit(5)), "-", -1), lambda s: F.btrim(s))
    named = F.transform(segments, lambda s: s.rlike(r"^[A-Za-z][A-Za-z ]*$") & (F.length(s) >= 2))
    start = F.array_position(named, True)
    after = F.slice(named, F.greatest(start, F.lit(1)).cast("int"), F.size(named))
    stop = F.array_position(after, False)
    run = F.slice(segments, F.greatest(start, F.lit(1)).cast("int"), F.when(stop > 0, stop - 1).otherwise(F.size(after)).cast("int"))
    name = F.btrim(F.regexp_replace(F.array_join(run, " "), u(rf"(?i)\b({NAME_NOISE})\b"), ""))
    upi = F.when(F.startswith(up, F.lit("UPI-")) & (start > 0) & (F.length(name) >= 3), name)
    parts = F.transform(F.split(raw, "[-–—:]", -1), lambda s: F.btrim(s))
    cleaned = F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.btrim(F.regexp_replace(F.regexp_replace(s, u(r"\S*@\S+"), ""), u(rf"(?i)\b({SEGMENT_NOISE})\b"), "")))
    good = F.filter(cleaned, lambda s: (F.length(s) >= 4) & ~F.replace(s, F.lit(" "), F.lit("")).rlike(r"^\d+$") & ~s.rlike(u(rf"(?i)\b({SEGMENT_VETO})\b")))
    return F.when(known.isNotNull(), title_case(known)).when(word(up, "SELF"), "Self").when(upi.isNotNull(), title_case(upi)).otherwise(F.coalesce(title_case(F.element_at(F.when(F.size(good) > 0, good), -1)), F.lit("Not Specified")))
