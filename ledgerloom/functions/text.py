"""Text functions on columns. Patterns follow Unicode classes where they meet text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that `strip` takes off.
_WS = " \t\n\r\x0b\x0c"

# What the narration cleaner replaces, in order.
CLEAN_STEPS = (
    (r"(?i)\b(RAMES|MANIS|RAJES|HEALTHC|INVESTME|WELLNES)\s*\n\s*([A-Z]+)\b", "$1$2"),
    (r"[\n\r]", " "), (r"\s+", " "), (r"(?i)/NONE\b", " "), (r"(?i)/URGENT/?", " "), (r"(?i)SENT-TRANSFER\s+FROM\s+\d*", " "),
    (r"(?i)UPI-TRANSFER\s+TO\s+\d*", " "), (r"(?i)FROM\s+\d{6,}", " "), (r"(?i)TO\s+\d{6,}", " "), (r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", " "),
    (r"\b[A-Za-z0-9]*\d+[A-Za-z0-9]*\b", " "), (r"[-–—]+", "-"), (r"[/\\|_]+", " "), (r"(?:\s*-\s*)+", " - "), (r"\s+", " "),
)

# Boilerplate of the first, stronger cleaner.
STRONG_STEPS = (
    (r"[\n\r]", " "), (r"\s+", " "), (r"(?i)/NONE", " "), (r"(?i)/URGENT/?", " "), (r"--+", " "), (r"(?i)SENT-TRANSFER\s+FROM\s+\d+", " "),
    (r"(?i)TRANSFER\s+FROM\s+\d+", " "), (r"(?i)FROM\s+\d{6,}", " "), (r"(?i)By\s+Clg\s*:\s*DEL\s+ACCTS\s*-\s*CITI\s+BANK\s+N\.A\.\(CIT\)\s*,?", " "),
    (r"(?i)Chq\s+Paid\s*-\s*MICR\s+Inward\s+Clearing\s*-\s*", " "), (r"(?i)HDFC\s+BANK\s+LTD\.?", " "), (r"(?i)CITI\s+BANK\s+N\.A\.\(CIT\)", " "),
    (r"(?i)IMPS\s+BRN\s+SALARY\s+TRF\s+BY\s*-\s*", " "), (r"(?i)FAILED\s*-\s*INSUFFICIENT\s+FUNDS\s*-\s*", " "), (r"(?i)CASH\s*-\s*BNA\s*-\s*SELF\s*-\s*", " "),
    (r"(?i)Cash\s+Withdrawal\s*-\s*", " "), (r"(?i)ATM\s+WDL\s*-\s*ATM\s+CASH\s*\d*", " "), (r"(?i)ATM\s+CASH\s*\d*", " "),
    (r"(?i)\b(UPI|RTGS|NEFT|IMPS)\s*/?\s*(Dr|Cr|DR|CR)?\s*[-/]?\s*[A-Z0-9]{8,24}\s*[-/]", " "), (r"(?i)\b(UPI|RTGS|NEFT|IMPS)\s*(Dr|Cr|DR|CR)?\s*[-/]\s*", " "),
    (r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", " "), (r"\b\d{6,}\b", " "), (r"[/\\|:_\-]+", " "), (r"\s+", " "),
)

# The deep cleaner's patterns, on upper-case text, in order.
DEEP_STEPS = (
    (r"[\n\r]", " "), (r"\s+", " "),
    (r"(?i)\S+@(?:ok|ybl|axl|hdfcbank|icici|paytm|okaxis|okbizaxis|okbiz|ibl|sbi|pnb|boi|unionbank|federal|icicib|upi|apl|timecosmos|jupiter|slice|kbl|kvb|rbl|fbl|naviaxis|yesbank|aubank|dbs|postbank|mahb|axis)\b", " "),
    (r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", " "), (r"(?i)\b(UTR|REF|TXN|TXNID|CRN|ARN|RRN|TRAN|CLRN)[\/\-\:]?\s*[A-Z0-9]{6,}\b", " "), (r"\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b", " "),
    (r"\b\d{12,22}\b", " "), (r"(?i)\b[A-Z0-9]*X{4,}[A-Z0-9]*\b", " "), (r"\b[6-9]\d{9}\b", " "), (r"\b\d{9,20}\b", " "),
    (r"\b(SENT|RECEIVED|NONE|URGENT|NORMAL|NEFT|RTGS|IMPS|UPI|BILLPAY|IB|ACH|AUTO|DEBIT|CREDIT)\s+(TO|FROM)\b", " "), (r"[-–—/\\|_:]+", " "),
    (r"(?i)\b(TO|FROM|BY|FOR|AT|ON|IN|OF|AND|OR|THE|A|AN|IS|WAS|ARE|WITH|TRF|TRANSFER|TXN|PAYMENT|PAY|AMT|AMOUNT|RS|INR|BALANCE|BAL|NTNL|INTNL|CHARGES|CHARGE|FEE|FEES)\b", " "),
    (r"[^A-Z0-9 ]", " "), (r"\s+", " "),
)

AMOUNT = r"(?:Rs\.?\s*)?(\d{1,3}(?:,\d{2,3})*\.\d{2}|\d+\.\d{2})"
DATE = r"(\d{2}[-/]\d{2}[-/]\d{2,4})"
VALUE_DATE = r"(\d{2}\s+[A-Za-z]{3}\s+\d{4}|\d{2}[-/]\d{2}[-/]\d{2,4})"


def u(pattern: str) -> str:
    """A pattern whose classes and word ends are those of Unicode."""
    return "(?U)" + pattern


def replace_all(text: Column, steps: tuple) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, u(s[0]), s[1]), steps, text)


def strip(text: Column, chars: str = _WS) -> Column:
    return F.btrim(text, F.lit(chars))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, u(r"\s+"), " "), " ")


def clean_description(raw: Column) -> Column:
    """Narrations without references, codes and boilerplate; null and blank give the empty text."""
    return strip(replace_all(strip(F.coalesce(raw, F.lit(""))), CLEAN_STEPS), " -:,./")


def strong_clean(raw: Column) -> Column:
    """The first cleaner: mode prefixes and boilerplate go as well."""
    text = strip(replace_all(strip(F.coalesce(raw, F.lit(""))), STRONG_STEPS), " ")
    return strip(F.regexp_replace(text, u(r"^[^\w]+|[^\w]+$"), ""))


def deep_clean(raw: Column) -> Column:
    """For training: identifiers and filler go, tokens of one character too; lower-cased."""
    text = replace_all(F.upper(strip(F.coalesce(raw, F.lit("")))), DEEP_STEPS)
    return F.lower(F.array_join(F.filter(F.split(text, " "), lambda t: F.length(t) >= 2), " "))


def raw_text(col: Column, null_as_nan: bool = True) -> Column:
    """A missing description is the text `nan` by default, as in a table read as strings."""
    return F.coalesce(col, F.lit("nan" if null_as_nan else ""))


def eval_text(raw: Column) -> Column:
    """The cleaned text, which is worked out once, or the raw one where nothing is left."""
    return F.coalesce(F.nullif(clean_description(raw), F.lit("")), raw)


def amount(text: Column) -> Column:
    """The number in an amount such as `Rs. 1,234.00`; 0.0 where there is none."""
    return F.coalesce(F.replace(F.replace(text, F.lit("Rs."), F.lit("")), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def rupees(number: Column) -> Column:
    return F.when(number != "", F.concat(F.lit("Rs. "), number)).otherwise("")


def title_case(text: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def slug(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(text), F.lit(" / "), F.lit("_")), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))


def stem(name: Column) -> Column:
    """A file name without its extension, safe as a folder name; never empty."""
    base = F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", "")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(base, r"[^A-Za-z0-9_\-]+", "_"), F.lit("_")), F.lit("")), F.lit("statement"))


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def has_value(col: Column) -> Column:
    text = strip(F.replace(F.replace(col, F.lit("Rs."), F.lit("")), F.lit(","), F.lit("")))
    return F.coalesce(~text.isin("", "0", "0.0", "0.00", "-", "nan", "None"), F.lit(False))


def is_exemplar(text: Column) -> Column:
    """Long enough, of three real words or more, not noise, and not mostly numbers."""
    words = F.filter(F.split(text, " "), lambda t: t != "")
    real = F.filter(words, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$"))
    numbers = F.size(F.filter(words, lambda t: t.rlike(r"^\d+$")))
    return (F.length(text) >= 12) & (F.size(real) >= 3) & ~text.rlike(r"(?i)^(\d+\s+upi|collect request|esb|hdfc0|upi$|\d+$)") & (numbers / F.greatest(F.size(words), F.lit(1)) <= 0.5)
