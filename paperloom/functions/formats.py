"""Format checks of text columns: true or false, null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.values import strip

#: Whole-text patterns.
PATTERNS = {
    "email": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "url": r"https?://[^\s]+",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "digits": r"(?U)\d+",
    "alphanumeric": r"[A-Za-z0-9]+",
}
#: Currency codes.
CURRENCIES = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF
CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD
HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL
LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR
PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND
TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL
""".split()


def matches(s: Column, name: str) -> Column:
    pattern = PATTERNS[name]
    flags, body = ("(?U)", pattern[4:]) if pattern.startswith("(?U)") else ("", pattern)
    return strip(s).rlike(f"{flags}^(?:{body})$")


def iban(s: Column) -> Column:
    """Length 15 to 34, two letters, two digits, and remainder 1 modulo 97 after the rotation."""
    bare = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    rotated = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    number = F.transform(F.filter(F.split(rotated, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int")))
    left = F.aggregate(number, F.lit(0), lambda a, d: F.when(d < 10, (a * 10 + d) % 97).otherwise((a * 100 + d) % 97))
    return F.when(s.isNotNull(), bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (left == 1))


def luhn(s: Column) -> Column:
    bare = F.translate(s, " -", "")
    return bare.rlike("^[0-9]{2,}$") & F.call_function("luhn_check", bare)


def in_codes(s: Column, codes: list[str]) -> Column:
    return F.upper(strip(s)).isin(codes)


def check(s: Column, name: str, codes: list[str] | None = None) -> Column:
    """Any of the format checks by its name; iso_country takes the two-letter codes that are known as a parameter."""
    if name in PATTERNS:
        return matches(s, name)
    if name == "iban":
        return iban(s)
    if name == "luhn":
        return luhn(s)
    if name == "iso_currency":
        return in_codes(s, codes or CURRENCIES)
    if name == "iso_country":
        if not codes:
            raise ValueError("iso_country needs the codes that are known")
        return in_codes(s, codes)
    raise ValueError(f"no format {name!r}")
