"""Header and value patterns for personal data, as Spark SQL text."""

from __future__ import annotations

from datawarden.functions.scalars import matches

# ---------------------------------------------------------------------------
# Fixed values. Header patterns are tried in this order; the first hit wins.
# ---------------------------------------------------------------------------
HEADER_PATTERNS = (
    ("EMAIL", r"\bemail\b|\be ?mail\b"),
    ("IP_ADDRESS", r"\b(ip|ip ?addr(?:ess)?|ipv4|ipv6|client ip|remote addr)\b"),
    ("CREDIT_CARD", r"\b(credit card|card ?(?:no|num|number)|cc ?(?:no|num|number)?|pan)\b"),
    (
        "ID_NUMBER",
        r"\b(ssn|social security(?: (?:no|number))?|national id|passport(?: (?:no|number))?"
        r"|aadhaar|aadhar|tax id|ein|nino|government id|gov id)\b",
    ),
    (
        "PHONE",
        r"\b(phone|mobile|cell(?: ?phone)?|telephone|tel|msisdn|fax)\b"
        r"|\bcontact ?(?:no|num|number)\b",
    ),
    ("DATE_OF_BIRTH", r"\b(dob|date of birth|birth ?date|birthday|bday)\b"),
    ("POSTAL_CODE", r"\b(zip(?: ?code)?|postal ?code|post ?code|postcode|pin ?code|pincode)\b"),
    ("NAME", r"\b((?:first|last|full|given|middle|sur) ?name|f ?name|l ?name|surname|name)\b"),
    ("ADDRESS", r"\b(address|addr|street(?: address)?|mailing address|billing address)\b"),
)
# \s of the value patterns is spelled out where it must cover Unicode spaces.
SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
EMAIL_PATTERN = rf"^[^{SPACE}@]+@[^{SPACE}@]+\.[^{SPACE}@]{{2,}}$"
IPV4_PATTERN = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
)
IPV6_PATTERN = r"^(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}$"
PHONE_PATTERN = rf"^\+?[0-9][0-9{SPACE}().\-]{{5,20}}[0-9]$"
CARD_PATTERN = r"^(?:[0-9][ \-]?){13,19}$"
SSN_PATTERN = r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$"
DATE_PATTERN = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4})$"
POSTAL_PATTERN = r"^[0-9]{5}(?:-[0-9]{4})?$"
# Order in which value categories win a tie.
VALUE_CATEGORIES = (
    "EMAIL", "IP_ADDRESS", "CREDIT_CARD", "PHONE", "ID_NUMBER", "DATE_OF_BIRTH", "POSTAL_CODE",
)
# Too common to mean anything alone: they count only under a header that hints them.
HINTED = ("DATE_OF_BIRTH", "POSTAL_CODE")
STRONG_CATEGORIES = ("EMAIL", "PHONE", "IP_ADDRESS", "CREDIT_CARD")
# ---------------------------------------------------------------------------


def normal_header(x: str) -> str:
    """Lower case, separator runs as one space, no outer spaces."""
    return f"trim(regexp_replace(lower({x}), r'[{SPACE}_\\-]+', ' '))"


def header_category(x: str) -> str:
    """The category a column name hints at, or null."""
    # Only ASCII letters and digits are word characters of these patterns. Java's \b also
    # counts other letters, so they are replaced by a character no pattern contains.
    header = f"regexp_replace({normal_header(x)}, r'[^\\x00-\\x7f]', '#')"
    cases = " ".join(f"WHEN {matches(header, p)} THEN '{c}'" for c, p in HEADER_PATTERNS)
    return f"CASE {cases} END"


def value_tests(x: str, hinted: str) -> dict[str, str]:
    """One boolean per value category for a trimmed cell; `hinted` is the header's category."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    return {
        "EMAIL": matches(x, EMAIL_PATTERN),
        "IP_ADDRESS": f"({matches(x, IPV4_PATTERN)} OR {matches(x, IPV6_PATTERN)})",
        "CREDIT_CARD": f"({matches(x, CARD_PATTERN)} AND length({digits}) BETWEEN 13 AND 19 "
        f"AND luhn_check({digits}))",
        "PHONE": f"({matches(x, PHONE_PATTERN)} AND length({digits}) BETWEEN 7 AND 15 "
        f"AND NOT {matches(x, DATE_PATTERN)})",
        "ID_NUMBER": matches(x, SSN_PATTERN),
        "DATE_OF_BIRTH": f"({hinted} <=> 'DATE_OF_BIRTH' AND {matches(x, DATE_PATTERN)})",
        "POSTAL_CODE": f"({hinted} <=> 'POSTAL_CODE' AND {matches(x, POSTAL_PATTERN)})",
    }
