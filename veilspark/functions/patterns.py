"""The pattern table: what is looked for, how sure a hit is, which words help.

A caller may pass a table of their own; nothing below is global state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values -----------------------------------------------------------
# Entity types in rank order with their descriptions.
ENTITY_TYPES: dict[str, str] = {
    "PERSON": "Names of people",
    "EMAIL_ADDRESS": "Email addresses",
    "PHONE_NUMBER": "Phone numbers",
    "CREDIT_CARD": "Credit card numbers",
    "US_SSN": "US Social Security Numbers",
    "US_BANK_NUMBER": "US Bank account numbers",
    "US_DRIVER_LICENSE": "US Driver's license numbers",
    "US_ITIN": "US Individual Taxpayer ID Numbers",
    "US_PASSPORT": "US Passport numbers",
    "IP_ADDRESS": "IP addresses (v4 and v6) with optional CIDR",
    "LOCATION": "Geographic locations (cities, countries)",
    "STREET_ADDRESS": "Street addresses (e.g., 123 Main Street)",
    "DATE_TIME": "Dates and times",
    "NRP": "Nationality, Religious, Political groups",
    "MEDICAL_LICENSE": "Medical license numbers",
    "URL": "URLs and web addresses",
    "IBAN_CODE": "International Bank Account Numbers",
    "CRYPTO": "Cryptocurrency addresses",
    "GUID": "Globally Unique Identifiers (GUIDs/UUIDs)",
    "COORDINATE": "Geographic coordinates (latitude/longitude)",
}
TYPE_RANK = {name: rank for rank, name in enumerate(ENTITY_TYPES)}

# Words that raise the score of a hit when they stand shortly before it.
CONTEXT_WORDS: dict[str, tuple[str, ...]] = {
    "STREET_ADDRESS": (
        "address", "addr", "location", "located",
        "ship", "shipping", "deliver", "delivery",
        "mail", "mailing", "postal",
        "home", "office", "work", "business",
        "residence", "residential", "billing",
        "live", "lives", "living", "reside", "resides",
        "send", "sending", "sent",
        "street", "avenue", "road", "drive", "lane",
    ),
    "US_SSN": ("ssn", "social", "security", "social security", "ss#", "ss #", "soc sec"),
    "DATE_TIME": (
        "dob", "date of birth", "birth", "born", "birthday",
        "issued", "expires", "expiration", "exp", "valid",
        "signed", "effective", "terminated",
    ),
    "GUID": (
        "guid", "uuid", "id", "identifier", "user", "tenant", "resource",
        "object", "session", "correlation", "request", "transaction",
    ),
    "COORDINATE": (
        "latitude", "lat", "longitude", "lng", "long", "lon",
        "coordinates", "coord", "coords", "geo", "geoCoordinates",
        "location", "position", "gps",
    ),
    "PHONE_NUMBER": (
        "call", "phone", "telephone", "tel", "mobile", "cell",
        "contact", "reach", "dial", "ring", "text", "sms",
        "number", "ext", "extension", "fax", "at",
    ),
    "US_ITIN": ("itin", "taxpayer"),
    "US_PASSPORT": ("passport",),
    "US_BANK_NUMBER": ("account", "bank", "routing", "deposit"),
    "US_DRIVER_LICENSE": ("license", "driver"),
    "MEDICAL_LICENSE": ("medical", "license", "physician"),
}

# How context changes a score.
CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.4
CONTEXT_TOKENS = 5
DEFAULT_THRESHOLD = 0.7

_SUFFIX = (
    r"Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Lane|Ln\.?"
    r"|Way|Court|Ct\.?|Place|Pl\.?"
)
_SUFFIX_MORE = r"|Circle|Cir\.?|Trail|Trl\.?|Parkway|Pkwy\.?|Highway|Hwy\.?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CARD = (
    r"4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}"
)


# --- end of fixed values ----------------------------------------------------


# The shape of a text has 0 for its digits, A and a for its letters, one kind of blank.
SHAPE = ("123456789BCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz\t\n\x0b\f\r",
         "0" * 9 + "A" * 25 + "a" * 25 + " " * 5)
_DAY_YEAR = tuple(f"{a}{day}{b}0000" for a in "/-" for day in ("0", "00") for b in "/-")
_NUMBERED = ("0 a", "0 A", "0  ")  # a house number and the word behind it


@dataclass(frozen=True)
class Pattern:
    entity_type: str
    name: str
    regex: str
    score: float
    ignore_case: bool = True
    must_contain: str | None = None  # literal every hit holds; a byte search comes first
    has_digit: bool = True  # every hit holds a digit; one test then spares many patterns
    checksum: str | None = None  # "luhn" or "mod97"
    shapes: tuple[str, ...] = ()  # every hit in an ASCII text holds one of these (see SHAPE)

    @property
    def context(self) -> tuple[str, ...]:
        return CONTEXT_WORDS.get(self.entity_type, ())

    @property
    def java(self) -> str:
        """The regex for Java: word, digit and space classes as in Unicode on any JVM."""
        return ("(?iU)" if self.ignore_case else "(?U)") + self.regex

    @property
    def ascii(self) -> str:
        """The regex for texts of ASCII only: the same matches, found faster."""
        return ("(?i)" if self.ignore_case else "") + self.regex

    @property
    def best_score(self) -> float:
        return min(1.0, self.score + CONTEXT_BOOST) if self.context else self.score


def _street(end: str, again: bool = True) -> str:
    """A number, any number of words, and a word that is or ends in a street suffix.

    Plain words are taken one by one without giving back, up to the next word with the
    suffix: a possessive repeat is a loop in Java and needs no stack, however long the
    run of words. The last suffix of a run ends the address; a unit ends it at once.
    """
    last = rf"(?:[A-Z]{{2,}})?{end}"
    plain = rf"(?!{last})[A-Z]{{2,}}+(?=\s)"
    block = rf"(?:{plain}\s+)*+{last}"
    more = rf"(?:\s+{block})*+" if again else ""
    return rf"\b\d{{1,5}}\s+(?:[A-Z]{{2,}}+\s+{block}{more}|[A-Z]{{2,}}{end})"


def _ipv6() -> str:
    """All eight groups, or fewer around one ``::``, or a network with its prefix.

    Addresses in use start with a digit or with fc to ff, which tells them from names
    joined by colons.
    """
    first, group = "(?:[0-9][0-9a-f]{0,3}|f[c-f][0-9a-f]{2})", "[0-9a-f]{1,4}"
    forms = [f"{first}(?::{group}){{7}}"]
    forms += [f"{first}(?::{group}){{{n}}}:(?::{group}){{1,{6 - n}}}" for n in range(6)]
    prefix = "(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])"
    return (rf"\b(?:(?:{'|'.join(forms)})\b(?:/{prefix}\b)?"
            rf"|{first}(?::{group}){{0,6}}::/{prefix}\b)")


# --- fixed values -----------------------------------------------------------
PATTERNS: tuple[Pattern, ...] = (
    Pattern("STREET_ADDRESS", "street_address_full",
            _street(f"(?:{_SUFFIX}{_SUFFIX_MORE})" + r"\b"), 0.6, shapes=_NUMBERED),
    Pattern("STREET_ADDRESS", "street_address_with_unit",
            _street(f"(?:{_SUFFIX})" + r"\s*,?\s*(?:Apt\.?|Suite|Ste\.?|Unit|#)\s*\d+[A-Z]?\b",
                    again=False), 0.7, shapes=_NUMBERED),
    Pattern("IP_ADDRESS", "ipv4_cidr",
            r"\b(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?:/(?:3[0-2]|[12]?[0-9]))?\b", 0.8,
            must_contain=".", shapes=("0.0",)),
    Pattern("US_SSN", "ssn_dashes",
            r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.5, must_contain="-", shapes=("000-00-0000",)),
    Pattern("US_SSN", "ssn_no_dashes",
            r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b", 0.3, shapes=("000000000",)),
    Pattern("DATE_TIME", "date_mdy",
            r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", 0.4, shapes=_DAY_YEAR),
    Pattern("DATE_TIME", "date_iso",
            r"\b(?:19|20)\d{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01])\b", 0.4,
            must_contain="-", shapes=("0000-0",)),
    Pattern("DATE_TIME", "date_long", rf"\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", 0.5,
            shapes=("0 0000", "0, 0000", "  0000")),
    Pattern("LOCATION", "compound_location_hyphen",
            r"\b[A-Z][a-z]+(?:-(?:On|Upon|By|In|Under|Over|Le|La|The|Of|At|Near)-[A-Z][a-z]+\b)++",
            0.9, ignore_case=False, must_contain="-", has_digit=False, shapes=("a-A",)),
    Pattern("LOCATION", "compound_location_spaced",
            r"\b[A-Z][a-z]+\s+(?:upon|on|by|in|under|over|near)\s+[A-Z][a-z]+\b",
            0.85, ignore_case=False, has_digit=False, shapes=(" Aa",)),
    Pattern("GUID", "guid_standard",
            r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
            0.85, must_contain="-", has_digit=False),
    Pattern("COORDINATE", "coordinate_decimal", r"-?\d{1,3}\.\d{6,}", 0.85, must_contain=".", shapes=("0.000000",)),
    Pattern("PHONE_NUMBER", "us_phone_parens", r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}", 0.75,
            must_contain="(", shapes=("(000)",)),
    Pattern("PHONE_NUMBER", "us_phone_dashes", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", 0.65, shapes=("000-000", "000.000", "000 000")),
    Pattern("PHONE_NUMBER", "us_phone_10digit", r"\b\d{10}\b", 0.4, shapes=("0000000000",)),
    # Own definitions for types and forms that come without a pattern.
    Pattern("IP_ADDRESS", "ipv6", _ipv6(), 0.8, must_contain=":"),
    Pattern("PHONE_NUMBER", "phone_international",
            r"\+[1-9]\d{0,2}[-. ]?\(?\d{1,4}\)?(?:[-. ]?\d{2,4}){2,4}\b", 0.75,
            must_contain="+", shapes=("+0",)),
    Pattern("EMAIL_ADDRESS", "email", EMAIL, 1.0, must_contain="@", has_digit=False),
    Pattern("CREDIT_CARD", "card",
            rf"\b(?:{CARD}|\d{{4}}[- ]\d{{4}}[- ]\d{{4}}[- ]\d{{4}})\b", 1.0, checksum="luhn",
            shapes=("0000000000000", "0000-0000-0000", "0000 0000-0000", "0000-0000 0000",
                    "0000 0000 0000")),
    Pattern("URL", "url_scheme", r"""\bhttps?://[^\s<>"']*[^\s<>"'.,;:!?)\]}]""", 1.0,
            must_contain="://", has_digit=False),
    Pattern("URL", "url_www", r"""\bwww\.[^\s<>"']*[^\s<>"'.,;:!?)\]}]""", 0.6,
            must_contain=".", has_digit=False),
    Pattern("IBAN_CODE", "iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 1.0, ignore_case=False,
            checksum="mod97", shapes=("AA00",)),
    Pattern("CRYPTO", "wallet",
            r"\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,39}|bc1[a-z0-9]{25,39})\b", 0.75,
            ignore_case=False),
    Pattern("US_ITIN", "itin", r"\b9\d{2}-[7-9]\d-\d{4}\b", 0.5, must_contain="-", shapes=("000-00-0000",)),
    Pattern("US_PASSPORT", "passport", r"\b(?:\d{9}|[A-Z]\d{8})\b", 0.4, shapes=("00000000",)),
    Pattern("US_BANK_NUMBER", "bank_number", r"\b\d{8,17}\b", 0.4, shapes=("00000000",)),
    Pattern("US_DRIVER_LICENSE", "driver_license", r"\b[A-Z]\d{12}\b", 0.4, shapes=("000000000000",)),
    Pattern("MEDICAL_LICENSE", "medical_license", r"\b(?:ML\d{1,8}|[A-Z]{2}\d{7})\b", 0.4,
            shapes=("AA0", "Aa0", "aA0", "aa0")),
)

# The cruder set of the before/after check: no scores, case as written.
AUDIT_PATTERNS: dict[str, str] = {
    "email": EMAIL,
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ip_address": r"\b(?:" + _OCTET + r"\.){3}" + _OCTET + r"\b",
    "credit_card": rf"\b(?:{CARD})\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "date": r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)?[0-9]{2}\b",
}
# --- end of fixed values ----------------------------------------------------


def select_patterns(
    entity_types: list[str] | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    patterns: tuple[Pattern, ...] = PATTERNS,
    case_sensitive_streets: bool = False,
) -> list[Pattern]:
    """The patterns worth running: of a wanted type and able to reach the threshold.

    No type asked for means all types. Unknown types are an error rather than
    silently dropped, since a misspelt type would leave values in the text.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0.0 and 1.0")
    unknown = sorted(set(entity_types or ()) - set(ENTITY_TYPES))
    if unknown:
        raise ValueError(f"unknown entity types: {', '.join(unknown)}")
    wanted = set(entity_types or ENTITY_TYPES)
    chosen = []
    for p in patterns:
        if p.entity_type not in wanted or round(p.best_score, 4) < threshold:
            continue
        if case_sensitive_streets and p.entity_type == "STREET_ADDRESS":
            body = p.regex.replace("[A-Z]{2,}", "[A-Z][a-z]+")
            p = replace(p, regex=body, ignore_case=False)
        chosen.append(p)
    return chosen
