"""What is looked for: classes, their words, numbers and shapes.

The values in this module are fixed: they define the classes, and results depend on each.
"""

from __future__ import annotations

from dataclasses import dataclass

# Evaluation order and severity of the classes.
CLASSES = ("us_ssn", "us_itin", "card", "dob", "cvv", "pin", "account_number", "us_ssn_last4")
SEVERITY = {"us_ssn": "high", "us_itin": "high", "card": "high", "dob": "medium", "cvv": "high", "pin": "high", "account_number": "medium", "us_ssn_last4": "low"}

# Words near a value that confirm its class.
CONTEXT_WORDS = {
    "us_ssn": ("social", "ssn", "social security"),
    "us_itin": ("itin", "taxpayer identification", "taxpayer id", "social", "ssn", "social security"),
    "card": (
        "card", "cards", "credit", "debit", "visa", "mastercard", "master card", "amex", "american express", "discover", "jcb", "diners", "unionpay",
        "union pay", "maestro", "cardholder", "exp", "expiry", "expiration", "expires", "cvv", "cvc", "payment", "billing",
    ),
    "dob": ("date of birth", "dob", "d.o.b", "born", "birth date", "birthdate", "birthday"),
}

# Phrases taken out before context words are looked for.
CONTEXT_EXCLUSIONS = {
    "us_ssn": ("last (?:four|4)(?: digits)?(?: of)?(?: (?:your|the|my))? (?:social(?: security)?(?: number)?|ssn|itin)", "social[- ]media"),
    "us_itin": ("last (?:four|4)(?: digits)?(?: of)?(?: (?:your|the|my))? (?:social(?: security)?(?: number)?|ssn|itin)", "social[- ]media"),
}

# Words near a card-like number that make it something else.
SUPPRESS_WORDS = {
    "card": (
        "order", "invoice", "tracking", "phone", "telephone", "mobile", "fax", "imei", "iccid", "isbn", "serial", "uuid", "guid", "trace",
        "request id", "transaction id", "txn", "confirmation", "reference", "ref", "account id", "customer id", "timestamp", "epoch",
    )
}

# What a prompt says to ask for a class.
PROMPT_PHRASES = {
    "us_ssn": ("social(?: security)? number", "(?:nine|9)[- ]digit social(?: security)?(?: number)?(?! media)", "ssn"),
    "us_itin": ("social(?: security)? number", "(?:nine|9)[- ]digit social(?: security)?(?: number)?(?! media)", "ssn", "itin", "taxpayer id(?:entification)? number"),
    "card": ("(?:credit |debit )?card number", "(?:credit|debit) card", "number on (?:the front of )?your (?:credit |debit )?card"),
    "dob": ("date of birth", "dob", "birth ?date", "birthday", "born"),
    "cvv": ("security code", "cvv", "cvc", "(?:three|four|3|4)[- ]digit (?:security )?code", "(?:number|code) on the back of (?:your|the) card"),
    "pin": ("pin",),
    "account_number": ("account number",),
    "us_ssn_last4": ("last (?:four|4)(?: digits)?(?: of)?(?: (?:your|the|my))? (?:social(?: security)?(?: number)?|ssn)",),
}

# The numbers of digits of prompted classes.
DIGITS = {"us_ssn": (9, 9), "us_itin": (9, 9), "card": (13, 19), "cvv": (3, 4), "pin": (4, 6), "account_number": (6, 17), "us_ssn_last4": (4, 4)}

# Prompts that repeat the last one.
RETRY_PREFIXES = ("sorry i didn't get that", "sorry i didn't catch that", "i'm sorry i didn't get that", "i'm sorry i didn't catch that")

# Turns that end another speaker's open value.
MENU_OR_QUESTION = (r"\?", r"\bpress(?:ing)?\b", r"\breply\b", r"\bsay\b", r"\benter\b", r"\btype\b", r"\bselect\b", r"\bchoose\b", r"\bdial\b", r"\bmenu\b")

JOIN_SECONDS, JOIN_INTERVENING, CONTEXT_TURNS = 15, 3, 2

# A time of day, which makes the date before it a timestamp.
TIME_OF_DAY = r"(?:t|[ \t]+)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2,})*(?:[ \t]*(?:am|pm))?(?:z|[ \t]*(?:utc|gmt)|[ \t]*[+-][0-9]{2}:?[0-9]{2})?(?![0-9])"

# How stored values are written (patterns of the ``re`` syntax that Java and Python share).
CARD_WRITTEN = r"(?<!\w)(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])(?!\w)"
NINE_WRITTEN = r"(?<!\w)(?:[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}|[0-9]{9})(?!\w)"
MONTH_WRITTEN = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATES_WRITTEN = (
    "(?<![0-9])[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{2})(?![0-9])",
    "(?<![0-9])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9])",
    rf"(?i:\b(?:{MONTH_WRITTEN})\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}\b)",
    rf"(?i:\b[0-9]{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{MONTH_WRITTEN})\.?,?\s+[0-9]{{4}}\b)",
)
#: Those of these patterns that match at the beginning of a run of digits only.
DIGIT_FIRST = (CARD_WRITTEN, NINE_WRITTEN, DATES_WRITTEN[0], DATES_WRITTEN[1], DATES_WRITTEN[3])
# Groups of digits that cards are printed in, marks of earlier redaction, last words of names of points in time.
CARD_GROUPS = "4-4-4-[1-4]|4-4-4-4-[1-3]|4-6-5|4-6-4"
REDACTION_MARKS = (
    "PII", "SSN", "CREDIT_DEBIT_NUMBER", "CREDIT_DEBIT_CVV", "CREDIT_DEBIT_EXPIRY", "PIN", "BANK_ACCOUNT_NUMBER", "BANK_ROUTING", "NAME", "ADDRESS", "EMAIL", "PHONE",
    "DATE_TIME", "AGE", "USERNAME", "PASSWORD", "US_SOCIAL_SECURITY_NUMBER",
)
TIMESTAMP_WORDS = ("at", "time", "timestamp", "created", "updated", "date")
# Characters of a text from which it is read in pieces.
CHUNK_CHARS = 64 << 10

# Published sample numbers.
SSN_DUMMIES = ("078051120", "219099999", "123456789", "111111111")
ITIN_TESTS = ("987654320", "987654321", "987654322", "987654323", "987654324", "987654325", "987654326", "987654327", "987654328", "987654329")
CARD_TESTS = (
    "4111111111111111", "4012888888881881", "4222222222222", "4242424242424242", "4000056655665556", "4000000000000002", "4000000000009995",
    "5555555555554444", "5105105105105100", "5200828282828210", "2223003122003222", "2223000048400011", "378282246310005", "371449635398431",
    "378734493671000", "6011111111111117", "6011000990139424", "6011981111111113", "3530111333300000", "3566002020360505", "30569309025904",
    "38520000023237", "36227206271667", "6200000000000005", "6759649826438453",
)
CARD_TEST_DISTINCT = 2


@dataclass(frozen=True)
class Brand:
    name: str
    prefixes: tuple[str, ...]
    lengths: tuple[int, ...]


# Issuer ranges.  The first range that fits decides, and then the length must fit.
BRANDS = (
    Brand("discover", ("622126-622925",), (16, 17, 18, 19)),
    Brand("maestro", ("5018", "5020", "5038", "5893", "6304", "6759", "6761-6763"), (13, 14, 15, 16, 17, 18, 19)),
    Brand("mir", ("2200-2204",), (16, 17, 18, 19)),
    Brand("visa", ("4",), (13, 16, 19)),
    Brand("mastercard", ("51-55", "2221-2720"), (16,)),
    Brand("amex", ("34", "37"), (15,)),
    Brand("discover", ("6011", "644-649", "65"), (16, 17, 18, 19)),
    Brand("jcb", ("3528-3589",), (16, 17, 18, 19)),
    Brand("diners", ("300-305", "36", "38-39"), (14, 15, 16, 17, 18, 19)),
    Brand("unionpay", ("62",), (16, 17, 18, 19)),
)

# Months, number words and fillers of spoken text.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
ZERO_WORDS = ("oh", "o")
MULTIPLIERS = {"double": 2, "triple": 3}
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11,
    "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30,
}
FILLERS = ("uh", "um", "umm", "er", "erm", "ah", "hmm", "mm")



def any_word(words) -> str:
    """A pattern of any of some words, longer ones first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


# How dates, numbers and what lies between their digits are said in a turn (patterns of the ``re`` syntax, ASCII).
_W, _NEXT = r"[ \t\r\n]+", r"(?:-|[ \t\r\n]+)"
_UNIT, _TEEN, _TEN = any_word(w for w in NUMBER_WORDS if w != "zero"), any_word(TEENS), any_word(TENS)
_TENS_OF_DAYS = "(?:twenty|thirty)"
_MONTHS = "(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + r"|sept)\.?"
_DAY = f"(?:{_TENS_OF_DAYS}{_NEXT}(?:{any_word(w for w, v in ORDINALS.items() if v < 10)}|{_UNIT})|{any_word(ORDINALS)}|{_TEEN}|{_UNIT}|{_TENS_OF_DAYS}|[0-9]{{1,2}}(?:st|nd|rd|th)?)"
_BELOW_100 = f"{_TEEN}|{_TEN}(?:{_NEXT}{_UNIT})?"
_YEAR = f"(?:[0-9]{{4}}|(?:nineteen|twenty){_NEXT}(?:{_BELOW_100}|(?:oh|o){_NEXT}{_UNIT}|hundred)|two{_W}thousand(?:(?:{_W}and)?{_W}(?:{_BELOW_100}|{_UNIT}))?)"
DATE_SAID = rf"\b(?:(?P<m1>{_MONTHS}),?{_W}(?:the{_W})?(?P<d1>{_DAY}),?{_W}(?P<y1>{_YEAR})|(?:the{_W})?(?P<d2>{_DAY}){_W}(?:of{_W})?(?P<m2>{_MONTHS}),?{_W}(?P<y2>{_YEAR}))\b"
_DIGIT, _TIMES = any_word([*NUMBER_WORDS, *ZERO_WORDS]), any_word(MULTIPLIERS)
DIGIT_SAID = rf"(?<![A-Za-z])(?:(?P<times>{_TIMES})(?![A-Za-z])(?:[ \t\r\n]*(?:(?P<word>{_DIGIT})(?![A-Za-z])|(?P<one>(?<![0-9])[0-9])(?![0-9])))|(?P<digit>{_DIGIT})(?![A-Za-z]))"
MORE_DIGITS = rf"[ \t\r\n]*(?:[0-9]|(?:{_DIGIT}|{_TIMES})(?![A-Za-z]))"
FILLER_SAID = rf"(?<![A-Za-z]){any_word(FILLERS)}(?![A-Za-z])"
DATE_IN_DIGITS = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2}))(?![0-9])"
KEYPAD_END = "(?<=[0-9])[#*]+(?![A-Za-z0-9#*])|(?<=[0-9])[#*]+(?=[#*])"

# What is masked in names and cells, and what makes a match a slice of a longer run of digits.
CARD_MASKED = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
NINE_MASKED = (
    (r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", "###-##-####"),
    (r"(?<![0-9])[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9])", "### ## ####"),
    (r"(?<![0-9])[0-9]{9}(?![0-9])", "#########"),
)
RUN_BEFORE, RUN_BEHIND = "[0-9][ -]?$", "^[ -]?[0-9]{4}"

# Characters of context before and after a stored value.
WINDOW_BEFORE, WINDOW_AFTER = 64, 32
# Limits of a findings document.
MAX_OFFSETS, MAX_FINDINGS = 50, 5000
