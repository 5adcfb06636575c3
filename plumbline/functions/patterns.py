"""Regular expressions for well-known kinds of text, with find semantics."""

EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
URL = r"(?:https?|ftp)://[^\s/$.?#][^\s]*"
#: Area not 000, 666 or 9xx, group not 00, serial not 0000; separators may be missing.
SSN = r"(?<!\d)(?!000|666|9\d\d)\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}(?!\d)"
#: Card numbers by issuer range and length, in groups or not.
CREDITCARD = (r"(?<!\d)(?:4\d{3}(?:[- ]?\d{4}){3}|5[1-5]\d{2}(?:[- ]?\d{4}){3}|6(?:011|5\d{2})(?:[- ]?\d{4}){3}"
              r"|3[47]\d{2}[- ]?\d{6}[- ]?\d{5}|3(?:0[0-5]|[68]\d)\d[- ]?\d{6}[- ]?\d{4}|(?:2131|1800|35\d{3})\d{11})(?!\d)")


def is_one(value: float) -> bool:
    return value == 1
