"""Entity identifiers written as Python bytes literals."""

from pyspark.sql import Column, functions as F

# One-letter escapes of a bytes literal and the byte they denote.
ESCAPES = {
    "\\n": "0a", "\\r": "0d", "\\t": "09", "\\\\": "5c", "\\'": "27",
    '\\"': "22", "\\a": "07", "\\b": "08", "\\f": "0c", "\\v": "0b",
}

_ESCAPED = r"\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|\\[nrtabfv\\'\"]"
_TOKEN = f"({_ESCAPED}|[^\\\\])"
# Printable ASCII without the backslash and without the closing quote.
_SINGLE_PLAIN = r"[\x20-\x26\x28-\x5b\x5d-\x7e]"
_DOUBLE_PLAIN = r"[\x20\x21\x23-\x5b\x5d-\x7e]"


def _well_formed(value: Column, quote: str, plain: str) -> Column:
    body = F.substring(value, F.lit(3), F.length(value) - 3)
    leftover = F.regexp_replace(body, f"{_ESCAPED}|{plain}", "")
    return (value.startswith("b" + quote) & value.endswith(quote)
            & (F.length(value) >= 3) & (leftover == ""))


def _token_hex(token: Column) -> Column:
    letters = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])
    octal = F.lpad(F.lower(F.conv(F.substring(token, 2, 3), 8, 16)), 2, "0")
    return (
        F.when(~token.startswith("\\"), F.lower(F.hex(token)))
        .when(token.startswith("\\x"), F.lower(F.substring(token, 3, 2)))
        .when(token.rlike("^\\\\[0-7]"), octal)
        .otherwise(F.element_at(letters, token)))


def clean_id(value, double_quoted: bool = True) -> Column:
    """Bytes literal to lower-case hex; any other text is kept as it is.

    ``double_quoted=False`` leaves ``b"..."`` ids undecoded. Malformed literals
    stay unchanged. Null stays null.
    """
    value = F.col(value) if isinstance(value, str) else value
    well_formed = _well_formed(value, "'", _SINGLE_PLAIN)
    if double_quoted:
        well_formed = well_formed | _well_formed(value, '"', _DOUBLE_PLAIN)
    body = F.substring(value, F.lit(3), F.length(value) - 3)
    tokens = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(1))
    decoded = F.when(
        well_formed, F.array_join(F.transform(tokens, _token_hex), "")).otherwise(value)
    # The outer test keeps plain ids away from the text functions altogether.
    return F.when(value.startswith("b"), decoded).otherwise(value)


def clean_object_id(value, double_quoted: bool = True) -> Column:
    """As ``clean_id``, with an empty id read as no object."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~value.isin("", "b''", 'b""'), clean_id(value, double_quoted))


def bytes_literal(hex_id) -> Column:
    """Hex id to a bytes literal with every byte escaped."""
    hex_id = F.col(hex_id) if isinstance(hex_id, str) else hex_id
    escaped = F.regexp_replace(hex_id, "([0-9a-f]{2})", r"\\x$1")
    return F.concat(F.lit("b'"), escaped, F.lit("'"))


def short_id(value, length: int = 20) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.substring(value, 1, length), F.lit("..."))
