"""Text of any bytes: what is well-formed UTF-8 in a binary column, as expressions.

A byte that belongs to no well-formed sequence counts as one character. Overlong forms, surrogates, numbers above U+10FFFF
and sequences that are cut off are not well-formed. Bytes are looked at as Latin-1 characters, so
that patterns can name them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LATIN = "ISO-8859-1"
#: A well-formed sequence.
SEQUENCE = (
    r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def _latin(b: Column) -> Column:
    return F.decode(b, _LATIN)


def characters(b: Column) -> Column:
    """The bytes of each character, and of each stray byte, as Latin-1 strings in order."""
    return F.regexp_extract_all(_latin(b), F.lit(f"{SEQUENCE}|[\\x80-\\xff]"), F.lit(0))


def is_valid(b: Column) -> Column:
    return F.is_valid_utf8(b.cast("string"))


def count(b: Column) -> Column:
    return F.size(characters(b))


def _stray(c: Column) -> Column:
    return (F.length(c) == 1) & (c >= "\x80")


def text(b: Column) -> Column:
    """The string, in which a stray byte is the character of its number, U+0080 to U+00FF."""
    lenient = F.array_join(F.transform(characters(b), lambda c: F.when(_stray(c), c).otherwise(F.decode(F.encode(c, _LATIN), "UTF-8"))), "")
    return F.when(is_valid(b), F.decode(b, "UTF-8")).otherwise(lenient)


def snap(b: Column, at: Column) -> Column:
    """The byte offset at, or the one before it at which a character can begin; at most the length."""
    n = F.octet_length(b)
    upto = F.regexp_replace(F.substring(_latin(b), F.lit(1), at + 1), r"[\x80-\xbf]+\z", "")
    return F.when(at >= n, n).otherwise(F.greatest(F.lit(0), F.length(upto) - 1))


_NAMED = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(b: Column) -> Column:
    """The bytes as a JSON string: control characters and stray bytes as \\u00xx, all else as it stands."""
    number = lambda c: F.concat(F.lit("\\u00"), F.lower(F.hex(F.encode(c, _LATIN))))

    def one(c: Column) -> Column:
        out = F.when(_stray(c) | (c < " ") | (c == "\x7f"), number(c))
        for plain, said in reversed(_NAMED.items()):
            out = F.when(c == plain, said).otherwise(out)
        return F.coalesce(out, F.decode(F.encode(c, _LATIN), "UTF-8"))

    return F.concat(F.lit('"'), F.array_join(F.transform(characters(b), one), ""), F.lit('"'))
