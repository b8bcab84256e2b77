"""Lines, offsets and character statistics of texts. Offsets count code points unless said otherwise."""

from __future__ import annotations

from . import sql as F
from .sql import Expr

from .core import let

#: Control characters that no text has; NUL, backspace, tabs, feeds and escape are allowed.
NON_TEXT = r"[\x01-\x07\x0E-\x1A\x1C-\x1F]"


def normalize_newlines(text: Expr) -> Expr:
    """Line ends as \\n, without the last one."""
    newlines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(newlines, "\n\\z", "")


def lines(content: Expr) -> Expr:
    """The lines of normalized content; empty content has none."""
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(content, "\n", -1))


def line_starts(content: Expr) -> Expr:
    """Offset at which each line starts."""
    zero = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    return F.aggregate(lines(content), F.struct(F.lit(0).alias("at"), zero.alias("starts")), step, lambda acc: acc["starts"])


def line_number(content: Expr, offset: Expr) -> Expr:
    """Line of an offset, from 1."""
    left = lambda: F.substring(content, F.lit(1), offset)
    return F.length(left()) - F.length(F.replace(left(), F.lit("\n"), F.lit(""))) + 1


def line_column(content: Expr, offset: Expr) -> Expr:
    """Expr of an offset in its line, from 0."""
    return offset - (F.length(F.substring(content, F.lit(1), offset)) - F.length(F.substring_index(F.substring(content, F.lit(1), offset), "\n", -1)))


def line_at(content: Expr, offset: Expr) -> Expr:
    """The whole line in which an offset lies."""
    before = F.substring_index(F.substring(content, F.lit(1), offset), "\n", -1)
    after = F.substring_index(F.substring(content, offset + 1, F.length(content)), "\n", 1)
    return F.concat(before, after)


def text_range(content: Expr, start: Expr, end: Expr) -> Expr:
    """Lines (from 1) and columns (from 0) of a span; null if it isn't within the content."""
    span = F.struct(
        line_number(content, start).alias("start_line"),
        line_column(content, start).alias("start_col"),
        line_number(content, end).alias("end_line"),
        line_column(content, end).alias("end_col"),
    )
    return F.when((start >= 0) & (start < end) & (end <= F.length(content)), span)


def has_non_text(content: Expr) -> Expr:
    return content.rlike(NON_TEXT)


def utf16_length(text: Expr) -> Expr:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_offset(content: Expr, offset: Expr) -> Expr:
    return utf16_length(F.substring(content, F.lit(1), offset))


def entropy(text: Expr) -> Expr:
    """Shannon entropy in bits a character; 0 for an empty text."""
    share = lambda x: lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / F.length(x)
    bits = lambda x: F.aggregate(F.transform(F.array_distinct(F.split(x, "")), share(x)), F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))
    return let(text, lambda x: F.when(F.length(x) == 0, F.lit(0.0)).otherwise(bits(x)))


#: What alphabets other than the standard one write for + / =.
ALPHABETS = {"default": ("-_", "+/"), "y64": ("._-", "+/=")}
_STRICT = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}(?:==)?|[A-Za-z0-9+/]{3}=?)?$"


def decode_base64(text: Expr, alphabet: str = "default") -> Expr:
    """Text of strict base64, null if it is none: no white space, padding right or left out. Bytes
    that are no UTF-8 become U+FFFD."""
    source, target = ALPHABETS[alphabet]
    standard = F.translate(text, source, target)
    bare = F.regexp_replace(standard, "=+$", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    return F.when(standard.rlike(_STRICT), F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))
