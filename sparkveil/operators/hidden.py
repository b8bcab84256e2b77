"""Text that a reader doesn't see: unclosed bidirectional controls, tag characters, variation selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from ..functions import sql as F
from ..functions.core import let
from ..functions.regex import find_if_any
from ..functions.sql import Expr, column
from ..functions.text import lines, utf16_offset
from .files import translation_file

REPOSITORY = "text"
BIDI, TAGS, SELECTORS = "S6389", "S7628", "S8522"
CHECKS = {BIDI: "Bidirectional characters must be closed", TAGS: "Tag characters must not hide text", SELECTORS: "Variation selectors must not hide text"}

_EMBED, _ISOLATE = "\u202a\u202b\u202d\u202e", "\u2066\u2067\u2068"
_GATE = "[\\u202A\\u202B\\u202D\\u202E\\u2066\\u2067\\u2068]"
_TAG = r"[\x{E0020}-\x{E007F}]"
_FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]*\x{E007F}?"
_SELECTOR = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"


def unclosed(line: Expr) -> Expr:
    """Expr, from 1 and in UTF-16 units, of the control to report, null if all are closed.

    Embeddings and overrides end with U+202C, isolates with U+2069; each closes the latest of its own kind,
    or nothing. If both kinds are left open, the earlier of the latest of each is meant.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("i"), none.alias("embed"), none.alias("isolate"))

    def step(acc: Expr, x: Expr) -> Expr:
        def stack(name: str, openers: str, closer: str) -> Expr:
            s = acc[name]
            popped = F.when(F.size(s) > 0, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
            return F.when(F.contains(F.lit(openers), x), F.concat(s, F.array(acc["i"]))).when(x == closer, popped).otherwise(s).alias(name)

        return F.struct((acc["i"] + 1).alias("i"), stack("embed", _EMBED, "\u202c"), stack("isolate", _ISOLATE, "\u2069"))

    last = lambda s: F.get(s, F.size(s) - 1)
    at = F.aggregate(F.split(line, ""), start, step, lambda acc: F.least(last(acc["embed"]), last(acc["isolate"])))
    return F.when(line.rlike(_GATE), utf16_offset(line, at) + 1)


FINDING = "struct<rule_key:string,line:int,col:int,message:string>"


def _finding(key: str, line: Expr, col: Expr, message: Expr) -> Expr:
    return F.struct(F.lit(key).alias("rule_key"), line.alias("line"), col.cast("int").alias("col"), message.alias("message"))


def _none() -> Expr:
    return F.array().cast(f"array<{FINDING}>")


def bidi(line: Expr, number: Expr) -> Expr:
    """Findings of unclosed controls in a line: one or none."""
    message = lambda at: F.format_string("Close the bidirectional character opened at column %d of this line, or remove it.", at)
    found = let(unclosed(line), lambda at: F.when(at.isNotNull(), F.array(_finding(BIDI, number, at, message(at)))).otherwise(_none()))
    return F.when(line.rlike(_GATE), found).otherwise(_none())


def runs(line: Expr, chars: str, least: int, skip: str | None = None) -> Expr:
    """Runs of at least so many characters of a class in a line, as matches. Their places count code points;
    what the skip pattern matches counts as one and breaks runs."""
    return find_if_any(F.regexp_replace(line, skip, "\u2691") if skip else line, f"{chars}{{{least},}}")


def tag_text(run: Expr) -> Expr:
    """The ASCII text that tag characters spell."""
    return F.translate(run, "".join(chr(0xE0000 + c) for c in range(0x20, 0x80)), "".join(map(chr, range(0x20, 0x80))))


def tags(line: Expr, number: Expr) -> Expr:
    def one(m: Expr) -> Expr:
        return _finding(TAGS, number, m["start"] + 1, F.format_string('Tag characters from column %d on spell "%s"; remove them.', m["start"] + 1, tag_text(m["text"])))

    return F.transform(F.filter(runs(line, _TAG, 2, _FLAG), lambda m: F.trim(tag_text(m["text"])) != ""), one)


def selectors(line: Expr, number: Expr) -> Expr:
    def one(m: Expr) -> Expr:
        text = "There are %d variation selectors in a row from column %d on; remove them unless they are meant."
        return _finding(SELECTORS, number, m["start"] + 1, F.format_string(text, F.length(m["text"]), m["start"] + 1))

    return F.transform(runs(line, _SELECTOR, 4), one)


#: Any of them. The range that holds them all comes first, so that most characters of a text cost one comparison.
_ANY = r"[\x{202A}-\x{10FFFF}&&" + _GATE[:-1] + _TAG[1:-1] + _SELECTOR[1:] + "]"


def findings(path: Expr, content: Expr) -> Expr:
    """All findings of a text as one array. A text without any of the characters costs one search."""

    def of(line: Expr, i: Expr) -> Expr:
        number = i + 1
        found = F.concat(F.when(exempt, _none()).otherwise(bidi(line, number)), tags(line, number), selectors(line, number))
        return F.when(line.rlike(_ANY), found).otherwise(_none())

    exempt = F.coalesce(translation_file(path), F.lit(False))
    return F.when(content.rlike(_ANY), F.flatten(F.transform(lines(content), of))).otherwise(_none())


def hidden_text(files: DataFrame) -> DataFrame:
    """(doc_id, rule_key, line, col, message) of all checks; these findings are never resolved against others."""
    return files.select("doc_id", S.explode(column(findings(F.col("path"), F.col("content")))).alias("f")).select("doc_id", "f.*")
