"""Rules compiled to columns, and scans of tables of files with them.

A scan is one pass without a shuffle: a search for all rules' keywords lets few texts through; each
rule that accepts a file finds its candidates as an array; overlapping candidates are resolved within the
row; only then do rows multiply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from ..functions import sql as F
from ..functions.core import let
from ..functions.regex import find_if_any
from ..functions.sql import Expr, column
from ..functions.text import text_range
from ..operators import context, files, hidden, post, resolve
from ..spec.model import Rule

CANDIDATE = "struct<rule_id:string,rule_key:string,priority:int,start:int,end:int,text:string,message:string,skipped:array<string>>"
REPOSITORY = "secrets"


@dataclass(frozen=True)
class ScanConfig:
    """How a scan behaves; the defaults are those of a plain run."""

    auto_test_detection: bool = True
    skipped_filters: tuple[str, ...] = ()
    message: Callable[[Rule], str] = lambda rule: rule.message
    excluded_suffixes: tuple[str, ...] = ()
    log_rejections: int = 10


def located(rule: Rule, content: Expr) -> Expr:
    """Matches of a rule that have a place and are in the context the rule wants."""
    found = find_if_any(content, rule.pattern, [g for g, _ in rule.post.groups])
    return context.filtered(F.filter(found, lambda c: c["start"] >= 0), rule.context, content)


def candidates(rule: Rule, content: Expr, config: ScanConfig, tests: Expr) -> Expr:
    """What a rule finds in a text, as candidates for resolution."""
    skipped = config.skipped_filters
    kept = F.filter(located(rule, content), lambda c: post.passes(c["text"], rule.post, skipped, c))
    of_file = F.when(tests, F.array(F.lit("TEST_FILES_FILTER"))).otherwise(F.array().cast("array<string>"))

    def shape(c: Expr) -> Expr:
        tags = post.in_order(F.array_union(of_file, post.marks(c["text"], rule.post, skipped, c)))
        return F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.lit(rule.key).alias("rule_key"),
            F.lit(rule.priority).alias("priority"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["text"].alias("text"),
            let(tags, lambda t: post.with_suffix(F.lit(config.message(rule)), t)).alias("message"),
            tags.alias("skipped"),
        )

    return F.transform(kept, shape)


def _with_marks(table: DataFrame, config: ScanConfig) -> DataFrame:
    """Files with lowered content and whether they are tests by name."""
    tests = files.looks_like_test(F.col("path")) if config.auto_test_detection else F.lit(False)
    return table.withColumns({"lowered": S.lower("content"), "is_test": column(F.coalesce(tests, F.lit(False)))})


def _in_scope(config: ScanConfig) -> Expr:
    """Whether rules look at a file: not at tests, unless these are only marked, nor at excluded suffixes."""
    ok = F.lit(True)
    if config.auto_test_detection and "TEST_FILES_FILTER" not in config.skipped_filters:
        ok = ok & ~F.col("is_test")
    if config.excluded_suffixes:
        ok = ok & ~files.suffix_excluded(F.col("path"), list(config.excluded_suffixes))
    return ok


def _gate(rules: list[Rule]) -> Expr:
    return files.is_main(F.col("file_type")) & (F.length("content") > 0) & files.keyword_gate(rules, *map(F.col, ("path", "filename", "language", "file_type", "lowered")))


def _scoped(table: DataFrame, config: ScanConfig) -> DataFrame:
    return _with_marks(table, config).where(column(_in_scope(config)))


def _gated(table: DataFrame, rules: list[Rule]) -> DataFrame:
    return table.where(column(_gate(rules)))


def _accepts(rule: Rule) -> Expr:
    return files.accepts(rule, *map(F.col, ("path", "filename", "language", "file_type", "lowered")))


def _all_candidates(rules: list[Rule], config: ScanConfig) -> Expr:
    none = F.array().cast(f"array<{CANDIDATE}>")
    return F.flatten(F.array(*(F.when(_accepts(r), candidates(r, F.col("content"), config, F.col("is_test"))).otherwise(none) for r in rules)))


def candidate_arrays(table: DataFrame, rules: list[Rule], config: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, path, content, candidates) of the files that a rule's keyword lets through."""
    return _gated(_scoped(table, config), rules).select("doc_id", "path", "content", column(_all_candidates(rules, config).alias("candidates")))


def candidate_rows(table: DataFrame, rules: list[Rule], config: ScanConfig = ScanConfig(), then: Callable[[Expr], Expr] = lambda found: found) -> DataFrame:
    """(doc_id, c) for each candidate of the files, or for each element of what then() makes of a file's candidates.

    Rows come from the expression itself, with the gate inside it: of an array that is a column the optimizer computes
    each field wanted anew, and of a filter on content the content."""
    wanted = _in_scope(config) & _gate(rules)
    found = F.when(wanted, _all_candidates(rules, config)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))
    return _with_marks(table, config).select("doc_id", S.explode(column(then(found))).alias("c"))


def _issues_of_rules(found: Expr) -> Expr:
    """The winners among candidates, with their places."""

    def issue(c: Expr) -> Expr:
        return let(text_range(F.col("content"), c["start"], c["end"]), lambda r: F.struct(
            F.lit(REPOSITORY).alias("repo"), c["rule_key"].alias("rule_key"), c["rule_id"].alias("rule_id"),
            *(r[k].alias(k) for k in ("start_line", "start_col", "end_line", "end_col")), c["message"].alias("message"), F.md5(c["text"]).alias("secret_md5"),
        ))

    return F.transform(resolve.resolved(found, CANDIDATE), issue)


def secrets(table: DataFrame, rules: list[Rule], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of rules, one for each group of overlapping candidates."""
    found = _issues_of_rules(_all_candidates(rules, config))
    return _gated(_scoped(table, config), rules).select("doc_id", "path", S.explode(column(found)).alias("x")).select("doc_id", "path", "x.*")


def issues(table: DataFrame, rules: list[Rule], config: ScanConfig = ScanConfig()) -> DataFrame:
    """All findings, in one pass: those of rules, and hidden text, which files that rules don't look at are
    checked for too."""
    null = lambda kind: F.lit(None).cast(kind)
    none = F.array().cast("array<struct<repo:string,rule_key:string,rule_id:string,start_line:int,start_col:int,end_line:int,end_col:int,message:string,secret_md5:string>>")

    def text_issue(f: Expr) -> Expr:
        return F.struct(
            F.lit(hidden.REPOSITORY).alias("repo"), f["rule_key"].alias("rule_key"), null("string").alias("rule_id"), f["line"].alias("start_line"),
            *(null("int").alias(k) for k in ("start_col", "end_line", "end_col")), f["message"].alias("message"), null("string").alias("secret_md5"),
        )

    wanted = _in_scope(config) & _gate(rules)
    found = F.concat(F.when(wanted, _issues_of_rules(_all_candidates(rules, config))).otherwise(none), F.transform(hidden.findings(F.col("path"), F.col("content")), text_issue))
    return _with_marks(table, config).select("doc_id", S.explode(column(found)).alias("x")).select("doc_id", "x.*").drop("secret_md5")


def described(found: DataFrame) -> DataFrame:
    """Findings as one text each: repo:key [line:col-line:col] message."""
    place = S.when(S.col("end_line").isNotNull(), S.format_string("%d:%d-%d:%d", "start_line", "start_col", "end_line", "end_col")).otherwise(S.coalesce(S.col("start_line").cast("string"), S.lit("")))
    return found.select("doc_id", S.concat("repo", S.lit(":"), "rule_key", S.lit(" ["), place, S.lit("] "), "message").alias("issue"))


def rejections(table: DataFrame, rules: list[Rule], config: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, rule_id, start, reason) of candidates that filters reject: the first of each rule and file, and
    a row without place that counts the others."""
    kind = "array<struct<rule_id:string,start:int,reason:string>>"
    most = config.log_rejections

    def of(r: Rule) -> Expr:
        judged = F.transform(located(r, F.col("content")), lambda c: F.struct(F.lit(r.id).alias("rule_id"), c["start"].alias("start"), post.reason(c["text"], r.post, config.skipped_filters, c).alias("reason")))

        def capped(lost: Expr) -> Expr:
            more = F.struct(F.lit(r.id).alias("rule_id"), F.lit(None).cast("int").alias("start"), F.format_string("%d more suppressed", F.size(lost) - most).alias("reason"))
            return F.when(F.size(lost) > most, F.concat(F.slice(lost, 1, most), F.array(more))).otherwise(lost)

        return F.when(_accepts(r), let(F.filter(judged, lambda x: x["reason"].isNotNull()), capped)).otherwise(F.array().cast(kind))

    return _gated(_scoped(table, config), rules).select("doc_id", S.explode(column(F.flatten(F.array(*map(of, rules))))).alias("x")).select("doc_id", "x.rule_id", "x.start", "x.reason")


def errors(table: DataFrame, rules: list[Rule], config: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, path, message) of files in which a match has no place, as its group took no part."""
    lost = [F.when(_accepts(r), F.exists(find_if_any(F.col("content"), r.pattern), lambda m: m["start"] < 0)).otherwise(False) for r in rules]
    failed = F.exists(F.array(*lost), lambda x: x)
    return _gated(_scoped(table, config), rules).where(column(failed)).select("doc_id", "path", S.concat(S.lit("Unable to analyze file "), "path", S.lit(": a match has no place")).alias("message"))
