"""Every operator as a query over whole tables, and DuckDB's SQL for those that SQL can express.

Queries work on the table of files of ``inputs``: all documents, with planted lines. The SQL is written from
the operators' definitions, not from their expressions: matches are rows, conditions are semi-joins, folds
are recursive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as S

from ..functions import sql as F
from ..functions import text
from ..functions.glob import path_matches
from ..functions.regex import find_if_any
from ..functions.sql import Expr, col, column
from ..operators import context, files, git, hidden, post, resolve, telemetry
from ..spec.load import load, parse
from ..spec.model import Aux, Combined, Decoded, FileFilter, Post, Rule
from ..streaming import scan as streaming
from . import inputs, scan
from .examples import outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql:
            ORACLE[key] = sql
        return query

    return add


def _with(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ", ".join([inputs.FILES, *parts]) + " " + then


# ---- DuckDB's side -------------------------------------------------------------------------------------

TOKEN = r'token = "([0-9A-Za-z/+=:.-]{20,80})"'
USER = r"user: ([a-z]+)"
HOST = r"host: (h[0-9])"
_SPLIT = "list_sum(list_transform({0}, lambda x: length(x)))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_matches(name: str, pattern: str, source: str = "files", group: int = 1) -> str:
    """CTEs of which the last, so named, has a row (doc_id, content, text, s, e) for each match."""
    p = _quoted(pattern)
    return f"""{name}_a AS (SELECT doc_id, content, regexp_extract_all(content, {p}, 0) AS ws, regexp_extract_all(content, {p}, {group}) AS gs, regexp_split_to_array(content, {p}) AS ps FROM {source}),
{name}_k AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM {name}_a),
{name}_w AS (SELECT doc_id, content, gs[k] AS text, ws[k] AS whole, {_SPLIT.format("ps[1:k]")} + coalesce({_SPLIT.format("ws[1:k-1]")}, 0) AS lead FROM {name}_k),
{name} AS (SELECT doc_id, content, text, CAST(lead + strpos(whole, text) - 1 AS BIGINT) AS s, CAST(lead + strpos(whole, text) - 1 + length(text) AS BIGINT) AS e FROM {name}_w)"""


def _line(at: str, content: str = "content") -> str:
    left = f"substr({content}, 1, {at})"
    return f"(length({left}) - length(replace({left}, chr(10), '')) + 1)"


def _col(at: str, content: str = "content") -> str:
    return f"length(list_last(string_split(substr({content}, 1, {at}), chr(10))))"


_RANGE = f"CAST({_line('s')} AS INTEGER) AS start_line, CAST({_col('s')} AS INTEGER) AS start_col, CAST({_line('e')} AS INTEGER) AS end_line, CAST({_col('e')} AS INTEGER) AS end_col"


def sql_entropy(x: str) -> str:
    share = f"((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE)"
    return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -{share} * log2({share}))) END"


def sql_context(c: Aux | Combined, lists: dict[Aux, str]) -> str:
    """A condition on the candidate k in SQL; lists names the CTE of each auxiliary pattern."""
    if isinstance(c, Combined):
        parts = [sql_context(p, lists) for p in c.parts]
        return f"(NOT {parts[0]})" if c.kind == "not" else "(" + (" AND " if c.kind == "each" else " OR ").join(parts) + ")"
    near = {"before": "a.e <= k.s", "after": "a.s >= k.e", "around": "(a.e <= k.s OR a.s >= k.e)"}[c.side]
    band = lambda p, d: f"((a.{p}e >= k.{p}s AND a.{p}s <= k.{p}e) OR least(abs(a.{p}e - k.{p}s), abs(a.{p}s - k.{p}e)) <= {d})"
    if c.max_chars is not None:
        near += " AND " + band("", c.max_chars)
    if c.max_lines is not None:
        near += " AND " + band("l", c.max_lines)
    found = f"EXISTS (SELECT 1 FROM {lists[c]} a WHERE a.doc_id = k.doc_id AND {near})"
    return f"(k.width < {c.max_line_length} AND {found})" if c.max_lines is not None else found


def _lined(name: str, source: str) -> str:
    width = f"{_col('s')} + length(string_split(substr(content, s + 1), chr(10))[1])"
    return f"{name} AS (SELECT *, {_line('s')} AS ls, {_line('e')} AS le, {width} AS width FROM {source})"


_HIDDEN_CLASSES = {"lines": r"[\x{202A}\x{202B}\x{202D}\x{202E}\x{2066}-\x{2068}\x{E0020}-\x{E007F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"}
#: Lines with hidden characters, numbered.
_LINES = f"all_lines AS (SELECT doc_id, path, string_split(content, chr(10)) AS ls FROM files WHERE regexp_matches(content, '{_HIDDEN_CLASSES['lines']}')), numbered AS (SELECT doc_id, path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM all_lines), lines AS (SELECT * FROM numbered WHERE regexp_matches(line, '{_HIDDEN_CLASSES['lines']}'))"
_EXEMPT = r"regexp_matches(path, 'res/values-[a-zA-Z-]+/strings\.xml$')"


def _unclosed_sql(openers: str, closer: str) -> str:
    """Place of the last opener that isn't closed: from it on, closers never outnumber openers."""
    count = lambda chars: f"(length(substr(line, i, j - i + 1)) - length(regexp_replace(substr(line, i, j - i + 1), '[{chars}]', '', 'g')))"
    open_ = f"regexp_matches(substr(line, i, 1), '[{openers}]')"
    return f"list_max(list_filter(range(1, length(line) + 1), lambda i: {open_} AND list_min(list_transform(range(i, length(line) + 1), lambda j: {count(openers)} - {count(closer)})) >= 1))"


_BIDI_SQL = rf"""{_LINES}, opened AS (SELECT *, least({_unclosed_sql(r'\x{202A}\x{202B}\x{202D}\x{202E}', r'\x{202C}')}, {_unclosed_sql(r'\x{2066}-\x{2068}', r'\x{2069}')}) AS i
FROM lines WHERE NOT {_EXEMPT} AND regexp_matches(line, '[\x{{202A}}\x{{202B}}\x{{202D}}\x{{202E}}\x{{2066}}-\x{{2068}}]')),
bidi AS (SELECT doc_id, 'S6389' AS rule_key, n AS line, i + length(regexp_replace(substr(line, 1, i - 1), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS col FROM opened WHERE i IS NOT NULL)"""


def _runs_sql(name: str, key: str, chars: str, least: int, skip: str | None = None) -> str:
    """Runs of characters of a class in lines; what skip matches counts as one character."""
    own = f"regexp_replace(line, '{skip}', chr(9873), 'g')" if skip else "line"
    return f"{name}_src AS (SELECT doc_id * 1000000 + n AS doc_id, {own} AS content FROM lines), {sql_matches(name + '_m', f'({chars}{{{least},}})', name + '_src')}, {name} AS (SELECT doc_id // 1000000 AS doc_id, '{key}' AS rule_key, doc_id % 1000000 AS line, s + 1 AS col, text FROM {name}_m)"


_TAG_CHARS, _FLAG = r"[\x{E0020}-\x{E007F}]", r"\x{1F3F4}[\x{E0020}-\x{E007E}]*\x{E007F}?"
_TAGS_SQL = _runs_sql("tags", hidden.TAGS, _TAG_CHARS, 2, _FLAG)
_SELECTORS_SQL = _runs_sql("selectors", hidden.SELECTORS, r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", 4)
_SPELT = "array_to_string(list_transform(string_split(text, ''), lambda c: chr(unicode(c) - 917504)), '')"

_TEST_SQL = r"""(NOT regexp_matches(lower(path), '^(/|\.\./|[a-z]:)') AND (regexp_matches(lower(filename), '^test|tests?\.|\.spec\.(jsx?|tsx?)$|_(spec|test)\.rb$|\.t$')
OR regexp_matches(lower(path), '(^|/)(docs?|tests?|e2e|mocks?|__tests__|__fixtures__|testdata|fixtures|[^/]*tests?)/')))"""


# ---- Texts and lines ------------------------------------------------------------------------------------


@_register(_with(then="SELECT doc_id, path, filename, language, file_type, is_hidden, md5(content) AS content_md5, length(content) AS chars FROM files"))
def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they are scanned: line ends normalized, content that is no text emptied."""
    return inputs.files(spark, sf_dir).select("doc_id", "path", "filename", "language", "file_type", "is_hidden", S.md5("content").alias("content_md5"), S.length("content").alias("chars"))


@_register(_with(then="SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(list_transform(range(1, len(ls) + 1), lambda i: coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0)))::BIGINT AS start_at FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM files WHERE content <> '')"))
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset at which each line of each file starts."""
    starts = inputs.files(spark, sf_dir).select("doc_id", S.posexplode(column(text.line_starts(col("content")))).alias("i", "start_at"))
    return starts.select("doc_id", (S.col("i") + 1).alias("line"), "start_at")


@_register("WITH " + inputs.FILES + r" SELECT doc_id, regexp_matches(text, '[\x01-\x07\x0E-\x1A\x1C-\x1F]') AS is_binary FROM raw")
def binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text holds control characters that no text has."""
    return inputs.raw(spark, sf_dir).select("doc_id", column(text.has_non_text(col("text")).alias("is_binary")))


# ---- Predicates on files --------------------------------------------------------------------------------


def _flag(name: str, sql: str, flag: Callable[[], Expr | Column]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lowered = inputs.files(spark, sf_dir).withColumn("lowered", S.lower("content"))
        own = flag()
        return lowered.select("doc_id", S.coalesce(column(own) if isinstance(own, Expr) else own, S.lit(False)).alias("flag"))

    _register(_with(then=f"SELECT doc_id, coalesce({sql}, false) AS flag FROM files"), name)(query)


_P = [lambda c=c: col(c) for c in ("path", "filename", "lowered")]
_INCLUDE = FileFilter(paths=("src/**", "**/.github/**", "lib/*.py"), ext=(".py", "ts", "env", "json"), content=("USER: ann", "bob"))
_REJECT = FileFilter(paths=("docs/**", ""), ext=("png", ".tar.gz"), content=("user: zoe", " "))
_CONTENT = lambda words: "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"
_EXT = lambda exts: "(" + " OR ".join(f"ends_with(lower(filename), '.{e}')" for e in exts) + ")"
_flag("main_scope", "file_type = 'MAIN'", lambda: files.is_main(col("file_type")))
_flag("language_scope", "language IS NULL", lambda: files.in_language_scope("analyzerGeneric", col("language")))
_flag("include_filter", f"(path LIKE 'src/%' OR regexp_matches(path, '^(.*/)?\\.github/.*$') OR regexp_matches(path, '^lib/[^/]*\\.py$')) AND {_EXT(['py', 'ts', 'env', 'json'])} AND {_CONTENT(['user: ann', 'bob'])}", lambda: files.included(_INCLUDE, *(p() for p in _P)))
_flag("reject_any", f"path LIKE 'docs/%' OR {_EXT(['png', 'gz'])} OR {_CONTENT(['user: zoe'])}", lambda: files.rejected(_REJECT, *(p() for p in _P)))
_flag("glob_path", r"regexp_matches(path, '^(.*/)?values-[^/]/[^/]*\.xml$') OR regexp_matches(path, '^app/(.*/)?strings\.[^/][^/][^/]$') OR regexp_matches(path, '^[^/]*/f[0-9]\.py$')", lambda: path_matches(col("path"), "**/values-?/*.xml") | path_matches(col("path"), "app/**/strings.???") | path_matches(col("path"), "*/f?.py") & col("path").rlike("/f[0-9]"))
_flag("extension", _EXT(["env", "gz", "ts"]), lambda: files.has_extension(col("filename"), "ENV") | files.has_extension(col("filename"), ".tar.gz") | files.has_extension(col("filename"), "ts") | files.has_extension(col("filename"), " "))
_flag("content_keyword", "contains(lower(content), 'user: ann')", lambda: files.has_keyword(col("lowered"), "User: ANN") | files.has_keyword(col("lowered"), "  "))
_flag("test_file_heuristic", _TEST_SQL, lambda: files.looks_like_test(col("path")))
_flag("suffix_exclusion", "ends_with(path, '.png') OR ends_with(path, '.json')", lambda: files.suffix_excluded(col("path"), [".png", ".json"]))
_flag("binary_name", f"regexp_matches(filename, '\\.(png|gz)$') OR (length(filename) IN (32, 40, 64, 128) AND regexp_matches(filename, '^[0-9a-f]+$') AND {sql_entropy('filename')} > 3.1)", lambda: files.looks_binary(col("filename")))
_flag("translation_exempt", _EXEMPT, lambda: files.translation_file(col("path")))


@_register(_with(then="SELECT DISTINCT doc_id, rule_key FROM (SELECT doc_id, 'K1' AS rule_key FROM files WHERE contains(lower(content), 'bob') OR contains(lower(content), 'bobby') UNION ALL SELECT doc_id, 'K2' FROM files WHERE contains(lower(content), 'user: ann') UNION ALL SELECT doc_id, 'K3' FROM files)"))
def keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks a file's keywords call for; a check with a rule without keywords is always called."""
    return files.routes(inputs.files(spark, sf_dir), _rules_for_routes())


def _rules_for_routes() -> list[Rule]:
    from ..spec.model import Pre

    rule = lambda n, key, words: Rule(f"r{n}", key, "", "", "specific", "x", Pre(FileFilter(content=words)))
    return [rule(1, "K1", ("bob",)), rule(2, "K1", ("BOBBY",)), rule(3, "K2", ("User: Ann",)), rule(4, "K3", ("zoe",)), rule(5, "K3", ())]


_STATUS = "CASE WHEN doc_id % 6 = 0 THEN '?? ' WHEN doc_id % 6 = 1 THEN ' M ' WHEN doc_id % 6 = 2 THEN 'M  ' WHEN doc_id % 6 = 3 THEN 'MM ' WHEN doc_id % 6 = 4 THEN 'A  ' ELSE ' D ' END || path"


@_register(_with(then=f"SELECT DISTINCT substr(l, 4) AS path FROM (SELECT {_STATUS} AS l FROM files) WHERE substr(l, 1, 2) IN ('??', ' M', 'M ', 'MM')"))
def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of changed files from the lines of a status report."""
    return git.dirty_paths(inputs.files(spark, sf_dir).selectExpr(f"{_STATUS} AS line")).distinct()


@_register(_with(then=f"SELECT doc_id, path FROM files WHERE NOT contains('/' || path, '/.git/') AND path NOT IN (SELECT substr(l, 4) FROM (SELECT {_STATUS} AS l FROM files) WHERE substr(l, 1, 2) IN ('??', ' M', 'M ', 'MM'))"))
def git_tracked_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without changes that aren't committed."""
    table = inputs.files(spark, sf_dir).select("doc_id", "path")
    return files.tracked(table, git.dirty_paths(table.selectExpr(f"{_STATUS} AS line")))


_URI = "CASE WHEN doc_id % 4 = 0 THEN 'https://host/org' || doc_id || '/p' || doc_id || '.git' WHEN doc_id % 4 = 1 THEN 'git@host:o' || doc_id || '/a.b.git' WHEN doc_id % 4 = 2 THEN 'local' ELSE '' END"


@_register(f"SELECT doc_id, ok, CASE WHEN ok THEN o END AS organization, CASE WHEN ok THEN p END AS project FROM (SELECT *, coalesce(length(p) > 0 AND length(o) > 0, false) AS ok FROM (SELECT doc_id, regexp_replace(x[-1], '\\.[^.]*$', '') AS p, CASE WHEN len(x) > 1 THEN x[-2] END AS o FROM (SELECT doc_id, regexp_split_to_array({_URI}, '[/:]') AS x FROM documents)))")
def remote_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organization and project of a remote's address."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", git.remote_of(S.expr(_URI)).alias("r")).select("doc_id", "r.*")


# ---- Matches --------------------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, pattern: str, names: list[str] | None = None) -> DataFrame:
    return inputs.files(spark, sf_dir).select("doc_id", "content", S.explode(column(find_if_any(col("content"), pattern, names))).alias("m"))


@_register(_with(sql_matches("m", TOKEN), then="SELECT doc_id, s AS start_at, e AS end_at, md5(text) AS text_md5 FROM m"))
def regex_find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a pattern with the place of group 1."""
    return _found(spark, sf_dir, TOKEN).select("doc_id", S.col("m.start").cast("long").alias("start_at"), S.col("m.end").cast("long").alias("end_at"), S.md5("m.text").alias("text_md5"))


@_register(_with(sql_matches("m", r"[Tt]h[a-z]{2,}", group=0), then="SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, count(DISTINCT text) AS texts FROM m GROUP BY doc_id"))
def regex_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern without groups that matches often: matches of whole texts, rolled up by document."""
    return _found(spark, sf_dir, r"[Tt]h[a-z]{2,}").groupBy("doc_id").agg(S.count("*").alias("n"), S.sum("m.start").alias("starts"), S.sum("m.end").alias("ends"), S.count_distinct("m.text").alias("texts"))


_NAMED = r'(token|user)(?: = "|: )(?<lead>[a-z-]{1,8})(?<rest>[0-9/]+)?'
_NAMED_RE2 = _NAMED.replace("?<", "?P<")


@_register(_with(f"a AS (SELECT doc_id, regexp_extract_all(content, {_quoted(_NAMED_RE2)}, 0) AS w, regexp_extract_all(content, {_quoted(_NAMED_RE2)}, 1) AS g, regexp_extract_all(content, {_quoted(_NAMED_RE2)}, 2) AS l, regexp_extract_all(content, {_quoted(_NAMED_RE2)}, 3) AS r FROM files)", then="SELECT doc_id, g[k] AS text, l[k] AS lead, nullif(r[k], '') AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM a)"))
def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups of matches; one that took no part is null."""
    return _found(spark, sf_dir, _NAMED, ["lead", "rest"]).select("doc_id", "m.text", "m.lead", "m.rest")


@_register(_with(sql_matches("m", TOKEN), then=f"SELECT doc_id, md5(text) AS text_md5, {_RANGE}, round({sql_entropy('text')}, 6) AS entropy FROM m WHERE {sql_entropy('text')} >= CAST(CAST(3.2 AS FLOAT) AS DOUBLE)"))
def scan_token_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of enough entropy, with lines and columns."""
    found = _found(spark, sf_dir, TOKEN).where(column(post.passes_entropy(col("m.text"), 3.2)))
    placed = found.select("doc_id", S.md5("m.text").alias("text_md5"), column(text.text_range(col("content"), col("m.start"), col("m.end"))).alias("r"), S.round(column(text.entropy(col("m.text"))), 6).alias("entropy"))
    return placed.select("doc_id", "text_md5", "r.*", "entropy")


# ---- Contexts -------------------------------------------------------------------------------------------

CONTEXTS: dict[str, Aux | Combined] = {
    "ctx_before": Aux("before", USER),
    "ctx_after": Aux("after", USER),
    "ctx_around": Aux("around", HOST),
    "ctx_char_band": Aux("around", USER, max_chars=40),
    "ctx_line_band": Aux("around", USER, max_lines=4),
    "ctx_long_line": Aux("before", USER, max_lines=2, max_line_length=500),
    "ctx_both_bands": Aux("after", USER, max_chars=200, max_lines=3),
    "ctx_each": Combined("each", (Aux("before", USER), Aux("after", USER, max_lines=1))),
    "ctx_either": Combined("either", (Aux("before", HOST), Aux("after", USER, max_chars=10))),
    "ctx_not": Combined("not", (Aux("around", USER, max_lines=1),)),
    "ctx_nested": Combined("each", (Combined("not", (Combined("either", (Aux("before", HOST, max_lines=5), Aux("after", HOST, max_lines=5))),)), Aux("around", USER))),
}


def _context(name: str, ctx: Aux | Combined) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = context.filtered(find_if_any(col("content"), TOKEN), ctx, col("content"))
        return inputs.files(spark, sf_dir).select("doc_id", S.explode(column(kept)).alias("m")).select("doc_id", S.col("m.start").cast("long").alias("start_at"), S.col("m.end").cast("long").alias("end_at"))

    lists, parts = {}, [sql_matches("cand", TOKEN), _lined("k", "cand")]
    for i, aux in enumerate(dict.fromkeys(context.patterns_of(ctx))):
        lists[aux] = f"aux{i}"
        parts += [sql_matches(f"aux{i}_0", aux.pattern), _lined(f"aux{i}", f"aux{i}_0")]
    _register(_with(*parts, then=f"SELECT doc_id, s AS start_at, e AS end_at FROM k WHERE {sql_context(ctx, lists)}"), name)(query)


for _name, _ctx in CONTEXTS.items():
    _context(_name, _ctx)


# ---- Conditions on candidates ---------------------------------------------------------------------------

_TEXTS = sql_matches("m", TOKEN)


def _judged(name: str, sql: str, flag: Callable[[Expr], Expr]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(spark, sf_dir, TOKEN).select("doc_id", S.col("m.start").cast("long").alias("start_at"), column(flag(col("m.text")).alias("result")))

    _register(_with(_TEXTS, then=f"SELECT doc_id, s AS start_at, {sql} AS result FROM m"), name)(query)


_STRICT = "^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}(==)?|[A-Za-z0-9+/]{3}=?)?$"
_DECODED = f"CASE WHEN regexp_matches(text, '{_STRICT}') THEN try(decode(from_base64(text))) END"
_SLASHES = "(length(text) - length(replace(text, '/', '')))"
_PATH_SQL = f"({_SLASHES} >= 2 AND {_SLASHES} / length(text)::DOUBLE >= 0.15)"
_URI_SQL = r"regexp_matches(text, '^(https?|ftps?|file|smtp|imap)://[^\n]*$')"
_JSON = Decoded(each=('"key"',), none=("nothing",))
_INNER = Decoded(pattern='"key":"([0-9a-f]+)"', post=Post(threshold=2.9, pattern_not=("0{3}", "^a")))
_INNER_TEXT = f"regexp_extract({_DECODED}, '\"key\":\"([0-9a-f]+)\"', 1)"
_low = lambda x, t: f"{sql_entropy(x)} < CAST(CAST({t} AS FLOAT) AS DOUBLE)"
_FAKE = ("^example", "a{20}", "secret")
_judged("entropy", f"round({sql_entropy('text')}, 6)", lambda x: F.round(text.entropy(x), 6))
_judged("statistical_filter", f"NOT {_low('text', 4.2)}", lambda x: post.passes(x, Post(threshold=4.2), ()))
_judged("pattern_not", "NOT (regexp_matches(text, '^example') OR regexp_matches(text, 'a{20}') OR regexp_matches(text, 'secret'))", lambda x: post.passes(x, Post(pattern_not=_FAKE), ()))
_judged("pattern_not_first", "CASE WHEN regexp_matches(text, '^example') THEN '^example' WHEN regexp_matches(text, 'a{20}') THEN 'a{20}' WHEN regexp_matches(text, 'secret') THEN 'secret' END", lambda x: post.first_denied(x, _FAKE))
_judged("heur_path", _PATH_SQL, post.is_path)
_judged("heur_uri", _URI_SQL, post.is_uri)
_judged("heuristic_list", f"NOT ({_PATH_SQL} OR {_URI_SQL})", lambda x: post.passes(x, Post(heuristics=("path", "uri", "unknown")), ()))
_judged("b64_decode", f"CASE WHEN contains(coalesce({_DECODED}, ''), 'key') THEN {_DECODED} END", lambda x: F.when(F.contains(F.coalesce(text.decode_base64(x), F.lit("")), F.lit("key")), text.decode_base64(x)))
_judged("b64_match", f"coalesce(contains({_DECODED}, '\"key\"') AND NOT contains({_DECODED}, 'nothing'), false)", lambda x: post.passes(x, Post(decoded=_JSON), ()))
_judged("b64_extract_nested", f"coalesce(length({_INNER_TEXT}) > 0 AND NOT {_low(_INNER_TEXT, 2.9)} AND NOT regexp_matches({_INNER_TEXT}, '0{{3}}|^a'), false)", lambda x: post.passes(x, Post(decoded=_INNER), ()))
_judged("post_reason", f"CASE WHEN {_low('text', 3.2)} THEN 'statisticalFilter' WHEN regexp_matches(text, '^example') THEN 'patternNot: ^example' WHEN {_PATH_SQL} THEN 'heuristicFilter: path' WHEN {_URI_SQL} THEN 'heuristicFilter: uri' END", lambda x: post.reason(x, Post(threshold=3.2, pattern_not=_FAKE, heuristics=("path", "uri")), ()))
_MARKED = Post(threshold=4.2, pattern_not=_FAKE)
_ALL = tuple(post.SKIPPABLE)
_TAG_LIST = f"list_filter([CASE WHEN {_low('text', 4.2)} THEN 'ENTROPY_FILTER' END, CASE WHEN regexp_matches(text, '^example|a{{20}}|secret') THEN 'KNOWN_FAKE_SECRET_FILTER' END], lambda t: t IS NOT NULL)"
_judged("skipped_tags", f"array_to_string({_TAG_LIST}, ',')", lambda x: F.concat_ws(",", post.in_order(post.marks(x, _MARKED, _ALL))))
_judged("low_confidence_msg", f"CASE WHEN len({_TAG_LIST}) > 0 THEN 'Remove it (low-confidence match, disabled filters: ' || array_to_string({_TAG_LIST}, ', ') || ')' ELSE 'Remove it' END", lambda x: post.with_suffix(F.lit("Remove it"), post.marks(x, _MARKED, _ALL)))

_GROUPED = r'token = "(?<kind>[a-z]{0,8})(?<rand>[0-9a-z-]{12,72})"'
_GROUPED_RE2 = _GROUPED.replace("?<", "?P<")


@_register(_with(f"a AS (SELECT doc_id, regexp_extract_all(content, {_quoted(_GROUPED_RE2)}, 1) AS k, regexp_extract_all(content, {_quoted(_GROUPED_RE2)}, 2) AS r FROM files), b AS (SELECT doc_id, unnest(k) AS kind, unnest(r) AS rand FROM a)", then=f"SELECT doc_id, kind, md5(rand) AS rand_md5 FROM b WHERE NOT {_low('rand', 3.3)} AND (kind = '' OR kind <> 'example')"))
def group_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on named groups of a match; a group that took no part passes."""
    own = Post(groups=(("rand", Post(threshold=3.3)), ("kind", Post(pattern_not=("^example$",)))))
    kept = F.filter(find_if_any(col("content"), _GROUPED, ["kind", "rand"]), lambda m: post.passes(m["text"], own, (), m))
    found = inputs.files(spark, sf_dir).select("doc_id", S.explode(column(kept)).alias("m"))
    return found.select("doc_id", S.coalesce("m.kind", S.lit("")).alias("kind"), S.md5("m.rand").alias("rand_md5"))


# ---- Rules, resolution and findings ---------------------------------------------------------------------

PLANTED = r"""
provider:
  metadata: {name: Planted, category: [Generic], message: Take this token out.}
  detection:
    pre: {include: {content: [token]}}
  rules:
    - id: planted-hex
      rspecKey: P1
      metadata: {name: hexadecimal token}
      detection:
        matching: {pattern: 'token = "([0-9a-f]{40})"'}
        post: {statisticalFilter: {threshold: 3.2}, patternNot: ['a{20}']}
      examples: [{text: 'token = "%{hex:40}"', containsSecret: true, match: '%{hex:40}'}, {text: 'token = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"', containsSecret: false}]
    - id: planted-assignment
      rspecKey: P2
      selectivity: providerGeneric
      metadata: {name: any token, message: Look at this assignment.}
      detection:
        pre: {reject: {ext: [png]}}
        matching:
          pattern: '(token = "[0-9A-Za-z/+=:.-]{20,80}")'
          context: {matchNot: {patternBefore: {pattern: 'user: (eve)', maxLineDistance: 2}}}
        post: {heuristicFilter: {heuristics: [path]}}
      examples: [{text: 'token = "%{mixed:30}"', containsSecret: true}]
    - id: planted-quoted
      rspecKey: P3
      selectivity: analyzerGeneric
      metadata: {name: quoted text, message: Look at this text.}
      detection:
        matching: {pattern: '"([0-9A-Za-z:/-]{20,80})"'}
      examples: [{text: 'token, "%{mixed:30}"', containsSecret: true}]
    - id: planted-half
      rspecKey: P4
      metadata: {name: end of a token, message: Look at this end.}
      detection:
        matching: {pattern: '([0-9a-f]{8}"[\n ]user: a)'}
      examples: [{text: 'token = "%{hex:40}" user: a', containsSecret: true}]
"""


def planted_rules() -> list[Rule]:
    return parse(PLANTED, name="planted")


_SCOPE = f"file_type = 'MAIN' AND length(content) > 0 AND contains(lower(content), 'token') AND NOT coalesce({_TEST_SQL}, false)"
_AUX_EVE = Aux("before", "user: (eve)", max_lines=2)
#: Candidates of the planted rules in order of arrival, as numbered rows of each file.
_CANDIDATES = [
    f"scoped AS (SELECT * FROM files WHERE {_SCOPE})",
    sql_matches("r1", 'token = "([0-9a-f]{40})"', "scoped"),
    sql_matches("r2", '(token = "[0-9A-Za-z/+=:.-]{20,80}")', "scoped"),
    _lined("k", "r2"),
    sql_matches("r3", '"([0-9A-Za-z:/-]{20,80})"', "scoped"),
    sql_matches("r4", r'([0-9a-f]{8}"[\n ]user: a)', "scoped"),
    sql_matches("eve_0", "user: (eve)", "scoped"),
    _lined("eve", "eve_0"),
    f"""found AS (SELECT doc_id, 'planted-hex' AS rule_id, 'P1' AS rule_key, 0 AS priority, s, e, text, 'Take this token out.' AS message FROM r1 WHERE NOT {_low('text', 3.2)} AND NOT regexp_matches(text, 'a{{20}}')
UNION ALL SELECT doc_id, 'planted-assignment', 'P2', 1, s, e, text, 'Look at this assignment.' FROM k WHERE {sql_context(Combined('not', (_AUX_EVE,)), {_AUX_EVE: 'eve'})} AND NOT {_PATH_SQL} AND doc_id NOT IN (SELECT doc_id FROM files WHERE ends_with(lower(filename), '.png'))
UNION ALL SELECT doc_id, 'planted-quoted', 'P3', 2, s, e, text, 'Look at this text.' FROM r3 WHERE doc_id IN (SELECT doc_id FROM files WHERE language IS NULL)
UNION ALL SELECT doc_id, 'planted-half', 'P4', 0, s, e, text, 'Look at this end.' FROM r4)""",
    "arrived AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_key, rule_id, s, e) AS n FROM found)",
]
#: Groups by a recursion over the numbers: the first group with a member that overlaps, else a new one.
_RESOLVED = [
    *_CANDIDATES,
    """folded AS (SELECT doc_id, 1::BIGINT AS n, [{'s': s, 'e': e, 'g': 1::BIGINT}] AS seen, 1::BIGINT AS g FROM arrived WHERE n = 1
UNION ALL SELECT doc_id, n, list_append(seen, {'s': s, 'e': e, 'g': g}), g FROM (SELECT a.doc_id, a.n, f.seen, a.s, a.e,
coalesce(list_min(list_transform(list_filter(f.seen, lambda x: x.s < a.e AND a.s < x.e), lambda x: x.g)), list_max(list_transform(f.seen, lambda x: x.g)) + 1) AS g FROM folded f JOIN arrived a ON a.doc_id = f.doc_id AND a.n = f.n + 1))""",
    "winners AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id, f.g ORDER BY priority, s, e, rule_key, rule_id) AS rank FROM arrived a JOIN folded f ON a.doc_id = f.doc_id AND a.n = f.n) WHERE rank = 1)",
]


@_register(_with(*_CANDIDATES, then="SELECT doc_id, rule_id, priority, s AS start_at, e AS end_at, message FROM found"))
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all rules before resolution: pre-filters, matches, contexts and conditions together."""
    found = scan.candidate_rows(inputs.files(spark, sf_dir), planted_rules())
    return found.select("doc_id", "c.rule_id", "c.priority", S.col("c.start").cast("long").alias("start_at"), S.col("c.end").cast("long").alias("end_at"), "c.message")


@_register(_with(*_RESOLVED, then="SELECT doc_id, rule_id, s AS start_at, e AS end_at FROM winners"))
def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each group of overlapping ones."""
    won = scan.candidate_rows(inputs.files(spark, sf_dir), planted_rules(), then=lambda found: resolve.resolved(found, scan.CANDIDATE))
    return won.select("doc_id", "c.rule_id", S.col("c.start").cast("long").alias("start_at"), S.col("c.end").cast("long").alias("end_at"))


_HIDDEN_SQL = [_BIDI_SQL, _TAGS_SQL, _SELECTORS_SQL]
_HIDDEN_ROWS = f"""SELECT doc_id, rule_key, line, col, 'Close the bidirectional character opened at column ' || col || ' of this line, or remove it.' AS message FROM bidi
UNION ALL SELECT doc_id, rule_key, line, col, 'Tag characters from column ' || col || ' on spell "' || {_SPELT} || '"; remove them.' FROM tags WHERE trim({_SPELT}) <> ''
UNION ALL SELECT doc_id, rule_key, line, col, 'There are ' || length(text) || ' variation selectors in a row from column ' || col || ' on; remove them unless they are meant.' FROM selectors"""
_PLACED = "winners w JOIN files USING (doc_id)"


@_register(
    _with(
        *_RESOLVED, *_HIDDEN_SQL, f"hidden AS ({_HIDDEN_ROWS})",
        then=f"SELECT doc_id, 'secrets' AS repo, rule_key, rule_id, {_RANGE}, message FROM {_PLACED} UNION ALL SELECT doc_id, 'text', rule_key, NULL, CAST(line AS INTEGER), NULL, NULL, NULL, message FROM hidden",
    )
)
def issues_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything at once: rules, resolution, places and hidden text, in one pass without a shuffle."""
    return scan.issues(inputs.files(spark, sf_dir), planted_rules())


@_register(
    _with(
        *_RESOLVED, *_HIDDEN_SQL, f"hidden AS ({_HIDDEN_ROWS})", f"placed AS (SELECT doc_id, rule_key, message, {_RANGE} FROM {_PLACED})",
        then="SELECT doc_id, 'secrets:' || rule_key || ' [' || start_line || ':' || start_col || '-' || end_line || ':' || end_col || '] ' || message AS issue FROM placed UNION ALL SELECT doc_id, 'text:' || rule_key || ' [' || line || '] ' || message FROM hidden",
    )
)
def issues_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as one text each."""
    return scan.described(issues_flagship(spark, sf_dir))


@_register(_with(*_CANDIDATES, then=f"SELECT doc_id, CAST({_line('s')} AS INTEGER) AS start_line, message FROM (SELECT doc_id, content, s, CASE WHEN regexp_matches(text, '^a') THEN 'Take this token out. (low-confidence match, disabled filters: ' || CASE WHEN {_low('text', 3.2)} THEN 'ENTROPY_FILTER' || CASE WHEN regexp_matches(text, 'a{{20}}') THEN ', KNOWN_FAKE_SECRET_FILTER' ELSE '' END ELSE 'x' END || ')' ELSE 'Take this token out.' END AS message FROM r1 WHERE NOT (regexp_matches(text, '^a') AND NOT {_low('text', 3.2)})) UNION ALL SELECT doc_id, CAST({_line('s')} AS INTEGER), 'Take this token out.' FROM r1 WHERE regexp_matches(text, '^a') AND NOT {_low('text', 3.2)}"))
def single_rule_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule alone, its filters set to mark candidates instead of rejecting them."""
    rules = [r for r in planted_rules() if r.id == "planted-hex"]
    return scan.secrets(inputs.files(spark, sf_dir), rules, scan.ScanConfig(skipped_filters=("ENTROPY_FILTER", "KNOWN_FAKE_SECRET_FILTER"))).select("doc_id", "start_line", "message")


@_register(_with(*_CANDIDATES, then=f"SELECT doc_id, 'planted-hex' AS rule_id, s AS start_at, CASE WHEN {_low('text', 3.2)} THEN 'statisticalFilter' ELSE 'patternNot: a{{20}}' END AS reason FROM r1 WHERE {_low('text', 3.2)} OR regexp_matches(text, 'a{{20}}') UNION ALL SELECT doc_id, 'planted-assignment', s, 'heuristicFilter: path' FROM k WHERE {sql_context(Combined('not', (_AUX_EVE,)), {_AUX_EVE: 'eve'})} AND {_PATH_SQL} AND doc_id NOT IN (SELECT doc_id FROM files WHERE ends_with(lower(filename), '.png'))"))
def rejection_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates were rejected: the first of each rule and file, and how many more."""
    return scan.rejections(inputs.files(spark, sf_dir), planted_rules()).select("doc_id", "rule_id", S.col("start").cast("long").alias("start_at"), "reason")


_OPTIONAL = r'token = "(?:([0-9a-f]{40})|[^"\n]*)"'


@_register(_with(then=f"SELECT doc_id, path FROM files WHERE {_SCOPE} AND len(list_filter(regexp_extract_all(content, {_quoted(_OPTIONAL)}, 1), lambda x: coalesce(x, '') = '')) > 0"))
def analysis_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which a match has no place, as its group took no part."""
    rule = Rule("optional", "P5", "", "", "specific", _OPTIONAL, planted_rules()[0].pre)
    return scan.errors(inputs.files(spark, sf_dir), [rule]).select("doc_id", "path")


_ACTIVE = {"P1", "P3"}


@_register(_with(*_CANDIDATES, then="SELECT doc_id, rule_key, count(*) AS candidates FROM found WHERE rule_key IN ('P1', 'P3') GROUP BY ALL"))
def active_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the rules of a quality profile."""
    found = scan.candidate_rows(inputs.files(spark, sf_dir), files.active(planted_rules(), _ACTIVE))
    return found.groupBy("doc_id", "c.rule_key").agg(S.count("*").alias("candidates"))


# ---- Hidden text ----------------------------------------------------------------------------------------


def _hidden(key: str) -> Query:
    return lambda spark, sf_dir: hidden.hidden_text(inputs.files(spark, sf_dir)).where(S.col("rule_key") == key).select("doc_id", S.col("line").cast("long").alias("line"), S.col("col").cast("long").alias("col"), "message")


_hidden_sql = lambda key: _with(*_HIDDEN_SQL, f"hidden AS ({_HIDDEN_ROWS})", then=f"SELECT doc_id, line, col, message FROM hidden WHERE rule_key = '{key}'")
_register(_hidden_sql(hidden.BIDI), "bidi_unclosed")(_hidden(hidden.BIDI))
_register(_hidden_sql(hidden.TAGS), "tag_block")(_hidden(hidden.TAGS))
_register(_hidden_sql(hidden.SELECTORS), "variation_selectors")(_hidden(hidden.SELECTORS))


# ---- Counts and roll-ups --------------------------------------------------------------------------------


@_register(_with(then="SELECT count(*) AS analyzed, count_if(is_hidden) AS hidden FROM files"))
def analyzed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.analyzed_files(inputs.files(spark, sf_dir).drop("content"))


@_register(_with(then=f"SELECT count_if({_TEST_SQL}) AS skipped, md5(array_to_string(list_sort(list(path) FILTER (WHERE {_TEST_SQL})), '|')) AS paths_md5 FROM files"))
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files are skipped as tests, and which."""
    counted = telemetry.skipped_files(inputs.files(spark, sf_dir), column(files.looks_like_test(col("path"))), with_paths=True)
    return counted.select("skipped", S.md5(S.concat_ws("|", "paths")).alias("paths_md5"))


_CI_PATH = "CASE WHEN doc_id % 5 = 0 THEN '.travis.yml' WHEN doc_id % 5 = 1 THEN 'sub/Jenkinsfile' WHEN doc_id % 5 = 2 THEN 'compose.yml' WHEN doc_id % 5 = 3 THEN '.claude/skills/s' || doc_id || '/SKILL.md' ELSE 'AGENTS.md' END"
_VENDORS = ", ".join(f"('{v}')" for v in sorted(set(telemetry.CI_FILES.values())))


@_register(f"SELECT vendor, CAST(vendor IN (SELECT CASE p WHEN '.travis.yml' THEN 'travisci' WHEN 'compose.yml' THEN 'dockercompose' END FROM (SELECT {_CI_PATH} AS p FROM documents WHERE doc_id % 5 IN (0, 2))) AS INTEGER) AS used FROM (VALUES {_VENDORS}) AS v(vendor)")
def ci_vendor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vendors' files there are, each vendor with 1 or 0."""
    return telemetry.ci_vendors(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_CI_PATH} AS path"))


@_register(f"SELECT kind, coalesce(n, 0) AS files, coalesce(t, '') AS tools FROM (VALUES ('instructions'), ('mcp_config'), ('other'), ('skills')) AS k(kind) LEFT JOIN (SELECT CASE WHEN p = 'AGENTS.md' THEN 'instructions' ELSE 'skills' END AS kind, count(*) AS n, max(CASE WHEN p = 'AGENTS.md' THEN 'any' ELSE 'claude' END) AS t FROM (SELECT {_CI_PATH} AS p FROM documents) WHERE p LIKE '%.md' GROUP BY 1) USING (kind)")
def agentic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding agents' files by kind, with the tools, zero where there are none."""
    return telemetry.agent_files(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_CI_PATH} AS path"))


_TIMED = "CASE WHEN doc_id % 4 = 3 THEN 'load' ELSE 'rule-' || CAST(doc_id % 10 AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '::preFilter' WHEN doc_id % 4 = 1 THEN '::matcher' ELSE '::postFilter' END END"


@_register(f"WITH b AS (SELECT id, count(*) AS count, CAST(sum(ns) AS BIGINT) AS total_ns FROM (SELECT {_TIMED} AS id, n_chars AS ns FROM documents) GROUP BY id), u AS (SELECT * FROM b UNION ALL SELECT regexp_extract(id, '::(.*)', 1) || '::general', count(*), CAST(sum(total_ns) AS BIGINT) FROM b WHERE contains(id, '::') GROUP BY 1) SELECT *, round(total_ns / 1000.0 / count, 3) AS mean_us FROM u")
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings by id, rolled up by step."""
    return telemetry.durations(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_TIMED} AS id", "n_chars AS ns"))


@_register("SELECT 'text.' || source AS key, CAST(sum(n_chars - 500) FILTER (WHERE n_chars >= 500) AS BIGINT) AS num, NULL AS str FROM documents GROUP BY source HAVING count_if(n_chars >= 500) > 0 UNION ALL SELECT 'text.lang', NULL, text FROM documents WHERE length(text) BETWEEN 1 AND 16384")
def measures_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures under their prefix: numbers of a key add up, texts too long are dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return telemetry.measures(docs.selectExpr("source AS key", "n_chars - 500 AS num"), docs.selectExpr("'lang' AS key", "text AS str"))


@_register(_with(*_RESOLVED, then="SELECT rule_key, CASE WHEN priority = 0 THEN 'specific' WHEN priority = 1 THEN 'providerGeneric' ELSE 'analyzerGeneric' END AS selectivity, count(*) AS issues, count(DISTINCT doc_id) AS files FROM winners GROUP BY ALL"))
def issues_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings rolled up by their rules' metadata."""
    rules = planted_rules()
    meta = spark.createDataFrame([(r.id, r.selectivity) for r in rules], "rule_id string, selectivity string")
    found = scan.secrets(inputs.files(spark, sf_dir), rules).select("doc_id", "rule_key", "rule_id")
    return found.join(S.broadcast(meta), "rule_id").groupBy("rule_key", "selectivity").agg(S.count("*").alias("issues"), S.count_distinct("doc_id").alias("files"))


# ---- The whole catalogue --------------------------------------------------------------------------------


@_register()
def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules tried on their own examples."""
    return outcomes(spark, load())


def _gate_sql() -> str:
    words = sorted({k.lower() for r in load() if r.keyword_routed for k in r.pre.include.content})
    any_word = " OR ".join("contains(c, '" + w.replace("'", "''") + "')" for w in words)
    by_path = r"file_type = 'MAIN' AND regexp_matches(path, '(^|/)(\.s3cfg|settings\.py|\.env)$')"
    return f"SELECT doc_id, ({any_word} OR ({by_path})) AS gated FROM (SELECT doc_id, path, file_type, lower(content) AS c FROM files)"


@_register(_with(then=_gate_sql()))
def catalog_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files the catalogue's keywords, or the paths of rules without keywords, let through."""
    table = inputs.files(spark, sf_dir).withColumn("lowered", S.lower("content"))
    gate = files.keyword_gate(load(), *map(col, ("path", "filename", "language", "file_type", "lowered")))
    return table.select("doc_id", column(gate).alias("gated"))


@_register()
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and checks over all documents."""
    return scan.issues(inputs.files(spark, sf_dir), load())


@_register()
def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and checks over all web pages."""
    return scan.issues(inputs.pages(spark, sf_dir), load())


@_register()
def catalog_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and checks over all turns of conversations."""
    return scan.issues(inputs.conversations(spark, sf_dir), load())


@_register()
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted rules over the documents as a stream, ended when all is read."""
    return streaming.scanned(spark, f"{sf_dir}/documents.parquet", planted_rules())
