"""Truth tables of the operators, as small tables of expressions."""

import math
import re

import pytest
from pyspark.sql import functions as S

from sparkveil.functions import regex, text
from sparkveil.functions import sql as F
from sparkveil.functions.glob import path_matches
from sparkveil.functions.sql import col, column
from sparkveil.operators import context, files, git, hidden, post, resolve, telemetry
from sparkveil.plans import scan
from sparkveil.spec.model import Aux, Combined, Decoded, FileFilter, Post


def evaluate(spark, expr, **values):
    """The value of an expression over one row."""
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "_ int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column(expr)).first()[0]


# one job for many cases: a list of (expression, expected)
def check(spark, cases):
    row = spark.range(1).select(*[column(e).alias(f"c{i}") for i, (e, _) in enumerate(cases)]).first()
    for i, (e, want) in enumerate(cases):
        assert row[i] == want, (e.sql, row[i], want)


def test_line_ends(spark):
    n = lambda t: text.normalize_newlines(F.lit(t))
    check(spark, [(n("a\nb"), "a\nb"), (n("a\rb"), "a\nb"), (n("a\r\nb"), "a\nb"), (n("a\n"), "a"), (n("a\n\n"), "a\n"), (n(""), ""), (n("\r\r\n\n"), "\n\n"), (F.size(text.lines(F.lit(""))), 0), (F.size(text.lines(F.lit("a\n"))), 2)])


def test_places(spark):
    t = F.lit("ab\ncde\n\nf")
    check(spark, [(text.line_starts(t), [0, 3, 7, 8]), (text.line_number(t, F.lit(0)), 1), (text.line_number(t, F.lit(3)), 2), (text.line_number(t, F.lit(8)), 4), (text.line_column(t, F.lit(5)), 2), (text.line_at(t, F.lit(4)), "cde"), (text.text_range(t, F.lit(4), F.lit(20)), None), (text.text_range(t, F.lit(-1), F.lit(2)), None)])
    assert evaluate(spark, text.text_range(t, F.lit(1), F.lit(5))).asDict() == {"start_line": 1, "start_col": 1, "end_line": 2, "end_col": 2}


def test_entropy(spark):
    def shannon(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))

    for s in ("a", "ab", "aabb", "rule matching pattern", "0123456789abcdef", "é\U0001f600x"):
        assert evaluate(spark, text.entropy(col("x")), x=s) == pytest.approx(shannon(s))
    assert evaluate(spark, text.entropy(col("x")), x="") == 0
    # thresholds are single precision
    assert post.threshold_of(4.2) < 4.2


def test_globs(spark):
    m = lambda p, g: path_matches(F.lit(p), g)
    check(spark, [(m("a/b/c.py", "**/*.py"), True), (m("c.py", "**/*.py"), True), (m("a/c.py", "*.py"), False), (m("a/b/c", "a/**"), True), (m("a\\b\\c.py", "a/*/c.py"), True), (m("/x/y", "x/y"), True), (m("a.py", " "), False), (m("a+b.py", "a+b.p?"), True), (m("ab.py", "a.b.py"), False)])


def test_extensions_and_keywords(spark):
    e = lambda f, x: files.has_extension(F.lit(f), x)
    k = lambda t, x: files.has_keyword(F.lower(F.lit(t)), x)
    check(spark, [(e("a.PY", "py"), True), (e("a.py", ".py"), True), (e("a.tar.gz", ".tar.gz"), True), (e("py", "py"), False), (e("a.py", " "), False), (e("a.pyc", "py"), False), (k("has TOKEN in", "token"), True), (k("has token", "ToKeN"), True), (k("none", "token"), False), (k("none", "  "), False)])


def test_filters_combine_kinds(spark):
    f = FileFilter(paths=("src/**", "lib/**"), ext=("py",), content=("key",))
    args = lambda p, c: (F.lit(p), F.lit(p.rsplit("/", 1)[-1]), F.lit(c))
    check(spark, [(files.included(f, *args("src/a.py", "a key")), True), (files.included(f, *args("lib/a.py", "a key")), True), (files.included(f, *args("src/a.js", "a key")), False), (files.included(f, *args("src/a.py", "none")), False), (files.included(FileFilter(), *args("x", "")), True), (files.rejected(f, *args("x/a.js", "a key")), True), (files.rejected(f, *args("x/a.js", "none")), False), (files.rejected(FileFilter(), *args("x", "")), False)])


@pytest.mark.parametrize("path,want", [
    ("src/test/a.py", True), ("a/tests/b.py", True), ("docs/a.md", True), ("a/mytests/b", True), ("a/unittest/b", True), ("test_a.py", True), ("a/b.test.js", True), ("a/b_test.rb", True), ("a/b.spec.tsx", True), ("a/b.t", True), ("a/__fixtures__/x", True),
    ("src/main/a.py", False), ("a/contest.py", True), ("a/contested.py", False), ("latest/a.py", True), ("a/testing/b.py", False), ("/abs/test/a.py", False), ("../test/a.py", False), ("C:\\test\\a.py", False), ("doc", False), ("a\\test\\b.c", True),
])
def test_names_of_tests(spark, path, want):
    assert evaluate(spark, files.looks_like_test(col("p")), p=path) is want


def test_binary_names_and_translations(spark):
    b = lambda n: files.looks_binary(F.lit(n))
    t = lambda p: files.translation_file(F.lit(p))
    check(spark, [(b("a.png"), True), (b("a.PNG"), True), (b("png"), False), (b("a.py"), False), (b("cacerts"), True), (b("0123456789abcdef0123456789abcdef"), True), (b("0" * 32), False), (b("0123456789abcdef"), False), (t("app/res/values-pl/strings.xml"), True), (t("res/values/strings.xml"), False), (t("res/values-pl/other.xml"), False)])


def test_non_text(spark):
    check(spark, [(text.has_non_text(F.lit(f"a{chr(c)}b")), c in {*range(1, 8), *range(0x0E, 0x1B), *range(0x1C, 0x20)}) for c in range(1, 33)])


@pytest.mark.parametrize("pattern,names", [(r"t(\d+)x", []), (r"(?<a>[a-z])(?<b>\d)?", ["a", "b"]), (r"\d+", []), (r"k=(?:\"([a-z]+)\"|'([a-z]+)')", []), (r"(?i)AB(c)", [])])
def test_matches_and_their_places(spark, pattern, names):
    t = "t12x \U0001f600 t3x\nk=\"ab\" k='cd' abC ABc t4x é t55x"
    rows = evaluate(spark, regex.find_all(col("t"), pattern, names), t=t)
    own = re.compile(pattern.replace("(?<", "(?P<"))
    want = list(own.finditer(t))
    assert len(rows) == len(want)
    for r, m in zip(rows, want):
        assert (r["whole_start"], r["whole_end"]) == m.span()
        if own.groups and m[1] is None:
            assert r["start"] == -1
        else:
            assert (r["start"], r["end"]) == m.span(1 if own.groups else 0) and t[r["start"] : r["end"]] == r["text"]
        for n in names:
            assert r[n] == m[n]


def test_patterns_free_of_context():
    assert all(map(regex.context_free, ['t = "([0-9a-f]{4})"', r"a\+\+(b+?)[$^b]", "(?i)(?<n>x|y){2,3}", r"[+]+\\b"]))
    assert not any(map(regex.context_free, [r"\bab", "^a", "a$", "a++b", "a(?=b)", "(?<!a)b", "(?>a)b", r"(a)\1", r"\Qa\E", r"a\R", "a{2}+", "[a]++"]))


@pytest.mark.parametrize("pattern", ["a(b)?", "a(b+)(a?)", "(a)(?:b|bb)c|b(c)", "ab+?", "é(.)", "(?:x(y)|y)z?"])
def test_places_of_few_and_of_many_matches(spark, pattern):
    """Matches looked for one by one have the places of those between which a text is split."""
    for t in ("abbc", "bbab abb é\U0001f600aéb", "", "b", "xyzyz xy", "abbcabé"):
        for text_ in (t, t * 20):
            rows = evaluate(spark, regex.find_all(col("t"), pattern), t=text_)
            want = list(re.finditer(pattern, text_))
            assert [(r["whole_start"], r["whole_end"]) for r in rows] == [m.span() for m in want]
            group = 1 if re.compile(pattern).groups else 0
            assert [r["text"] for r in rows] == [m[group] or "" for m in want]


def test_hidden_characters_are_told_by_one_comparison(spark):
    """The range is first in the class, and leaves none of its characters out."""
    assert hidden._ANY.startswith(r"[\x{202A}-\x{10FFFF}&&[")
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c > 0xFD00 and c < 0x10100 or 0xDFF00 < c < 0xE0300)]
    want = {*range(0x202A, 0x202C), 0x202D, 0x202E, *range(0x2066, 0x2069), *range(0xE0020, 0xE0080), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
    found = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, t string").where(column(col("t").rlike(hidden._ANY))).select("code").collect()
    assert {r["code"] for r in found} == want


def span(s, e):
    return F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"))


def test_sides_and_distances(spark):
    c = span(10, 20)
    w = lambda *x: context.within(*map(F.lit, x[:4]), x[4])
    check(spark, [
        (context.before(c, span(5, 10)), True), (context.before(c, span(5, 11)), False), (context.after(c, span(20, 22)), True), (context.after(c, span(19, 22)), False), (context.around(c, span(12, 15)), False), (context.around(c, span(0, 3)), True),
        (w(0, 5, 10, 20, 5), True), (w(0, 5, 10, 20, 4), False), (w(25, 30, 10, 20, 5), True), (w(25, 30, 10, 20, 4), False), (w(12, 14, 10, 20, 0), True), (w(20, 22, 10, 20, 0), True), (w(8, 30, 10, 20, 0), True),
    ])


@pytest.mark.parametrize("ctx,content,kept", [
    (Aux("before", "b"), "b x", True), (Aux("before", "b"), "x b", False), (Aux("after", "b"), "x b", True), (Aux("around", "b"), "b x", True), (Aux("around", "b"), "x", False),
    (Aux("before", "b", max_lines=1), "b\nx", True), (Aux("before", "b", max_lines=1), "b\n\nx", False), (Aux("before", "b", max_chars=2), "b  x", True), (Aux("before", "b", max_chars=2), "b   x", False),
    (Aux("before", "b", max_lines=0, max_line_length=10), "b       x", True), (Aux("before", "b", max_lines=0, max_line_length=9), "b       x", False), (Aux("before", "b", max_line_length=2), "b       x", True),
    (Combined("each", (Aux("before", "b"), Aux("after", "a"))), "b x a", True), (Combined("each", (Aux("before", "b"), Aux("after", "a"))), "b x", False), (Combined("either", (Aux("before", "b"), Aux("after", "a"))), "x a", True),
    (Combined("not", (Aux("before", "b"),)), "x", True), (Combined("not", (Aux("before", "b"),)), "b x", False), (Combined("not", (Combined("either", (Aux("before", "b"), Aux("after", "a"))),)), "x a", False), (None, "x", True),
])
def test_contexts(spark, ctx, content, kept):
    found = context.filtered(regex.find_if_any(col("t"), "x"), ctx, col("t"))
    assert (len(evaluate(spark, found, t=content)) == 1) is kept


def test_heuristics(spark):
    p, u = (lambda x: post.is_path(F.lit(x))), (lambda x: post.is_uri(F.lit(x)))
    check(spark, [(p("/a/b"), True), (p("a\\b\\c"), True), (p("a/b"), False), (p("/" + "a" * 20 + "/"), False), (u("https://h/x"), True), (u("ftp://h"), True), (u("xhttps://h"), False), (u("gopher://h"), False), (u("http://h\nx"), False)])


def test_base64(spark):
    d = lambda x, a="default": text.decode_base64(F.lit(x), a)
    check(spark, [(d("aGVsbG8="), "hello"), (d("aGVsbG8"), "hello"), (d("aGVs bG8="), None), (d("aGVsbG8=="), None), (d("aGVsb"), None), (d("!!"), None), (d(""), ""), (d("Pz8_"), "???"), (d("Pz8-"), "??>"), (d("aGVsbG8-", "y64"), "hello"), (d("Pz8_", "y64"), "???")])


def test_reasons_and_marks(spark):
    p = Post(threshold=3.0, pattern_not=("aa", "b+"), heuristics=("uri",), decoded=None)
    r = lambda x, skipped=(): post.reason(F.lit(x), p, skipped)
    inner = Post(decoded=Decoded(pattern="k=(\\w+)", post=Post(pattern_not=("no",))))
    d = lambda x: post.reason(F.base64(F.lit(x)), inner, ())
    check(spark, [
        (r("cccc"), "statisticalFilter"), (r("aa234567890"), "patternNot: aa"), (r("b1234567890"), "patternNot: b+"), (r("http://cdefg12"), "heuristicFilter: uri"), (r("cdefghijkl"), None), (r("cccc", ("ENTROPY_FILTER",)), None), (r("aa23456789cd", ("KNOWN_FAKE_SECRET_FILTER",)), None),
        (post.marks(F.lit("aaaa"), p, ("ENTROPY_FILTER", "KNOWN_FAKE_SECRET_FILTER")), ["ENTROPY_FILTER", "KNOWN_FAKE_SECRET_FILTER"]), (post.marks(F.lit("aaaa"), p, ()), []),
        (d("k=yes"), None), (d("k=no"), "decodedBase64 -> patternNot: no"), (d("nothing"), "decodedBase64"), (post.reason(F.lit("x x"), inner, ()), "decodedBase64"),
        (post.with_suffix(F.lit("m"), F.array(F.lit("TEST_FILES_FILTER"), F.lit("ENTROPY_FILTER"))), "m (low-confidence match, disabled filters: ENTROPY_FILTER, TEST_FILES_FILTER)"), (post.with_suffix(F.lit("m"), F.array().cast("array<string>")), "m"),
    ])


def candidate(rule, priority, s, e):
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(rule).alias("rule_key"), F.lit(priority).alias("priority"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit("t").alias("text"), F.lit(rule).alias("message"), F.array().cast("array<string>").alias("skipped"))


@pytest.mark.parametrize("given,won", [
    ([("a", 0, 0, 5), ("b", 1, 3, 8)], ["a"]), ([("a", 1, 0, 5), ("b", 0, 3, 8)], ["b"]), ([("a", 0, 0, 5), ("b", 0, 5, 8)], ["a", "b"]), ([("a", 0, 0, 5), ("b", 0, 6, 8)], ["a", "b"]), ([("a", 0, 0, 5), ("b", 0, 0, 5)], ["a"]),
    ([("a", 2, 0, 5), ("b", 1, 4, 9), ("c", 0, 8, 12)], ["c"]), ([("a", 0, 0, 5), ("b", 1, 8, 12), ("c", 2, 4, 9)], ["a", "b"]), ([("a", 0, -1, -1)], []), ([], []),
])
def test_overlaps(spark, given, won):
    cs = F.array(*(candidate(*g) for g in given)) if given else F.array().cast(f"array<{scan.CANDIDATE}>")
    assert sorted(c["rule_id"] for c in evaluate(spark, resolve.resolved(cs, scan.CANDIDATE))) == won


LRE, RLO, PDF, LRI, PDI = "\u202a", "\u202e", "\u202c", "\u2066", "\u2069"


@pytest.mark.parametrize("line,at", [(f"a{LRE}b", 2), (f"a{LRE}b{PDF}", None), (f"{LRE}{RLO}{PDF}", 1), (f"{LRI}a{PDF}", 1), (f"{LRI}a{PDI}{RLO}", 4), (f"{LRE}{LRI}", 1), (f"{LRI}{LRE}{LRE}", 1), (f"{PDF}{PDI}x", None), (f"\U0001f600{LRE}", 3), ("plain", None), (f"{LRE}{PDF}{PDF}{LRE}", 4)])
def test_bidirectional(spark, line, at):
    assert evaluate(spark, hidden.unclosed(col("t")), t=line) == at


def tag(s):
    return "".join(chr(0xE0000 + ord(c)) for c in s)


def test_runs_of_hidden_characters(spark):
    rows = [(1, "a.py", "x" + tag("hi") + " y" + tag("o")), (2, "a.py", "\U0001f3f4" + tag("gb") + "\U000e007f z" + tag("hey")), (3, "a.py", "ok\nq" + "\ufe00" * 4), (4, "a.py", "q" + "\ufe00" * 3), (5, "a.py", tag("  ")), (6, "res/values-pl/strings.xml", LRE), (7, "a.py", "")]
    found = hidden.hidden_text(spark.createDataFrame(rows, "doc_id long, path string, content string")).collect()
    assert sorted((r["doc_id"], r["rule_key"], r["line"], r["col"]) for r in found) == [(1, hidden.TAGS, 1, 2), (2, hidden.TAGS, 1, 4), (3, hidden.SELECTORS, 2, 2)]
    assert '"hi"' in next(r["message"] for r in found if r["doc_id"] == 1)


def test_git(spark):
    status = spark.createDataFrame([("?? new.py",), (" M a.py",), ("M  b.py",), ("MM c.py",), ("A  d.py",), (" D e.py",), ("R  f -> g",)], "line string")
    dirty = git.dirty_paths(status)
    assert sorted(r["path"] for r in dirty.collect()) == ["a.py", "b.py", "c.py", "new.py"]
    table = spark.createDataFrame([("a.py",), ("x.py",), (".git/config",), ("m/.git/x",)], "path string")
    assert [r["path"] for r in files.tracked(table, dirty).collect()] == ["x.py"]
    assert files.tracked(table, dirty, git_ok=False).count() == 4
    remotes = spark.createDataFrame([(0, "origin\thttps://host/org/proj.git (fetch)"), (1, "other\tx (fetch)")], "pos int, line string")
    row = git.first_remote(remotes).select(git.remote_of(S.col("uri")).alias("r")).first()["r"]
    assert (row["ok"], row["organization"], row["project"]) == (True, "org", "proj")
    empty = status.limit(0)
    assert git.preferred(status, False, empty, True) == (empty, True) and git.preferred(status, True, empty, True) == (status, True)
    assert git.preferred(status, False, status, False)[1] is False


def test_telemetry(spark):
    table = spark.createDataFrame([(".travis.yml", False), ("sub/Jenkinsfile", True), ("AGENTS.md", False), ("a/.mcp.json", False)], "path string, is_hidden boolean")
    assert {r["vendor"]: r["used"] for r in telemetry.ci_vendors(table).collect()}["travisci"] == 1
    assert sum(r["used"] for r in telemetry.ci_vendors(table).collect()) == 1
    kinds = {r["kind"]: (r["files"], r["tools"]) for r in telemetry.agent_files(table).collect()}
    assert kinds["instructions"] == (1, "any") and kinds["mcp_config"] == (1, "claude") and kinds["skills"] == (0, "")
    assert tuple(telemetry.analyzed_files(table).first()) == (4, 1)
    timings = spark.createDataFrame([("r::matcher", 5), ("r::matcher", 7), ("s::matcher", 1), ("x", 2)], "id string, ns long")
    assert {r["id"]: (r["count"], r["total_ns"]) for r in telemetry.durations(timings).collect()} == {"r::matcher": (2, 12), "s::matcher": (1, 1), "x": (1, 2), "matcher::general": (2, 13)}
    numbers = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1)], "key string, num long")
    texts = spark.createDataFrame([("t", "x"), ("u", ""), ("v", "y" * 16385)], "key string, str string")
    assert sorted((r["key"], r["num"], r["str"]) for r in telemetry.measures(numbers, texts).collect()) == [("text.a", 3, None), ("text.t", None, "x")]
    assert spark.range(1).select(telemetry.as_list(S.array(S.lit("a"), S.lit("b")))).first()[0] == '["a", "b"]'
