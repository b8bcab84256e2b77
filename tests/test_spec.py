"""The rule language: shared blocks, inheritance, faults, patterns, the catalogue and its examples."""

import pytest
import yaml

from sparkveil.functions.regex import beyond_re2, groups_of, lint, with_lead
from sparkveil.plans.examples import outcomes
from sparkveil.plans.queries import PLANTED, planted_rules
from sparkveil.spec.load import expand, load, made, parse
from sparkveil.spec.model import Aux, Combined
from sparkveil.spec.schema import SpecError


def spec(**changes):
    """The planted specification with some parts changed."""
    tree = yaml.safe_load(PLANTED)
    for path, value in changes.items():
        at = tree
        *way, last = path.split("__")
        for k in way:
            at = at[int(k) if k.isdigit() else k]
        if value is ...:
            del at[last]
        else:
            at[int(last) if last.isdigit() else last] = value
    return yaml.safe_dump(tree)


def test_shared_blocks_keep_indentation():
    assert expand("a:\n  ${common/x.yaml}\nb: 1", {"common/x.yaml": "- 1\n\n- 2\n"}) == "a:\n  - 1\n  - 2\nb: 1"
    assert expand("a: ${common/x.yaml}", {}) == "a: ${common/x.yaml}"  # only whole lines
    with pytest.raises(KeyError):
        expand("${common/none.yaml}", {})


def test_inheritance():
    rules = {r.id: r for r in planted_rules()}
    any_token = rules["planted-assignment"]
    assert any_token.pre.include.content == ("token",) and any_token.pre.reject.ext == ("png",)  # pre adds up
    assert rules["planted-hex"].message == "Take this token out." and any_token.message == "Look at this assignment."
    shared = {"pre": {"include": {"content": ["token"]}}, "post": {"patternNot": ["x"]}}
    own = {r.id: r for r in parse(spec(provider__detection=shared))}
    assert own["planted-hex"].post.pattern_not == ("a{20}",) and own["planted-hex"].post.threshold == 3.2  # post replaces
    assert own["planted-quoted"].post.pattern_not == ("x",)
    assert any_token.context == Combined("not", (Aux("before", "user: (eve)", None, 2),)) and any_token.priority == 1


@pytest.mark.parametrize("changes", [
    {"provider__metadata__name": ...}, {"provider__rules__0__id": ...}, {"provider__rules__0__id": 5}, {"provider__metadata__category": ["Nonsense"]}, {"provider__rules__0__selectivity": "wrong"}, {"provider__rules__0__detection__matching": ...}, {"provider__rules__0__examples": []},
    {"provider__rules__0__detection__post": {"unknown": 1}}, {"provider__rules__0__detection__post": {"decodedBase64": {"post": {}}}}, {"provider__rules__0__detection__matching__context": {"matchEither": [{"patternAfter": "x"}]}}, {"provider__rules__0__detection__post__statisticalFilter__threshold": "high"}, {"provider__extra": 1}, {"provider__rules": []},
])
def test_faults(changes):
    with pytest.raises(SpecError):
        parse(spec(**changes))


def test_made_up_text_is_stable():
    assert made("%{hex:40}") == made("%{hex:40}") != made("%{hex:40:b}") and len(made("%{digit:7}")) == 7


def test_patterns():
    assert [n for _, n in groups_of(r"a(b)(?:c)(?<d>e)[(]\(\Q(\E(?=f)(g)")] == [None, "d", None]
    assert with_lead("ab(c)d") == "(ab)(c)d" and with_lead("(?i)ab(c)") == "(?i)(ab)(c)"
    assert all(with_lead(p) is None for p in ("abc", "a|b(c)", "(?:a(b))", r"(a)\1", "a(b)?"))
    assert {f.kind for f in lint("(a+)+")} == {"nested repeat"} and {f.kind for f in lint("a*")} == {"empty match"} and not lint("a{1,5}b")
    assert beyond_re2(r"(?=a)b++\k<x>") == ["lookaround", "possessive quantifier", "back-reference"] and not beyond_re2("(a)b{2}")


def test_catalogue():
    rules = load()
    assert len(rules) == 80 and len({r.key for r in rules}) == 30
    assert all(any(e.contains_secret for e in r.examples) for r in rules)
    assert not [r.id for r in rules if any(f.kind in ("nested repeat", "empty match") for f in lint(r.pattern))]


def test_examples(spark):
    wrong = [r for r in outcomes(spark, load() + planted_rules()).collect() if not r["ok"]]
    assert not wrong
