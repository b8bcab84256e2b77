"""Checks that a specification has the shape that the rule language asks for."""

from __future__ import annotations

from typing import Any

CATEGORIES = {
    "AI", "API Management", "Authentication Standard", "Blockchain", "Cloud Provider", "Cloud Collaboration", "Code Analysis", "Communication Platform", "Cryptography Standard",
    "Data Storage", "Database API Standard", "E-Commerce", "Identity Provider", "Marketplace", "Monitoring", "Package Repository", "Payment", "System Administration", "Version Control", "Web Framework", "Generic",
}


class SpecError(ValueError):
    """A specification that can't be used; its text lists every fault."""


class _Checker:
    def __init__(self) -> None:
        self.faults: list[str] = []

    def table(self, at: str, value: Any, required: set[str], optional: set[str], loose: bool = False) -> dict:
        if not isinstance(value, dict):
            self.faults.append(f"{at}: a mapping is needed")
            return {}
        for k in sorted(required - value.keys()):
            self.faults.append(f"{at}: {k} is missing")
        for k in sorted(map(str, value.keys() - required - optional)):
            if not loose:
                self.faults.append(f"{at}: {k} is unknown")
        return value

    def text(self, at: str, value: Any) -> None:
        if not isinstance(value, str):
            self.faults.append(f"{at}: text is needed")

    def texts(self, at: str, value: Any, least: int = 1) -> None:
        if not isinstance(value, list) or len(value) < least or not all(isinstance(x, str) for x in value):
            self.faults.append(f"{at}: a list of at least {least} texts is needed")

    def number(self, at: str, value: Any, kind: type | tuple = int) -> None:
        if isinstance(value, bool) or not isinstance(value, kind):
            self.faults.append(f"{at}: a number is needed")

    def filter(self, at: str, value: Any) -> None:
        for k, v in self.table(at, value, set(), {"paths", "ext", "content"}).items():
            self.texts(f"{at}.{k}", v)

    def pre(self, at: str, value: Any) -> None:
        for k, v in self.table(at, value, set(), {"include", "reject"}).items():
            self.filter(f"{at}.{k}", v)

    def context(self, at: str, value: Any) -> None:
        sides, kinds = {"patternBefore", "patternAfter", "patternAround"}, {"matchEach", "matchEither", "matchNot"}
        own = self.table(at, value, set(), sides | kinds)
        if len(own) != 1:
            self.faults.append(f"{at}: exactly one of {', '.join(sorted(sides | kinds))} is needed")
            return
        (k, v), *_ = own.items()
        if k in sides:
            if isinstance(v, str):
                return
            v = self.table(f"{at}.{k}", v, {"pattern"}, {"maxCharDistance", "maxLineDistance", "maxLineLength"})
            self.text(f"{at}.{k}.pattern", v.get("pattern", ""))
            for n in ("maxCharDistance", "maxLineDistance", "maxLineLength"):
                if n in v:
                    self.number(f"{at}.{k}.{n}", v[n])
        elif k == "matchNot":
            self.context(f"{at}.{k}", v)
        elif k in kinds:
            if not isinstance(v, list) or len(v) < 2:
                self.faults.append(f"{at}.{k}: a list of at least 2 is needed")
                return
            for i, x in enumerate(v):
                self.context(f"{at}.{k}[{i}]", x)

    def post(self, at: str, value: Any, nested: bool = False, named: bool = False) -> None:
        keys = {"statisticalFilter", "patternNot", "heuristicFilter"} | (set() if nested else {"decodedBase64"}) | (set() if nested or named else {"groups"})
        own = self.table(at, value, {"name"} if named else set(), keys)
        if nested and not own:
            self.faults.append(f"{at}: at least one filter is needed")
        if "statisticalFilter" in own:
            f = self.table(f"{at}.statisticalFilter", own["statisticalFilter"], {"threshold"}, set())
            self.number(f"{at}.statisticalFilter.threshold", f.get("threshold", 0), (int, float))
        if "patternNot" in own:
            self.texts(f"{at}.patternNot", own["patternNot"])
        if "heuristicFilter" in own:
            f = self.table(f"{at}.heuristicFilter", own["heuristicFilter"], {"heuristics"}, set())
            self.texts(f"{at}.heuristicFilter.heuristics", f.get("heuristics", []))
        if "decodedBase64" in own:
            f = self.table(f"{at}.decodedBase64", own["decodedBase64"], set(), {"alphabet", "matchEach", "matchNot", "matching", "post"})
            if f.get("alphabet", "default") not in ("default", "y64"):
                self.faults.append(f"{at}.decodedBase64.alphabet: default or y64 is needed")
            for n in ("matchEach", "matchNot"):
                if n in f:
                    self.texts(f"{at}.decodedBase64.{n}", f[n])
            if "matching" in f:
                m = self.table(f"{at}.decodedBase64.matching", f["matching"], {"pattern"}, set())
                self.text(f"{at}.decodedBase64.matching.pattern", m.get("pattern", ""))
            if "post" in f:
                self.post(f"{at}.decodedBase64.post", f["post"], nested=True)
        for i, g in enumerate(own.get("groups", [])):
            self.post(f"{at}.groups[{i}]", g, named=True)

    def detection(self, at: str, value: Any, whole: bool) -> None:
        own = self.table(at, value, {"matching"} if whole else set(), {"pre", "matching", "post"})
        if "pre" in own:
            self.pre(f"{at}.pre", own["pre"])
        if "matching" in own:
            m = self.table(f"{at}.matching", own["matching"], {"pattern"}, {"context"})
            self.text(f"{at}.matching.pattern", m.get("pattern", ""))
            if "context" in m:
                self.context(f"{at}.matching.context", m["context"])
        if "post" in own:
            self.post(f"{at}.post", own["post"])

    def rule(self, at: str, value: Any) -> None:
        own = self.table(at, value, {"id", "rspecKey", "metadata", "detection", "examples"}, {"selectivity"}, loose=True)
        self.text(f"{at}.id", own.get("id", ""))
        self.text(f"{at}.rspecKey", own.get("rspecKey", ""))
        if own.get("selectivity", "specific") not in ("specific", "providerGeneric", "analyzerGeneric"):
            self.faults.append(f"{at}.selectivity: specific, providerGeneric or analyzerGeneric is needed")
        m = self.table(f"{at}.metadata", own.get("metadata", {}), {"name"}, {"message", "defaultProfile", "charset"})
        self.text(f"{at}.metadata.name", m.get("name", ""))
        self.detection(f"{at}.detection", own.get("detection", {}), whole=True)
        examples = own.get("examples", [])
        if not isinstance(examples, list) or not examples:
            self.faults.append(f"{at}.examples: at least 1 is needed")
            return
        for i, x in enumerate(examples):
            x = self.table(f"{at}.examples[{i}]", x, {"text", "containsSecret"}, {"match", "fileName"})
            if not isinstance(x.get("containsSecret", True), bool):
                self.faults.append(f"{at}.examples[{i}].containsSecret: true or false is needed")


def check(spec: Any, name: str) -> dict:
    """The specification, or SpecError with all its faults."""
    c = _Checker()
    provider = c.table("provider", c.table(name, spec, {"provider"}, set()).get("provider", {}), {"metadata", "rules"}, {"detection"})
    meta = c.table("provider.metadata", provider.get("metadata", {}), {"name", "category"}, {"message", "references", "fix", "impact"})
    c.text("provider.metadata.name", meta.get("name", ""))
    c.texts("provider.metadata.category", meta.get("category", []))
    for x in meta.get("category", []) if isinstance(meta.get("category"), list) else []:
        if x not in CATEGORIES:
            c.faults.append(f"provider.metadata.category: {x!r} is no category")
    if "detection" in provider:
        c.detection("provider.detection", provider["detection"], whole=False)
    rules = provider.get("rules", [])
    if not isinstance(rules, list) or not rules:
        c.faults.append("provider.rules: at least 1 is needed")
        rules = []
    for i, r in enumerate(rules):
        c.rule(f"provider.rules[{i}]", r)
    if c.faults:
        raise SpecError(f"{name} is no valid specification:\n" + "\n".join(c.faults))
    return spec
