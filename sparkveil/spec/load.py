"""Specifications from YAML: shared blocks put in, checked, inherited, as Rule objects."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import yaml

from .model import Aux, Combined, Decoded, Example, FileFilter, Post, Pre, Rule
from .schema import check

RULES = Path(__file__).resolve().parent.parent / "rules"


def expand(text: str, blocks: dict[str, str]) -> str:
    """Lines that hold only ${common/NAME} become that block, each of its lines at their indentation."""

    def block(m: re.Match) -> str:
        if m[2] not in blocks:
            raise KeyError(f"there is no shared block {m[2]}")
        return "\n".join(m[1] + x for x in blocks[m[2]].splitlines() if x.strip())

    return re.sub(r"(?m)^([ \t]*)\$\{(common/[\w.-]+)\}[ \t]*$", block, text)


_MADE = re.compile(r"%\{(\w+):(\d+)(?::(\w+))?\}")
_ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "word": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def made(text: str) -> str:
    """Examples hold no secrets: %{hex:40} or %{hex:40:seed} stands for made-up characters, the same each time."""

    def draw(m: re.Match) -> str:
        alphabet, out, k = _ALPHABETS[m[1]], "", 0
        while len(out) < int(m[2]):
            out += "".join(alphabet[b % len(alphabet)] for b in hashlib.sha256(f"{m[1]}{m[3] or ''}{k}".encode()).digest())
            k += 1
        return out[: int(m[2])]

    return _MADE.sub(draw, text)


def _filter(x: dict | None) -> FileFilter:
    return FileFilter(*(tuple((x or {}).get(k, ())) for k in ("paths", "ext", "content")))


def _pre(x: dict | None) -> Pre:
    return Pre(_filter((x or {}).get("include")), _filter((x or {}).get("reject")))


def _context(x: dict | None) -> Aux | Combined | None:
    if x is None:
        return None
    (k, v), *_ = x.items()
    if k.startswith("pattern"):
        v = {"pattern": v} if isinstance(v, str) else v
        return Aux(k[len("pattern") :].lower(), v["pattern"], v.get("maxCharDistance"), v.get("maxLineDistance"), v.get("maxLineLength", 1000))
    return Combined({"matchEach": "each", "matchEither": "either", "matchNot": "not"}[k], tuple(map(_context, v if isinstance(v, list) else [v])))


def _post(x: dict | None) -> Post:
    x = x or {}
    d = x.get("decodedBase64")
    decoded = d is not None and Decoded(d.get("alphabet", "default"), tuple(d.get("matchEach", ())), tuple(d.get("matchNot", ())), d.get("matching", {}).get("pattern"), _post(d["post"]) if "post" in d else None)
    return Post(
        decoded or None,
        x.get("statisticalFilter", {}).get("threshold"),
        tuple(x.get("patternNot", ())),
        tuple(x.get("heuristicFilter", {}).get("heuristics", ())),
        tuple((g["name"], _post({k: v for k, v in g.items() if k != "name"})) for g in x.get("groups", ())),
    )


def rules_of(spec: dict) -> list[Rule]:
    """The rules of a checked specification. Of a provider's detection the file filters add to a rule's own,
    while matching, filters on the candidate and the message hold where the rule has none."""
    provider = spec["provider"]
    shared = provider.get("detection", {})
    out = []
    for r in provider["rules"]:
        own, meta = r["detection"], r["metadata"]
        matching = own.get("matching") or shared["matching"]
        out.append(
            Rule(
                id=r["id"],
                key=r["rspecKey"],
                name=meta["name"],
                message=meta.get("message") or provider["metadata"].get("message") or meta["name"],
                selectivity=r.get("selectivity", "specific"),
                pattern=matching["pattern"],
                pre=_pre(shared.get("pre")).merged(_pre(own.get("pre"))),
                context=_context(matching.get("context")),
                post=_post(own["post"] if "post" in own else shared.get("post")),
                examples=tuple(Example(made(x["text"]), x["containsSecret"], made(x["match"]).rstrip() if "match" in x else None, x.get("fileName", "file.txt")) for x in r["examples"]),
                category=tuple(provider["metadata"]["category"]),
                in_default_profile=meta.get("defaultProfile", True),
            )
        )
    return out


def parse(text: str, blocks: dict[str, str] | None = None, name: str = "specification") -> list[Rule]:
    return rules_of(check(yaml.safe_load(expand(text, blocks or {})), name))


def load(folder: Path | str = RULES) -> list[Rule]:
    """The rules of all specifications of a folder, by file name; ids must be unique."""
    folder = Path(folder)
    blocks = {f"common/{p.name}": p.read_text() for p in sorted((folder / "common").glob("*.yaml"))}
    rules = [r for p in sorted(folder.glob("*.yaml")) for r in parse(p.read_text(), blocks, p.name)]
    seen: set[str] = set()
    for r in rules:
        if r.id in seen:
            raise ValueError(f"two rules are called {r.id}")
        seen.add(r.id)
    return rules
