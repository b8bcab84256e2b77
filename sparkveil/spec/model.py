"""What a rule says, after macros, inheritance and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Rules of a smaller number win over others that overlap them.
PRIORITIES = {"specific": 0, "providerGeneric": 1, "analyzerGeneric": 2}


@dataclass(frozen=True)
class FileFilter:
    paths: tuple[str, ...] = ()
    ext: tuple[str, ...] = ()
    content: tuple[str, ...] = ()

    def merged(self, other: FileFilter) -> FileFilter:
        return FileFilter(self.paths + other.paths, self.ext + other.ext, self.content + other.content)


@dataclass(frozen=True)
class Pre:
    include: FileFilter = FileFilter()
    reject: FileFilter = FileFilter()

    def merged(self, other: Pre) -> Pre:
        """A rule's lists add to its provider's."""
        return Pre(self.include.merged(other.include), self.reject.merged(other.reject))


@dataclass(frozen=True)
class Aux:
    """A pattern that must be near a candidate: before, after or around it."""

    side: str
    pattern: str
    max_chars: int | None = None
    max_lines: int | None = None
    max_line_length: int = 1000


@dataclass(frozen=True)
class Combined:
    """each (all), either (any) or not (none) of the parts."""

    kind: str
    parts: tuple[Aux | Combined, ...]


@dataclass(frozen=True)
class Decoded:
    alphabet: str = "default"
    each: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    pattern: str | None = None
    post: Post | None = None


@dataclass(frozen=True)
class Post:
    decoded: Decoded | None = None
    threshold: float | None = None
    pattern_not: tuple[str, ...] = ()
    heuristics: tuple[str, ...] = ()
    groups: tuple[tuple[str, Post], ...] = ()


@dataclass(frozen=True)
class Example:
    text: str
    contains_secret: bool
    match: str | None = None
    file_name: str = "file.txt"


@dataclass(frozen=True)
class Rule:
    id: str
    key: str
    name: str
    message: str
    selectivity: str
    pattern: str
    pre: Pre = Pre()
    context: Aux | Combined | None = None
    post: Post = Post()
    examples: tuple[Example, ...] = ()
    category: tuple[str, ...] = field(default=())
    in_default_profile: bool = True

    @property
    def priority(self) -> int:
        return PRIORITIES[self.selectivity]

    @property
    def keyword_routed(self) -> bool:
        """Whether a keyword must be in a text for the rule to match."""
        return bool(self.pre.include.content)
