"""Path globs as regular expressions: ** crosses folders, * and ? do not."""

from __future__ import annotations

import re

from . import sql as F
from .sql import Expr


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", glob[i]), i + 1
    return f"^{out}$"


def path_matches(path: Expr, glob: str) -> Expr:
    """Whether the path, with forward slashes and none in front, matches; a blank glob matches nothing."""
    if not glob.strip():
        return F.lit(False)
    return F.ltrim(F.translate(path, "\\", "/"), F.lit("/")).rlike(glob_regex(glob.lstrip("/")))
