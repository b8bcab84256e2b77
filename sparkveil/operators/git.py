"""What Git says of a working tree, from the lines its commands print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dirty_paths(status: DataFrame) -> DataFrame:
    """(path) of untracked and modified files. status: (line) as git status --porcelain prints; added,
    deleted and renamed files are not among them."""
    code = F.substring("line", 1, 2)
    return status.where(code.isin("??", " M", "M ", "MM")).select(F.trim(F.expr("substring(line, 4)")).alias("path"))


def remote_of(uri: Column) -> Column:
    """(ok, organization, project) of a remote's address: its last two parts, the last without extension."""
    parts = F.split(F.trim(uri), "[/:]")
    project = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", "")
    organization = F.try_element_at(parts, F.lit(-2))
    ok = F.coalesce((F.length(project) > 0) & (F.length(organization) > 0), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, organization).alias("organization"), F.when(ok, project).alias("project"))


def first_remote(remotes: DataFrame) -> DataFrame:
    """(name, uri) of the first remote. remotes: (pos, line) as git remote -v prints."""
    cut = remotes.select("pos", F.split(F.trim("line"), r"\s+").alias("p")).where(F.size("p") >= 2)
    return cut.groupBy().agg(F.min(F.struct("pos", F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("uri"))).alias("r")).where("r is not null").select("r.name", "r.uri")


def preferred(first: DataFrame, first_ok: bool, second: DataFrame, second_ok: bool) -> tuple[DataFrame, bool]:
    """The first source that worked; if neither did, an empty table and False."""
    if first_ok:
        return first, True
    return (second, True) if second_ok else (first.limit(0), False)
