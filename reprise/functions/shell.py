"""Whether a tool call changes something, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def git_is_mutating(arguments: Column) -> Column:
    """arguments: the tokens behind git."""
    words = F.filter(arguments, lambda a: ~a.startswith("-"))
    sub, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    forced = F.exists(arguments, lambda a: a.isin("-d", "-D", "-m", "-M"))
    return (
        F.when(F.size(words) == 0, False)
        .when(sub.isin("branch", "tag"), forced)
        .when(sub.isin(*V.GIT_READONLY), False)
        .when(sub == "stash", ~F.coalesce(second.isin("list", "show"), F.lit(False)))
        .otherwise(True)
    )


def command_is_mutating(piece: Column) -> Column:
    """One command without pipes. Assignments and words like sudo before it are skipped; an empty one counts as a change."""
    assignment, prefix = r"(?!-)\S*=\S*", r"(?:\S*/)?(?:" + "|".join(V.COMMAND_PREFIXES) + ")"
    bare = F.regexp_replace(F.trim(piece), rf"^(?:(?:{assignment}|{prefix})(?:\s+|$))+", "")
    t = F.filter(F.split(bare, r"\s+"), lambda x: x != "")
    name = F.element_at(F.split(F.get(t, F.lit(0)), "/"), -1)
    rest = F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
    return (
        F.when(F.size(t) == 0, True)
        .when((name == "sed") & F.exists(rest, lambda a: a.startswith("-i")), True)
        .when(name == "git", git_is_mutating(rest))
        .otherwise(~name.isin(*V.READONLY_COMMANDS))
    )


def shell_is_mutating(command: Column) -> Column:
    text = F.coalesce(command, F.lit(""))
    segments = F.filter(F.split(text, r"&&|\|\||;|\n"), lambda x: F.trim(x) != "")
    pieces = F.flatten(F.transform(segments, lambda x: F.split(x, r"\|")))
    return F.when(F.trim(text) == "", True).otherwise(F.exists(pieces, command_is_mutating))


def is_mutating(name: Column, command: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(low.isin(*V.MUTATING_TOOLS), True).when(low.isin(*V.SHELL_TOOLS), shell_is_mutating(command)).otherwise(False)
