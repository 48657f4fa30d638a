"""Predicates over identifiers, paths and partitions, compiled to Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_WIDTH = 6


def widen_id(pattern: str, width: int = ID_WIDTH) -> str:
    """An identifier pattern in upper case, its first + or * stretched to dots that fill the width."""
    pattern = pattern.upper()
    at = re.search(r"[+*]", pattern)
    return pattern[: at.start()] + "." * max(0, width - len(pattern) + 1) + pattern[at.end() :] if at else pattern


def id_matches(ident: Column, pattern: str) -> Column:
    """Equal in length and in each character; a dot on either side stands for any."""
    return F.upper(ident).rlike("^" + "".join("." if c == "." else f"[{re.escape(c)}.]" for c in widen_id(pattern)) + r"\z")


def id_in(ident: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (id_matches(ident, p) for p in patterns), F.lit(False))


def excluded(included: Column, in_exclude: Column, has_includes: bool, include_first: bool = False) -> Column:
    """Whether a row is left out, given whether it matches the include and the exclude list.

    By default excludes win and an include list admits only what it names; with
    include_first, an include list merely shields what it names from the excludes.
    """
    wanted = included if has_includes else F.lit(False)
    if include_first:
        return ~wanted & in_exclude
    return in_exclude | (~wanted if has_includes else F.lit(False))


def first_rule(rules: Sequence[tuple[str, Column]], default: bool) -> Column:
    """The sign (+ true, - false) of the first rule whose condition holds, else default."""
    out = F.lit(default)
    for sign, holds in reversed(rules):
        out = F.when(holds, F.lit(sign == "+")).otherwise(out)
    return out


def id_rules(ident: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered rules (sign, prefix pattern); without a match a row stays if there are no rules or the last is a minus."""
    conditions = [(s, F.upper(ident).rlike("^" + "".join("." if c == "." else re.escape(c) for c in p.upper()))) for s, p in rules]
    return first_rule(conditions, not rules or rules[-1][0] == "-")


def glob_regex(glob: str) -> str | None:
    """A Java regular expression for a path glob; None: matches everything.

    `*` stays within a path component, `**` doesn't, `?` is one character of a
    component, `#` a number, a space one white-space character, `[+x]` and `[*x]` a
    class once or more or any number of times, `{a,b}` alternatives, `$` at the end
    the end of the text. A leading slash anchors the start; else the glob must fit a suffix.
    """
    if not glob:
        return None
    anchored, ends = glob.startswith("/"), glob.endswith("$")
    body = glob[1:] if anchored else glob
    out, depth, at = "", 0, 0
    while at < len(body):
        c = body[at]
        if body.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "[" and (close := body.find("]", at + 1)) > 0:
            inner = body[at + 1 : close]
            negated = inner.startswith("^")
            inner = inner[negated:]
            times = inner[0] if inner[:1] in ("+", "*") else ""
            inner = inner[len(times) :].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, at = out + "[" + "^" * negated + inner + "]" + times, close + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "$" and at == len(body) - 1:
            out += r"(?:\$|(?=\z))"
        else:
            out += {"*": "[^/]*", "?": "[^/]", "#": "[0-9]+", " ": r"[\x01-\x20]"}.get(c) or re.escape(c)
        at += 1
    if anchored:
        return rf"(?s)\A(?:{out})" + (r"\z" if ends else "")
    return rf"(?s)(?=.)(?:{out})\z"


def glob_matches(path: Column, glob: str) -> Column:
    regex = glob_regex(glob)
    return F.lit(True) if regex is None else path.rlike(regex)


def path_rules(path: Column, rules: Sequence[tuple[str, int, str]], negate: bool = False) -> Column:
    """Ordered rules (sign, skip, glob). skip 0: the first match decides.

    A + rule that skips n passes over the next n rules where its glob matches, a -
    rule that skips where it doesn't. Without a decision, the opposite of the last
    deciding rule's sign holds. negate turns the result.
    """
    deciding = [s for s, skip, _ in rules if not skip]
    nodes: list[Column] = [F.lit(bool(deciding) and deciding[-1] == "-" or not deciding)]
    for sign, skip, glob in reversed(rules):
        hit = glob_matches(path, glob)
        if skip:
            jump = nodes[-1 - min(skip, len(nodes) - 1)]
            nodes.append(F.when(hit if sign == "+" else ~hit, jump).otherwise(nodes[-1]))
        else:
            nodes.append(F.when(hit, F.lit(sign == "+")).otherwise(nodes[-1]))
    return ~nodes[-1] if negate else nodes[-1]


def select_parts(rules: Sequence[tuple[str, Column | None, Column]]) -> Column:
    """Ordered rules (sign, applicable or None for always, condition); rules that don't apply are passed over.

    The first that applies and holds decides; else the opposite of the last that applies; else true.
    """
    default = F.lit(True)
    for sign, applies, _ in rules:
        default = F.lit(sign == "-") if applies is None else F.when(applies, F.lit(sign == "-")).otherwise(default)
    out = default
    for sign, applies, holds in reversed(rules):
        out = F.when(holds if applies is None else applies & holds, F.lit(sign == "+")).otherwise(out)
    return out


def in_range(value: Column, text: str, least: int, most: int) -> Column:
    """value lies in a range `a`, `a-b`, `-b` or `a-`, clamped to [least, most]; a reversed range holds nothing."""
    a, dash, b = text.partition("-")
    low = max(int(a), least) if a else least
    high = min(int(b) if b else (most if dash else int(a)), most)
    return value.between(low, high)


