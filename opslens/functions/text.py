"""Text of log lines: search predicates, line normalisation, error keys, labels and templates."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- predicates
def contains_text(c: Column | str, needle: str) -> Column:
    """Case-insensitive substring; NULL stays NULL. '%' and '_' are ordinary characters."""
    return F.contains(F.lower(_col(c)), F.lower(F.lit(needle)))


def like_pattern(text: str, wildcard: bool = True) -> str:
    """LIKE pattern in which only '*' (when ``wildcard``) matches anything; escape is backslash."""
    escaped = re.sub(r"([\\%_])", r"\\\1", text)
    return escaped.replace("*", "%") if wildcard else escaped


def true_or_false(condition: Column) -> Column:
    """NULL counts as no match, so a negation keeps rows whose value is missing."""
    return F.coalesce(condition, F.lit(False))


def glob_regex(pattern: str) -> str:
    """Anchored, case-insensitive regex of a glob: '*', '?', [set]; '<n>'-like parts match any one path part."""
    out = []
    for token in re.findall(r"<[^>/]+>|\*+|\?|\[!?\]?[^\]]*\]|.", pattern, re.S):
        if len(token) > 2 and token[0] == "<":
            out.append(r"(?:<[^>/]+>|[^/]+)")
        elif token[0] == "*":
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif len(token) > 2 and token[0] == "[":
            body = token[1:-1].replace("\\", r"\\").replace("[", r"\[")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", r"\^", 1)
                              if body[0] == "^" else body) + "]")
        else:
            out.append(re.sub(r"([\\.^$|()+{}\[\]])", r"\\\1", token))
    return r"(?is)\A" + "".join(out) + r"\z"


def matches_any_glob(c: Column | str, globs: Sequence[str]) -> Column:
    """False for NULL and empty names, and when there is no pattern."""
    c = _col(c)
    hit = F.lit(False)
    for pattern in globs:
        hit = hit | c.rlike(glob_regex(pattern))
    return true_or_false((c != "") & hit)


# ---- lines of one kind
def trimmed(c: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def first_text(columns: Sequence[str]) -> Column:
    """The first of the columns with something in it, '' when none has."""
    return F.coalesce(*[trimmed(c) for c in columns], F.lit(""))


def cut_to(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; all of them for None."""
    return text if chars is None else F.left(text, F.lit(chars))


def grouping_line(text: Column, first_line: bool = False, chars: int | None = None) -> Column:
    """The text, or its first line, with runs of space folded; cut to ``chars`` first, if given."""
    head = F.split_part(text, F.lit("\n"), F.lit(1)) if first_line else text
    return F.trim(F.regexp_replace(cut_to(head, chars), r"\s+", " "))


def normalize_error(line: Column, chars: int | None = None) -> Column:
    """The line with stores, times and words holding digits replaced by placeholders.

    A line without a digit, a store or a placeholder stays as it is: patterns are tried only where they can match.
    """
    (store, name), *others = P.ERROR_VARIATIONS
    has_store = F.contains(line, F.lit(P.STORE_SUFFIX))
    varied = F.when(has_store, F.regexp_replace(line, store, name)).otherwise(line)
    for pattern, replacement in others:
        varied = F.regexp_replace(varied, pattern, replacement)
    may_vary = has_store | F.contains(line, F.lit("<*>")) | F.rlike(line, F.lit("[0-9]"))
    return cut_to(F.when(may_vary, varied).otherwise(line), chars)


def error_key(normalized: Column) -> Column:
    """The first words of a normalised line: lines that share them are one kind of error."""
    return F.substring_index(normalized, " ", P.KEY_WORDS)


def store_in(line: Column) -> Column:
    """The first store domain in a line without its suffix, NULL when there is none."""
    found = F.nullif(F.replace(F.regexp_extract(line, P.STORE, 0), F.lit(P.STORE_SUFFIX), F.lit("")), F.lit(""))
    return F.when(F.contains(line, F.lit(P.STORE_SUFFIX)), found)


def tenant_in(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, P.TENANT, 1), F.lit(""))


def code_location(cls: Column | None, method: Column | None = None, line: Column | None = None) -> Column:
    """'Class.method:line' from the parts that exist; NULL when there is nothing."""
    if cls is None:
        return F.lit(None).cast("string")
    parts = [F.regexp_replace(trimmed(cls), r"^.*[.$]", "")]
    # the first part after the class is joined by '.', the next by ':'
    for mark, part in zip((".", ":"), [p for p in (method, line) if p is not None]):
        parts.append(F.concat(F.lit(mark), trimmed(part)))
    return F.nullif(F.concat_ws("", *parts), F.lit(""))


def shared_words(low: Column, high: Column) -> Column:
    """How many first words the smallest and the largest word list share, and so all lists between them."""
    both = F.zip_with(low, F.slice(high, F.lit(1), F.size(low)), lambda a, b: a.eqNullSafe(b))
    gap = F.array_position(both, F.lit(False)).cast("int")
    return F.when(gap == 0, F.least(F.size(low), F.size(high))).otherwise(gap - 1)


def error_label(exception: Column, text: Column) -> Column:
    """Short exception name in front, Java packages dropped, a prefix written twice written once."""
    exception, text = F.coalesce(exception, F.lit("")), F.coalesce(text, F.lit(""))
    short = F.regexp_extract(exception, r"[^.]*$", 0)
    named = (F.when(exception == "", text)
             .when(F.startswith(text, exception), F.concat(short, F.substring(text, F.length(exception) + 1,
                                                                              F.length(text))))
             .when(F.contains(text, exception), text)
             .when(text == "", short)
             .otherwise(F.concat_ws(": ", short, text)))
    without_packages = F.regexp_replace(named, r"\b(?:[a-z_][a-z0-9_]*\.){2,}([A-Z][\w$]*)", "$1")
    return F.regexp_replace(without_packages, r"^([^:]{3,60}:)\1+", "$1")


def error_text(msg: Column, body: Column, raw: Column, exception: Column, chars: int | None = None) -> Column:
    """An error's text without the stack trace; beyond ``chars`` characters, if given, an ellipsis stands for the rest."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    said = strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in (msg, body, raw)], F.lit("")))
    named = strip(F.coalesce(exception, F.lit("")))
    text = (F.when(F.contains(said, named), said).when(said == "", named)
            .otherwise(F.concat_ws(": ", named, said)))
    text = F.regexp_replace(text, r"\n\s*at [\w$.<>]+\((?s:.*)$", "")
    text = strip(F.regexp_replace(text, r"[ \t]+", " "))
    return text if chars is None else F.concat(cut_to(text, chars), F.when(F.length(text) > chars, "…").otherwise(""))
