"""Typed predicates on frontmatter values (Q1-Q27) and on records (D1-D16, D18) as Columns that are never null."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.functions.values import canonical, kind

DATE = r"^\d{4}-\d{2}-\d{2}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equal(v: Column, operand: Any) -> Column:
    """Typed equality: 1 is neither "1" nor 1.5."""
    return (v["kind"] == kind(operand)) & (v["json"] == canonical(operand))


def _micros(text: Column) -> Column:
    """Microseconds since 1970 in UTC of a date or date-time; null if it is neither."""
    day = F.datediff(F.try_to_date(text), F.lit("1970-01-01")).cast("bigint") * 86_400_000_000
    return F.when(text.rlike(DATE), day).when(text.rlike(DATE_TIME), F.unix_micros(F.try_to_timestamp(F.upper(text))))


def _day(micros: Column) -> Column:
    return F.floor(micros / 86_400_000_000)


def compare_dates(text: Column, operand: str, test, guard: bool = True) -> Column:
    """test on days for a date operand, on instants for a date-time one; then a mere date is no match if guarded."""
    value, other = _micros(text), _micros(F.lit(operand))
    if re.match(DATE, operand):
        return test(_day(value), _day(other))
    return test(value, other) & (text.rlike(DATE_TIME) if guard else F.lit(True))


def _is_date(x: Any) -> bool:
    return isinstance(x, str) and bool(re.match(DATE, x) or re.match(DATE_TIME, x))


ORDER = {
    "greaterThan": lambda a, b: a > b, "greaterThanOrEqual": lambda a, b: a >= b, "lessThan": lambda a, b: a < b, "lessThanOrEqual": lambda a, b: a <= b,
    "after": lambda a, b: a > b, "onOrAfter": lambda a, b: a >= b, "before": lambda a, b: a < b, "onOrBefore": lambda a, b: a <= b,
}
DATES = ("after", "onOrAfter", "before", "onOrBefore")
OPERATORS = ("equals", "doesntEqual", "includes", "notIncludes", "hasKey", "doesntHaveKey", "regex", "startsWith", "endsWith", "contains", "empty", "emptyString", "emptyArray", "emptyObject", "notEmpty", "in", "notIn", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual", *DATES, "between", "typeIs")


def field(entries: Column, key: str, operator: str, operand: Any = None) -> Column:
    """Whether a top-level key satisfies an operator. Only doesntHaveKey holds for an absent key; null is a value."""
    present = fm.has(entries, key)
    if operator == "hasKey":
        return present
    if operator == "doesntHaveKey":
        return ~present
    v = fm.entry(entries, key)
    k, text = v["kind"], v["text"]
    is_text, number = k == "string", F.when(k == "number", v["text"].cast("double"))
    blank = {"emptyString": is_text & (text == ""), "emptyArray": (k == "array") & (v["json"] == "[]"), "emptyObject": (k == "object") & (v["json"] == "{}")}
    any_blank = blank["emptyString"] | blank["emptyArray"] | blank["emptyObject"]
    if operator in blank:
        found = blank[operator]
    elif operator in ("empty", "notEmpty"):
        found = any_blank if operator == "empty" else ~_sure(any_blank)
    elif operator in ("equals", "doesntEqual"):
        found = equal(v, operand) if operator == "equals" else ~_sure(equal(v, operand))
    elif operator in ("includes", "notIncludes"):
        inside = F.array_contains(v["items"], canonical(operand))
        found = (k == "array") & (inside if operator == "includes" else ~_sure(inside))
    elif operator in ("in", "notIn"):
        member = F.lit(False)
        for x in operand:
            member = member | _sure(equal(v, x))
        found = member if operator == "in" else ~member
    elif operator == "regex":
        found = is_text & text.rlike(operand)
    elif operator in ("startsWith", "endsWith", "contains"):
        found = is_text & getattr(text, operator.lower())(operand)
    elif operator == "typeIs":
        found = k == operand
    elif operator in DATES:
        found = is_text & compare_dates(text, operand, ORDER[operator])
    elif operator in ORDER:
        found = ORDER[operator](number, F.lit(float(operand)))
    elif operator == "between":
        low, high = operand
        if _is_date(low):
            found = is_text & compare_dates(text, low, ORDER["onOrAfter"], False) & compare_dates(text, high, ORDER["onOrBefore"], False)
        else:
            found = number.between(float(low), float(high))
    else:
        raise ValueError(f"unknown operator {operator}")
    return present & _sure(found)


def glob(pattern: str, segment_exact: bool = False) -> str:
    """Regular expression of a record glob: * and ? stay in a segment, ** does not, and **/ is any characters.

    segment_exact lets **/ stand for whole segments only.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*" if segment_exact else ".*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def exclude_glob(pattern: str) -> str:
    """Regular expression of a command-line exclude: also classes, and **/ for whole segments; plain text is a prefix (IO2)."""
    if not re.search(r"[*?\[]", pattern):
        return r"\A" + re.escape(pattern.rstrip("/")) + r"(?:/|\z)"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("([^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return r"\A" + "".join(out) + r"\z"


def path_matches(path: Column, include: list[str], exclude: list[str] = (), segment_exact: bool = False) -> Column:
    """Any include (none: all) and no exclude; a record without a path never matches."""
    found = path.isNotNull()
    if include:
        found = found & path.rlike("|".join(glob(p, segment_exact) for p in include))
    if exclude:
        found = found & ~path.rlike("|".join(glob(p, segment_exact) for p in exclude))
    return _sure(found)


def n_lines(body: Column) -> Column:
    """Lines as parts between line feeds; an empty body has none."""
    return F.when(body == "", 0).otherwise(F.size(F.split(body, "\n", -1))).cast("bigint")


def n_words(body: Column) -> Column:
    """Words between white space, as rules count them."""
    return F.size(F.filter(F.split(body, r"(?U)\s+", -1), lambda x: x != "")).cast("bigint")


def n_words_explored(body: Column) -> Column:
    """Words between white space or punctuation, as exploring counts them."""
    return F.size(F.filter(F.split(body, r"[\s\p{Punct}\p{P}]+", -1), lambda x: x != "")).cast("bigint")


def within(n: Column, low: int | None, high: int | None) -> Column:
    return (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True))


def record(name: str, operand: Any) -> Column:
    """A record predicate over the columns of an analysis: path, modification_ts, body, headings, wikilinks."""
    path, body, headings = F.col("path"), F.col("body"), F.col("headings")
    filename = F.element_at(F.split(path, "/"), -1)
    found = {
        "pathRegex": lambda: path.rlike(operand), "filenameEquals": lambda: filename == operand, "extensionIn": lambda: fm.extension(path).isin([x.lower().lstrip(".") for x in operand]),
        "modifiedAfter": lambda: compare_dates(F.date_format("modification_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), operand, ORDER["after"]), "modifiedBefore": lambda: compare_dates(F.date_format("modification_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), operand, ORDER["before"]),
        "hasHeading": lambda: F.exists(headings, lambda h: h["text"] == operand), "hasHeadingAtLevel": lambda: F.exists(headings, lambda h: (h["level"] == operand[0]) & (h["text"] == operand[1])),
        "headingRegex": lambda: F.exists(headings, lambda h: h["text"].rlike(operand)), "hasSection": lambda: F.exists(headings, lambda h: (h["text"] == operand) & ~h["direct_empty"]),
        "bodyContains": lambda: body.contains(operand), "bodyRegex": lambda: body.rlike(operand),
        "hasWikilink": lambda: (F.size("wikilinks") > 0) if operand in (None, True) else F.exists("wikilinks", lambda w: w["target"] == operand),
        "lineCount": lambda: within(n_lines(body), *operand), "wordCount": lambda: within(n_words(body), *operand),
    }
    return _sure(found[name]())


STRUCTURAL = ("hasHeading", "hasHeadingAtLevel", "headingRegex", "hasSection")
