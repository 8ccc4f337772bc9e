"""Naming conventions: mechanical rewriting, constraint checks, and screening of user-supplied patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Automaton, Unsupported, automaton

#: Groups of rules and their options; those in PROMPT_ONLY are for a grouper to follow.
RULES = {
    "leading_articles": ("strip",),
    "corporate_suffix": ("strip", "normalize"),
    "ampersand": ("keep", "spell_out", "drop"),
    "abbreviation": ("expand", "short"),
    "numbers": ("digits", "spell_out"),
    "case": ("lower", "upper", "title"),
    "acronyms": ("force_caps", "follow_case"),
    "spaces": ("allow", "underscore", "hyphen", "concatenate"),
    "special_chars": ("allow_all", "alnum_periods", "alnum_spaces", "alnum_underscore", "alnum_only"),
    "trailing_punct": ("strip",),
    "word_count": ("single", "max"),
    "length": ("min", "max", "range"),
}
PROMPT_ONLY = {"abbreviation", "numbers"}
PARAMETERS = {("word_count", "max"): ("n",), ("length", "min"): ("min",), ("length", "max"): ("max",), ("length", "range"): ("min", "max")}
#: Suffixes that are dropped, and words with a standard form.
SUFFIXES = ("incorporated", "inc", "corporation", "corp", r"l\.?l\.?c", r"l\.?l\.?p", r"p\.?l\.?c", r"l\.?p", "limited", "ltd", "gmbh", "ag", r"s\.?a", r"n\.?v", r"b\.?v", "pty", "plc")
STANDARD = {"incorporated": "Inc.", "corporation": "Corp.", "limited": "Ltd.", "company": "Co."}
#: What the rules for articles, ampersands and trailing punctuation match.
ARTICLE, AMPERSAND, TRAILING = r"(?i)^(?:the|an?)\s+", r"\s*&\s*", r"[^\p{L}\p{N})\]]+$"
ALLOWED = {"alnum_periods": "A-Za-z0-9.", "alnum_spaces": "A-Za-z0-9 ", "alnum_underscore": "A-Za-z0-9_", "alnum_only": "A-Za-z0-9"}
JOINED = {"underscore": "_", "hyphen": "-", "concatenate": ""}
LONGEST_NAME = 200


def clean_rules(rules: dict | None) -> dict:
    """Known groups and options only; parameters as positive whole numbers."""
    out = {}
    for group, options in RULES.items():
        given = (rules or {}).get(group)
        value = given.get("value") if isinstance(given, dict) else given
        if value not in options:
            continue
        numbers = {}
        for name in PARAMETERS.get((group, value), ()):
            try:
                number = int(float(given[name]))
            except (TypeError, KeyError, ValueError):
                continue
            if number > 0:
                numbers[name] = number
        out[group] = {"value": value, **numbers}
    return out


def has_rules(rules: dict | None) -> bool:
    return any(r.get("value") for r in (rules or {}).values())


def steps(rules: dict) -> list[tuple[str, str, str]]:
    """The mechanical rules as an ordered list of (kind, pattern, replacement). Kinds: replace, repeat and case."""
    of = lambda group: (rules.get(group) or {}).get("value")
    out = [("replace", r"^\s+|\s+$", "")]
    if of("leading_articles") == "strip":
        out.append(("replace", ARTICLE, ""))
    if of("corporate_suffix") == "strip":
        out.append(("replace", rf"(?i)(?:[\s,]+(?:{'|'.join(SUFFIXES)})\.?\s*)+$", ""))
    elif of("corporate_suffix") == "normalize":
        out += [("replace", rf"(?i)\b{word}\b\.?", short) for word, short in STANDARD.items()]
    if of("ampersand") in ("spell_out", "drop"):
        out.append(("replace", AMPERSAND, " and " if of("ampersand") == "spell_out" else " "))
    if of("case") or of("acronyms") == "force_caps":
        out.append(("case", of("case") or "", of("acronyms") or ""))
    out.append(("replace", r"\s+", JOINED.get(of("spaces"), " ")))
    if of("special_chars") in ALLOWED:
        out.append(("replace", f"[^{ALLOWED[of('special_chars')]}]", ""))
    if of("trailing_punct") == "strip":
        out.append(("replace", TRAILING, ""))
    return [*out, ("replace", r"^\s+|\s+$", "")]


TOKEN = r"[\s\-_]+|[^\s\-_]+"


def case_token(token: str, case: str, acronyms: str) -> str:
    if acronyms == "force_caps" and len(token) > 1 and re.search("[A-Z]", token) and token == token.upper():
        return token
    return {"lower": str.lower, "upper": str.upper, "title": lambda t: t[:1].upper() + t[1:].lower()}.get(case, str)(token)


def apply_rules(name: str | None, rules: dict | None) -> str | None:
    import regex

    if not rules or not name:
        return name
    for kind, first, second in steps(clean_rules(rules)):
        if kind == "replace":
            name = regex.sub(first, lambda _, s=second: s, name)
        else:
            name = re.sub(TOKEN, lambda m, c=first, a=second: case_token(m[0], c, a), name)
    return name


def _case(value: Column, case: str, acronyms: str) -> Column:
    def one(token: Column) -> Column:
        cased = {"lower": F.lower(token), "upper": F.upper(token), "title": F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substring(token, 2, 1_000_000)))}.get(case, token)
        caps = (F.length(token) > 1) & token.rlike("[A-Z]") & (token == F.upper(token))
        return F.when(caps, token).otherwise(cased) if acronyms == "force_caps" else cased

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(f"({TOKEN})"), 1), one), "")


def apply_rules_column(name: Column, rules: dict) -> Column:
    """apply_rules as built-in expressions."""
    return reduce(lambda value, s: F.regexp_replace(value, s[1], s[2]) if s[0] == "replace" else _case(value, s[1], s[2]), steps(clean_rules(rules)), name)


def limits(rules: dict) -> list[tuple[str, str, int]]:
    """(what, how, number) of each constraint; what is words or length, how is over or under."""
    rules = clean_rules(rules)
    words, length = rules.get("word_count", {}), rules.get("length", {})
    out = []
    if words.get("value") == "single":
        out.append(("words", "over", 1))
    elif words.get("n"):
        out.append(("words", "over", words["n"]))
    if length.get("value") != "range" or {"min", "max"} <= length.keys():
        out += [("length", how, length[name]) for name, how in (("min", "under"), ("max", "over")) if name in length]
    return out


def violations(name: str | None, rules: dict | None) -> list[str]:
    """Codes of what is wrong with a name: empty, no_content, form, words_over, length_over, length_under."""
    if not rules:
        return []
    if not name or not name.strip():
        return ["empty"]
    written = apply_rules(name, rules)
    out = ["no_content"] if not written else ["form"] if written != name else []
    size = {"words": len(name.split()), "length": len(name.encode("utf-16-le")) // 2}
    return out + [f"{what}_{how}" for what, how, n in limits(rules) if (size[what] > n if how == "over" else size[what] < n)]


def violations_column(name: Column, rules: dict) -> Column:
    """violations as array<string> of built-in expressions; lengths in code points."""
    written = apply_rules_column(name, rules)
    size = {"words": F.size(F.regexp_extract_all(name, F.lit(r"(\S+)"), 1)), "length": F.length(name)}
    checks = [F.when(written == "", "no_content").when(written != name, "form")]
    checks += [F.when(size[what] > n if how == "over" else size[what] < n, f"{what}_{how}") for what, how, n in limits(rules)]
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*checks)))


def describe(rules: dict | None) -> list[str]:
    """A line of instruction for each rule, for a grouper that reads text."""
    return [f"{group.replace('_', ' ')}: {r['value'].replace('_', ' ')}" + "".join(f", {k} {v}" for k, v in r.items() if k != "value") for group, r in clean_rules(rules).items()]


UNSAFE = (("look-around", r"\(\?<?[=!]"), ("back reference", r"\\[1-9]|\\k<|\(\?P="), ("atomic group", r"\(\?>"), ("conditional", r"\(\?\("), ("possessive", r"[*+?}]\+"))


def pattern_error(pattern: str) -> str | None:
    """Why a pattern can't be enforced safely; None if it can."""
    bare = re.sub(r"\\\\|\[(?:\\.|[^\]\\])*\]", "", pattern)  # without escaped backslashes and sets
    for what, shape in UNSAFE:
        if re.search(shape, bare):
            return f"{what} is not supported"
    try:
        re.compile(pattern)
    except re.error as e:
        return f"not a valid pattern: {e}"
    return "a repeated group may not repeat or choose inside" if backtracks(pattern) else None


def backtracks(pattern: str) -> bool:
    """Whether a repeated group holds a repetition or a choice. Exact counts such as {3} don't count as repeating."""
    from re import _constants as c
    from re import _parser as parser

    try:
        parsed = parser.parse(pattern)
    except re.error:
        return False

    def inner(items) -> bool:
        """A choice or an inexact repetition anywhere below."""
        for op, arg in items:
            if op is c.BRANCH or (op in (c.MAX_REPEAT, c.MIN_REPEAT) and repeats(arg)):
                return True
            if any(inner(x) for x in children(op, arg)):
                return True
        return False

    def repeats(arg) -> bool:
        return arg[1] > 1 and arg[0] != arg[1]

    def children(op, arg) -> list:
        if op is c.SUBPATTERN:
            return [arg[3]]
        if op is c.BRANCH:
            return arg[1]
        return [arg[2]] if op in (c.MAX_REPEAT, c.MIN_REPEAT) else []

    def grouped_choice(items) -> bool:
        """The parser folds (a|b) into a set; the text is what tells."""
        return any(op is c.SUBPATTERN and any(o is c.IN for o, _ in arg[3]) for op, arg in items) and "|" in re.sub(r"\\.|\[[^\]]*\]", "", pattern)

    def bad(items) -> bool:
        for op, arg in items:
            if op in (c.MAX_REPEAT, c.MIN_REPEAT) and repeats(arg) and any(o is c.SUBPATTERN for o, _ in arg[2]) and (inner(arg[2]) or grouped_choice(arg[2])):
                return True
            if any(bad(x) for x in children(op, arg)):
                return True
        return False

    return bad(parsed)


def compile_pattern(pattern: str) -> Automaton | None:
    """Matches whole names, in time that grows with the name alone; None if the pattern can't be enforced."""
    if pattern_error(pattern):
        return None
    try:
        return automaton(pattern)
    except Unsupported:
        return None


def matches(compiled: Automaton | None, name: str) -> bool:
    if compiled is None:
        return True
    return 0 < len(name) <= LONGEST_NAME and compiled.fullmatch(name)


def matches_column(name: Column, pattern: str) -> Column:
    compiled = compile_pattern(pattern)
    if compiled is None:
        return F.lit(True)
    return F.when((F.length(name) > 0) & (F.length(name) <= LONGEST_NAME), compiled.matches(name)).otherwise(False)


#: Limits of a specification.
MOST = {"description": 1000, "rules": 20, "rule": 500, "regex": 500, "text": 2000, "seeds": 500, "seed": 200}


def spec_errors(spec: dict) -> list[str]:
    """What is wrong with a column specification. Nothing is ever cut to fit."""
    out = []
    description = (spec.get("description") or "").strip()
    if not description:
        out.append("description is required")
    if len(description) > MOST["description"]:
        out.append("description is too long")
    rules = spec.get("standardization_rules") or []
    if len(rules) > MOST["rules"] or any(not str(r).strip() or len(r) > MOST["rule"] for r in rules):
        out.append("too many rules, or one is empty or too long")
    kind, value = spec.get("convention_type"), spec.get("convention_value") or ""
    if kind == "regex" and (len(value) > MOST["regex"] or pattern_error(value)):
        out.append(f"convention: {pattern_error(value) or 'the pattern is too long'}")
    if kind == "text" and len(value) > MOST["text"]:
        out.append("convention: the text is too long")
    seeds = spec.get("seeds") or []
    if len(seeds) > MOST["seeds"] or any(not s.strip() or len(s) > MOST["seed"] for s in seeds):
        out.append("too many seeds, or one is empty or too long")
    return out
