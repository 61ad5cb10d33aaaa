"""Patterns in RE2 syntax for Java's engine."""

from __future__ import annotations

import re

MAX_BYTES = 256
_REFUSED = re.compile(r"\\[1-9]|\\[kGZRXHhN]|\\C|\(\?(?:=|!|<=|<!|>|P=)|[*+?}]\+")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_PROPERTY = re.compile(r"\\([pP])\{(\^?)(\w+)\}")
_REPEAT = re.compile(r"\{\d+(,\d*)?\}")
_QUOTED = re.compile(r"\\Q(.*?)(?:\\E|\Z)", re.S)
_SPECIAL = set(r"\^$.|?*+()[]{}&-~#")

#: The ASCII classes of RE2 as members of a Java class.
_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}


def checked(pattern: str) -> str:
    """The pattern, if Java can be made to match what RE2 would; else ValueError."""
    if len(pattern.encode()) > MAX_BYTES:
        raise ValueError(f"the pattern has over {MAX_BYTES} bytes")
    if _REFUSED.search(re.sub(r"\\\\", "", _QUOTED.sub("", pattern))):
        raise ValueError("back references, look-around, possessive repeats and \\C are not supported")
    to_java(pattern, check=False)
    return pattern


def _escape(pattern: str, i: int, in_class: bool) -> tuple[str, int]:
    """What stands for the escape at i, and its length."""
    prop = _PROPERTY.match(pattern, i)
    if prop:
        negated = (prop[1] == "P") != bool(prop[2])
        name = prop[3] if len(prop[3]) <= 2 else f"Is{prop[3]}"
        return rf"\{'P' if negated else 'p'}{{{name}}}", len(prop[0])
    pair = pattern[i : i + 2]
    if len(pair) < 2:
        raise ValueError("the pattern ends in a backslash")
    space = {r"\s": r"\t\n\f\r ", r"\v": r"\x0B", r"\S": r"^\t\n\f\r "}
    if pair == r"\S":
        return f"[{space[pair]}]", 2
    if pair in space:
        return space[pair] if in_class or pair == r"\v" else f"[{space[pair]}]", 2
    return pair, 2


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The bracket class at i in Java's syntax, and where it ends. There brackets, && and # mean more than in RE2."""
    out, start = ["["], i + 1
    i = start
    if pattern[i : i + 1] == "^":
        out.append("^")
        i, start = i + 1, i + 1
    while i < len(pattern):
        c, posix = pattern[i], _POSIX.match(pattern, i)
        if posix:
            if posix[2] not in _CLASSES:
                raise ValueError(f"unknown class {posix[2]}")
            name = _CLASSES[posix[2]]
            out.append(name[0] + name[1].upper() + name[2:] if posix[1] else name)
            i += len(posix[0])
        elif c == "\\":
            made, n = _escape(pattern, i, True)
            out.append(made)
            i += n
        elif c == "]" and i > start:
            return "".join(out) + "]", i + 1
        else:
            out.append(f"\\{c}" if c in "[]&#~" or (c == "^" and i > start) else c)
            i += 1
    raise ValueError("a class isn't closed")


def to_java(pattern: str, check: bool = True) -> tuple[str, list[tuple[str, int]]]:
    """The pattern for Java and its named groups with their numbers.

    Names go (Java allows fewer), `$` outside a class means the very end unless (?m) is set, `.` leaves out only line
    feeds, `\\s` has no vertical tab, (?i) folds all letters, and a brace that isn't a repeat is a character. (?U),
    which turns greed around, is refused."""
    if check:
        checked(pattern)
    out, names, group, depth, i = [], [], 0, 0, 0
    lines = False
    while i < len(pattern):
        c = pattern[i]
        named, flags, quoted = _NAMED.match(pattern, i), _FLAGS.match(pattern, i), _QUOTED.match(pattern, i)
        if quoted:
            out.append("".join(f"\\{x}" if x in _SPECIAL else x for x in quoted[1]))
            i += len(quoted[0])
        elif c == "\\":
            made, n = _escape(pattern, i, False)
            out.append(made)
            i += n
        elif c == "[":
            made, i = _class(pattern, i)
            out.append(made)
        elif named:
            group, depth = group + 1, depth + 1
            names.append((named[1], group))
            out.append("(")
            i += len(named[0])
        elif flags:
            on, off = flags[1], flags[2] or ""
            if set(on + off.lstrip("-")) - set("ims"):
                raise ValueError("only the flags i, m and s are supported")
            lines = "m" in on or (lines and "m" not in off)
            depth += flags[3] == ":"
            out.append(f"(?{on.replace('i', 'iu')}{off.replace('i', 'iu')}{flags[3]}")
            i += len(flags[0])
        else:
            group += c == "(" and pattern[i + 1 : i + 2] != "?"
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise ValueError("a group is closed that isn't open")
            if c == "{" and not _REPEAT.match(pattern, i):
                c = r"\{"
            out.append(r"\z" if c == "$" and not lines else c)
            i += 1
    if depth:
        raise ValueError("a group isn't closed")
    return "(?d)" + "".join(out), names
