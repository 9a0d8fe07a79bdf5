"""Regular expressions of the search language (linear-time ones, without look-around and back references) in Java's dialect."""

from __future__ import annotations

import re

# Classes by their POSIX names, escapes that mean the same in both dialects, and what others become.
POSIX = {n.lower(): rf"\p{{{n}}}" for n in ("Alnum", "Alpha", "ASCII", "Blank", "Cntrl", "Digit", "Graph", "Lower", "Print", "Punct", "Space", "Upper", "XDigit")} | {"word": r"\w"}
SAME = frozenset("aftnrx01234567dDwWAzbB")
SPACES = r"\t\n\f\r "
_CATEGORY = re.compile(r"[CLMNPSZ][a-z]?")
_PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))")
_FLAGS = re.compile(r"\(\?([ims]*)(?:-([ims]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


class _Bad(ValueError):
    pass


def _property(m: re.Match) -> str:
    name, letter = m[3] or m[4], m[1]
    if m[2]:
        letter = "P" if letter == "p" else "p"
    return rf"\{letter}{{{name if _CATEGORY.fullmatch(name) else 'Is' + name}}}"


def _escape(p: str, at: int, in_class: bool) -> tuple[str, int]:
    """What the escape at a place becomes, and where the next thing begins."""
    c = p[at + 1 : at + 2]
    if c in ("p", "P"):
        m = _PROPERTY.match(p, at)
        if m is None:
            raise _Bad
        return _property(m), m.end()
    if c in ("s", "S"):
        inner = SPACES if c == "s" else f"^{SPACES}"
        return (SPACES if in_class and c == "s" else f"[{inner}]"), at + 2
    if c == "v":
        return r"\x0B", at + 2
    if not c or c.isalnum() and (c not in SAME or c in "123456789" and not re.match(r"[0-7]{3}", p[at + 1 : at + 4])):
        raise _Bad
    if c in "1234567":
        return r"\0" + p[at + 1 : at + 4], at + 4
    if in_class and c in "AzbB":
        raise _Bad
    return p[at : at + 2], at + 2


def _class(p: str, at: int) -> tuple[str, int]:
    out, at = "[", at + 1
    if p[at : at + 1] == "^":
        out, at = out + "^", at + 1
    first = True
    while at < len(p):
        c = p[at]
        if c == "]" and not first:
            return out + "]", at + 1
        first = False
        if c == "[" and p[at + 1 : at + 2] == ":" and (end := p.find(":]", at + 2)) > 0:
            name = p[at + 2 : end]
            known = POSIX.get(name.removeprefix("^"))
            if known is None:
                raise _Bad
            out += known.replace(r"\p", r"\P").replace(r"\w", r"\W") if name.startswith("^") else known
            at = end + 2
        elif c == "\\":
            made, at = _escape(p, at, True)
            out += made
        else:
            # what Java reads as nested classes, intersections and comments
            out += "\\" + c if c in "[]&#~" else c
            at += 1
    raise _Bad


def to_java(pattern: str) -> str | None:
    """The pattern for java.util.regex (with (?d)), or None where it is none of the language."""
    out, at, lines = [], 0, re.search(r"\(\?[is]*m", pattern) is not None
    p = pattern
    try:
        while at < len(p):
            c = p[at]
            if p.startswith("\\Q", at):
                end = p.find("\\E", at)
                out += [re.escape(x) if x.isascii() else x for x in p[at + 2 : end if end >= 0 else len(p)]]
                at = end + 2 if end >= 0 else len(p)
            elif c == "\\":
                made, at = _escape(p, at, False)
                out.append(made)
            elif c == "[":
                made, at = _class(p, at)
                out.append(made)
            elif p.startswith("(?", at):
                m = _FLAGS.match(p, at) or _NAMED.match(p, at)
                if m is None:
                    raise _Bad
                out.append(f"(?<{m[1]}>" if m.re is _NAMED else m[0])
                at = m.end()
            elif c in "*+?}" and p[at + 1 : at + 2] in ("+", "*"):
                raise _Bad
            else:
                # the end of the text, and not before a last line feed as well
                out.append(r"\z" if c == "$" and not lines else c)
                at += 1
    except _Bad:
        return None
    made = "".join(out)
    # brackets, repeats and bounds are checked by a dialect that is at hand
    plain = re.sub(r"\\[pP]\{\w+\}", r"\\w", made)
    plain = re.sub(r"\(\?[ims]*(?:-[ims]+)?([:)])", lambda m: "(?:" if m[1] == ":" else "(?:)", plain).replace("(?<", "(?P<").replace(r"\z", r"\Z")
    try:
        re.compile(plain)
    except (re.error, OverflowError, RecursionError):
        return None
    return made
