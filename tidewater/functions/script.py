"""Where a page's scripts lead at once: a lexer for what is code in a script, and assignments to location outside event handlers."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import urljoin

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.I | re.S)
#: A slash begins a regular expression after one of these, or at the start; elsewhere it divides.
_BEFORE_PATTERN = set("=(,;:!&|?{}[]+-*%<>~^")
_WORD_BEFORE_PATTERN = re.compile(r"(?:return|typeof|case|in|of|delete|void|throw|new|else|do)\s*$")
_FUNCTION = r"(?:async\s*)?(?:function\b[^{]*|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)\s*\{"
#: How a handler of an event begins, up to the brace of its body.
_HANDLER = re.compile(rf"(?:(?:addEventListener|\.(?:on|one|bind|live|delegate))\s*\(\s*['\"`][^'\"`]+['\"`]\s*,|\bon[a-z]+\s*=)\s*{_FUNCTION}", re.I)
_OF_EVENT = re.compile(r"\bfunction\s*\([^)]*\b(?:e|ev|evt|event)\b[^)]*\)\s*$", re.I)
_GOING = re.compile(r"(?:window\.|document\.|top\.|self\.|parent\.)?location(?:\.href|\.replace|\.assign)?\s*(?:=|\()\s*(['\"`])([^'\"`]+)\1", re.I)
_PLACEHOLDER = re.compile(r"\$\{|\{\{[^}]*\}\}|%24%7B|%7B[^/]*%7D", re.I)


class Lexed(NamedTuple):
    """A script with its comments blanked, and where each brace of its code closes."""

    text: str
    closing: dict[int, int]


def lex(js: str) -> Lexed:
    """Strings, templates with code inside, regular expressions and comments are told from code."""
    out, closing, open_, templates = list(js), {}, [], []
    at, n, last = 0, len(js), ""  # last: the last character of code that is no space
    while at < n:
        c = js[at]
        if c in "\"'":
            at, last = _string_end(js, at), c
        elif c == "`":
            at = _template(js, at + 1, open_, templates)
            last = c
        elif c == "/" and js[at + 1 : at + 2] in ("/", "*"):
            line = js[at + 1] == "/"
            end = js.find("\n" if line else "*/", at + 2)
            end = n if end < 0 else end + (0 if line else 2)
            out[at:end] = [x if x == "\n" else " " for x in out[at:end]]
            at = end
        elif c == "/" and (not last or last in _BEFORE_PATTERN or _WORD_BEFORE_PATTERN.search(js, max(0, at - 12), at)) and (end := _pattern_end(js, at)) > 0:
            at, last = end, "/"
        elif c == "{":
            open_.append(at)
            at, last = at + 1, c
        elif c == "}":
            if open_:
                opened = open_.pop()
                closing[opened] = at
                if templates and templates[-1] == opened:
                    templates.pop()
                    at, last = _template(js, at + 1, open_, templates), "`"
                    continue
            at, last = at + 1, c
        else:
            if not c.isspace():
                last = c
            at += 1
    return Lexed("".join(out), closing)


def _string_end(js: str, at: int) -> int:
    """The place after the string that begins at `at`; a line's end ends it too."""
    quote, at = js[at], at + 1
    while at < len(js) and js[at] != quote and js[at] != "\n":
        at += 2 if js[at] == "\\" else 1
    return at + 1


def _template(js: str, at: int, open_: list[int], templates: list[int]) -> int:
    """The place after the template's end, or after the `${` of code inside it, whose brace is noted."""
    while at < len(js):
        if js[at] == "\\":
            at += 2
        elif js[at] == "`":
            return at + 1
        elif js.startswith("${", at):
            open_.append(at + 1)
            templates.append(at + 1)
            return at + 2
        else:
            at += 1
    return at


def _pattern_end(js: str, at: int) -> int:
    """The place after the regular expression that begins at `at`; -1 if its line has no end of it."""
    at, in_class = at + 1, False
    while at < len(js) and js[at] != "\n":
        if js[at] == "\\":
            at += 1
        elif js[at] == "[":
            in_class = True
        elif js[at] == "]":
            in_class = False
        elif js[at] == "/" and not in_class:
            return at + 1
        at += 1
    return -1


def at_once(js: str) -> str:
    """The script without comments and without the bodies of event handlers; overlapping ones are merged."""
    text, closing = lex(js)
    bodies = sorted((m.end(), closing[m.end() - 1]) for m in _HANDLER.finditer(text) if m.end() - 1 in closing)
    # functions of an event that nothing names as handlers
    bodies += [(opened + 1, end) for opened, end in closing.items() if _OF_EVENT.search(text, max(0, opened - 400), opened)]
    kept, at = [], 0
    for start, end in sorted(bodies):
        if end > at:
            kept.append(text[at:start] if start > at else "")
            at = max(at, end)
    return "".join([*kept, text[at:]])


def redirect(page: str | None, base: str | None) -> str | None:
    """The address, as written, that a script of the page goes to at once; not the page's own."""
    if not page or "location" not in page.lower():
        return None
    for script in _SCRIPT.finditer(_COMMENT.sub("", page)):
        if "location" not in script[1].lower():
            continue
        for m in _GOING.finditer(at_once(script[1])):
            target = m[2].strip()
            if not target or target.startswith("#") or target.lower().startswith("javascript:") or _PLACEHOLDER.search(target):
                continue
            try:
                if base and urljoin(base, target) == base:
                    continue
            except ValueError:
                continue
            return target
    return None
