"""Assignment-aware lexing: a text as name-literal pairs.

``assignments`` reads source or configuration once, from left to right, and
gives what each name is set to. It knows

* names: bare and dotted ones, quoted keys, subscripts (``held["name"] =``),
  typed names (``name: str =``, ``name string =``), XML elements with or without
  attributes, XML and JSON pairs of ``key`` / ``name`` and ``value``;
* literals: strings of one or three quotes and backticks, with prefixes, bare
  words, escaped strings inside strings, YAML blocks (``|``, ``>``) and anchors,
  on the next line, in parentheses, in lists, and as arguments of calls;
* what joins them: ``+``, ``.``, strings side by side;
* references: names, ``$NAME``, ``${NAME}``, ``*anchor``, ``held["name"]``;
* nesting: brackets, YAML indentation and ``[section]`` headers. A name that says
  nothing (``value``, ``default``) stands for the one above it.

A string is read again for pairs inside it, and a comment is read like code: a
password that is commented out has leaked all the same. Every pattern is
possessive or stops at the end of its line, string or element, so the work grows
with the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

#: Names that stand for the one above them, and names whose value is a name.
GENERIC = frozenset({"value", "val", "default", "content", "data", "text", "string", "raw", "plain"})
LABEL = frozenset({"key", "name", "id", "property"})
#: Calls that look their first argument up; later ones are defaults.
LOOKUP = re.compile(r"(?i)get|env|prop|config|setting|param|read|load|fetch|find|lookup|prompt|input|pass\Z")

STRING = (r'(?<![\w\\])[rRbBuUfF@]{0,2}(?:"""(?P<t1>(?:[^"\\]++|\\.|"(?!""))*+)"""|\'\'\'(?P<t2>(?:[^\'\\]++|\\.|\'(?!\'\'))*+)\'\'\''
          r'|"(?P<dq>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|\'(?P<sq>[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+)\'|`(?P<bt>[^`]*+)`)')
QUOTES = ("t1", "t2", "dq", "sq", "bt")
SIGN = r"(?::=|=>|[:=](?![:=]))"
TYPE = (r"(?:[ \t]*:[ \t]*(?P<type>[A-Za-z_&*][A-Za-z0-9_.<>\[\]|?&*]*+(?:[ ][A-Za-z0-9_.<>\[\]|?&*]++)*+)(?=[ \t]*=(?![=>]))"
        r"|[ \t]++string(?=[ \t]*=(?!=)))?")
SCAN = re.compile(rf"""(?P<string>{STRING})|(?P<block>^[ \t]*\[{{1,2}}(?P<section>[\w. \-]++)\]{{1,2}}[ \t]*$)"""
                  rf"""|(?P<name>[A-Za-z_$](?:[\w$.]|-(?!>))*+)(?P<end>\\?["']?\]?){TYPE}[ \t]*+(?P<sign>{SIGN})"""
                  r"""|<(?P<tag>[A-Za-z_][\w.:\-]*+)(?P<attributes>[^<>]*+)>(?P<body>[^<>]++)</(?P=tag)\s*+>"""
                  r"""|(?P<open>[\[({])|(?P<close>[\])}])|[\w$][\w$.\-]*+""", re.MULTILINE | re.DOTALL)
AFTER_KEY = re.compile(rf"\]?{TYPE}[ \t]*+{SIGN}")
LEAD = re.compile(r"(?:[ \t]|\\\r?\n)*+(?:(?:new|await)[ \t]++)?(?:&(?P<anchor>[\w\-]++)[ \t]++)?")
NEXT = re.compile(r"""\s*+(?:\(\s*+)*+(?=[rRbBuUfF@]{0,2}["'`])""")
TEXT = re.compile(STRING, re.DOTALL)
ESCAPED = re.compile(r'\\"(?P<esc>[^"\\\n]*+)\\"')
BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*+\n")
VARIABLE = re.compile(r"\$\{?(?P<var>[A-Za-z_]\w*+)\}?(?![\w.+/=-])")
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@%^&*$-]++")
SUBSCRIPT = re.compile(r"""\[\s*+["'](?P<key>[^"'\n]++)["']\s*+\]""")
JOIN = re.compile(r"""\s*+(?:\+|\.\.)\s*+|[ \t]*+\.[ \t]*+(?=["'$])""")
BESIDE = re.compile(r"""[ \t]*+(?=[rRbBuUfF]{0,2}["'])""")
BESIDE_IN_PARENTHESES = re.compile(r"""\s*+(?=[rRbBuUfF]{0,2}["'])""")
INDENT = re.compile(" *+")
LINE_HEAD = re.compile(r"""[ \t\-"']*+""")
CLOSING = re.compile(r"\s*+\)")
NAME = re.compile(r"[*]?[A-Za-z_$][\w$.\-]*\Z")


class Part(NamedTuple):
    """A literal with its place, and the name that it may be instead."""
    start: int
    end: int
    value: str
    ref: str | None
    quoted: bool


class Assignment(NamedTuple):
    at: int
    names: tuple[str, ...]  # the name, its type if that may be one, the name above a generic one
    parts: tuple[Part, ...]
    argument: bool  # of a call


class _Open(NamedTuple):
    name: str | None
    call: bool
    skip: bool  # the next string is looked up


def _string(m: re.Match) -> Part:
    group = next(g for g in QUOTES if m[g] is not None)
    value = m[group]
    start, end = m.span(group)
    if group in ("t1", "t2", "bt"):
        start, end = start + len(value) - len(value.lstrip()), end - len(value) + len(value.rstrip())
        value = value.strip()
    whole = VARIABLE.fullmatch(value)
    return Part(start, max(start, end), value, whole and whole["var"], True)


class _Reader:
    """One text; ``found`` are its assignments, in no order."""

    def __init__(self, text: str) -> None:
        self.text, self.found, self.inside = text, [], [(0, len(text))]
        while self.inside:
            self._scan(*self.inside.pop())

    def _again(self, part: Part) -> None:
        if ":" in part.value or "=" in part.value or "<" in part.value:
            self.inside.append((part.start, part.end))

    def _add(self, at: int, names: tuple[str, ...], parts: list[Part], argument: bool = False) -> None:
        self.found.append(Assignment(at, names, tuple(parts), argument))

    def _from(self, at: int) -> None:
        """A line starts here."""
        self.line, self.head, self.seen = at, LINE_HEAD.match(self.text, at).end(), at

    def _indent(self, at: int) -> int | None:
        """Columns before a name that is first in its line, list dashes included;
        places are asked from left to right."""
        newline = self.text.rfind("\n", self.seen, at)
        if newline >= 0:
            self._from(newline + 1)
        self.seen = at
        return at - self.line if self.head >= at else None

    def _scan(self, at: int, end: int) -> None:
        text, opens, pending = self.text, [], None
        above: list[tuple[int, str]] = []  # keys of less indentation
        section, label = "", ""
        self._from(at)
        while m := SCAN.search(text, at, end):
            at, names, start = m.end(), (), m.start()
            if m["string"] is not None:
                key = AFTER_KEY.match(text, at, end)
                part = _string(m)
                if not key:
                    if opens and opens[-1].name and part.value:
                        if opens[-1].skip:
                            opens[-1] = opens[-1]._replace(skip=False)
                        else:
                            self._add(start, (opens[-1].name,), [part], opens[-1].call)
                    self._again(part)
                    continue
                at, names = key.end(), tuple(n for n in (part.value, key["type"]) if n)
            elif m["section"] is not None:
                section, above, opens = m["section"], [], []
                continue
            elif m["name"] is not None:
                names = tuple(n for n in (m["name"], m["type"]) if n)
            elif m["tag"] is not None:
                body = m["body"].strip()
                first = m.start("body") + len(m["body"]) - len(m["body"].lstrip())
                if body:
                    self._add(start, self._path(m["tag"], (m["tag"],), section, label, above, opens),
                              [Part(first, first + len(body), body, None, True)])
                    label = body if m["tag"].lower() in LABEL else ""
                at = m.start("attributes")  # these are pairs too
                continue
            elif m["open"]:
                opens.append(pending or _Open(None, False, False))
                pending = None
                continue
            elif m["close"]:
                if opens:
                    opens.pop()
                continue
            else:
                continue
            if not names:
                continue
            name, indent = names[0], self._indent(start)
            while above and indent is not None and above[-1][0] >= indent:
                above.pop()
            path = self._path(name, names, section, label, above, opens)
            # after a colon that ends its line stands a literal only below a key
            below = m["sign"] != ":" or indent is not None
            parts, at, pending = self._value(name, below, at, end)
            if parts:
                self._add(start, path, parts)
                label = parts[0].value if name.lower() in LABEL else ""
            elif pending is None and indent is not None:
                above.append((indent, name))

    def _path(self, name: str, names: tuple[str, ...], section: str, label: str, above: list[tuple[int, str]],
              opens: list[_Open]) -> tuple[str, ...]:
        """The names that count: a generic one takes its label, or the one above."""
        if name.rsplit(".", 1)[-1].lower() not in GENERIC:
            return names
        if label:
            return (*names, label)
        if opens and opens[-1].name:
            return (*names, opens[-1].name)
        return (*names, above[-1][1]) if above else (*names, section)

    def _value(self, name: str, below: bool, at: int, end: int) -> tuple[list[Part], int, _Open | None]:
        """The parts that ``name`` is set to, where they end, and what opens there."""
        text = self.text
        lead = LEAD.match(text, at, end)
        at = lead.end()
        if block := BLOCK.match(text, at, end):
            return self._block(block.end(), end)
        inner, parts, begun = 0, [], at
        if (ahead := NEXT.match(text, at, end)) and not (
                "\n" in ahead[0] and (not below or self._is_key(ahead.end(), end))):
            at, inner = ahead.end(), ahead[0].count("(")
        while True:
            if m := TEXT.match(text, at, end):
                parts.append(part := _string(m))
                self._again(part)
            elif m := ESCAPED.match(text, at, end):
                parts.append(Part(*m.span("esc"), m["esc"], None, True))
            elif m := VARIABLE.match(text, at, end):
                parts.append(Part(*m.span(), "", m["var"], False))
            elif m := BARE.match(text, at, end):
                follows = text[m.end():m.end() + 1]
                if follows == "(":
                    call = _Open(name, True, bool(LOOKUP.search(m[0].rsplit(".", 1)[-1])))
                    return parts, m.end(), call
                if follows == "[":
                    last = None
                    while key := SUBSCRIPT.match(text, m.end() if last is None else last.end(), end):
                        last = key
                    if last is None:
                        return parts, m.end(), None
                    parts.append(Part(*last.span("key"), "", last["key"], False))
                    m = last
                else:
                    ref = m[0] if NAME.match(m[0]) else None
                    alias = ref and ref[0] == "*"  # set or not, it is no literal
                    parts.append(Part(*m.span(), "" if alias else m[0], ref, False))
            else:
                break
            at = m.end()
            more = JOIN.match(text, at, end)
            if not more and parts[-1].quoted:
                more = (BESIDE_IN_PARENTHESES if inner else BESIDE).match(text, at, end)
            if not more:
                break
            at = more.end()
        while inner and (m := CLOSING.match(text, at, end)):
            at, inner = m.end(), inner - 1
        if lead["anchor"] and parts:
            self._add(lead.start(), ("*" + lead["anchor"],), parts)
        opened = None
        if not parts and text[begun:begun + 1] in ("[", "{", "("):
            opened = _Open(name, False, False)
        return parts, at, opened

    def _is_key(self, at: int, end: int) -> bool:
        m = TEXT.match(self.text, at, end)
        return bool(m and AFTER_KEY.match(self.text, m.end(), end))

    def _block(self, at: int, end: int) -> tuple[list[Part], int, None]:
        """A YAML block: the lines that stand deeper than their key."""
        text, first = self.text, at
        own = len(INDENT.match(text, self.line)[0])
        while at < end:
            until = text.find("\n", at, end)
            until = end if until < 0 else until
            row = text[at:until]
            if row.strip() and len(row) - len(row.lstrip(" ")) <= own:
                break
            at = min(end, until + 1)
        body = text[first:at]
        start = first + len(body) - len(body.lstrip())
        value = body.strip()
        return ([Part(start, start + len(value), value, None, True)] if value else []), at, None


def assignments(text: str) -> list[Assignment]:
    """What the names of a text are set to, by place."""
    return sorted(_Reader(text).found, key=lambda a: a.at)


class Constants:
    """Which assignment a reference means: the last one before it, else the
    first one after it."""

    def __init__(self, found: list[Assignment]) -> None:
        self.found, self.places = found, defaultdict(list)
        for i, a in enumerate(found):
            if not a.argument:
                self.places[a.names[0]].append(i)

    def of(self, ref: str | None, i: int) -> int | None:
        for name in (ref, ref.rsplit(".", 1)[-1]) if ref else ():
            if places := self.places.get(name):
                k = bisect_left(places, i)
                others = ([places[k - 1]] if k else []) + [p for p in places[k:k + 2] if p != i]
                return others[0] if others else None
        return None
