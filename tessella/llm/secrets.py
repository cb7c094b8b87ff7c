"""Secret scans: base patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax into pairs of a name and a literal: assignments
(`=`, `:=`, `?=`, `<-`, `:`, `=>`), quoted keys, call arguments by keyword, setters, `export` and `-D`/`--name` options,
header lines, XML or INI entries, directives (`ENV`, `#define`, `setx`, `setenv`), settings in one string and credentials in an address. Constants are propagated: a name that was bound to a literal, a
concatenation of literals and such names, and defaults of environment look-ups (or behind `||`, `??`
and `or`) stand for their values, until the name is bound to something else. Values go on over line ends behind a binding or a join sign, within brackets, behind a
backslash, and in triple-quoted and block strings. A literal is scored by its target name (and the names it passed through) and by its form.

Time is in proportion to the text, and memory is some 15 bytes for each lexeme besides the text. A text is lexed if a
sensitive word stands in what may be a name or a key; for that test alone, names and keys reach NAME_LENGTH characters.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import lean

#: The kinds of spans in their order.
KINDS = ("assign", "access", "hex", "lexed")
#: The base patterns. Group 2 of the first must have 12 characters, the others' matches 18 and 16.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
#: Names whose presence lets the first pattern match at all, for a quick test.
HINT = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)

#: Parts of names that a sensitive literal is bound to, and their weight.
SENSITIVE = {
    "password": 5, "passwd": 5, "passphrase": 5, "pwd": 4, "pass": 3,
    "secret": 5, "token": 4, "apikey": 5, "accesskey": 5, "secretkey": 5, "privatekey": 5,
    "credential": 4, "credentials": 4, "auth": 2, "authorization": 3, "bearer": 3,
    "key": 2, "signature": 2, "salt": 2, "dsn": 2, "connectionstring": 3,
}
#: Parts of names that speak against a secret, and literals that stand for none.
HARMLESS = {"public": 3, "example": 3, "sample": 2, "dummy": 3, "test": 1, "placeholder": 4, "length": 3, "size": 3, "count": 3, "name": 2, "file": 2, "path": 2, "url": 2, "type": 2, "field": 2, "label": 2, "id": 1, "hash": 1}
STANDS_FOR_NONE = re.compile(r"(?:x{4,}|\*{3,}|\.{3,}|change_?me|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|true|false|undefined|example.*|placeholder)\Z", re.IGNORECASE | re.ASCII)
#: A literal is reported from this score on.
THRESHOLD = 6

#: Kinds of lexemes.
GROUPS = ("string", "option", "name", "bind", "join", "open", "close", "line", "bare")
#: One token of source or configuration text: a string closed on its line or by escapes over line ends, or else.
_STRINGS = {'"': r'"(?:[^"\\\n]|\\[\s\S])*+"', "'": r"'(?:[^'\\\n]|\\[\s\S])*+'", "`": r"`[^`\n]*+`"}
_REST = r"""(?P<option>(?<![A-Za-z0-9+/_.~)\]-])(?:-D|--?)(?=[A-Za-z_]))
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)
    |(?P<bind>:=|\?=|<-(?=\s)|=>|==|!=|<=|>=|[:=](?!=))
    |(?P<join>\+|\.\.(?!\.)|(?<=\s)\.(?=\s)|\|\||\?\?)
    |(?P<open>[(\[{,;])|(?P<close>[)\]}])
    |(?P<line>(?<!\\)(?<!\\\r)\n)
    |(?P<bare>[A-Za-z0-9+/_=.~-]+)"""
#: How far an unclosed string goes: the quote at its start closes nowhere before that, nor do later ones of its kind.
_OPEN = {'"': re.compile(r'"(?:[^"\\\n]|\\[\s\S])*'), "'": re.compile(r"'(?:[^'\\\n]|\\[\s\S])*"), "`": re.compile(r"`[^`\n]*")}
#: What an unquoted value consists of.
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@$%^&*-]+", re.ASCII)
#: Values in several lines: a line that goes on, a triple-quoted string, the head of a block, and a line of settings.
GOES_ON = re.compile(r"\\\r?\n[ \t]*")
TRIPLE = re.compile(r'"""([\s\S]*?)"""|\'\'\'([\s\S]*?)\'\'\'')
BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\r?\n")
SETTING = re.compile(r"""["']?[A-Za-z_][A-Za-z0-9_.-]*["']?(?::?=|:(?!//))["']?[^=\s]""", re.ASCII)
BOUND = re.compile(r"""["']?[ \t]*(?::?=|:)""")
ARMOR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----")
#: Options with their value behind white space or as the next string, and header lines and options within a string.
OPTION = re.compile(r"--?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)", re.ASCII)
INSIDE = re.compile(r"""(?:(?:\A|(?<=["']))(?P<header>[A-Za-z][A-Za-z0-9-]*):[ \t]*(?:(?:Bearer|Basic|Token|ApiKey)[ \t]+)?|(?<![^\s"'])(?:-D|--?)(?P<option>[A-Za-z_][A-Za-z0-9_.-]*)(?:=|[ \t]+(?!-)))(?P<value>[^\s"'`\\,;]+)""", re.IGNORECASE | re.ASCII)
#: Words before a credential.
SCHEME = re.compile(r"\s*(?:Bearer|Basic|Token|ApiKey)[ \t]+", re.IGNORECASE | re.ASCII)
#: Parts of names that make a text worth lexing, and what must stand around one of them: a sign behind it, a setter's bracket, an option's
#: white space, or a string that is a key or an argument. Names and strings are looked at for NAME_LENGTH characters on either side.
NAME_LENGTH = 200
WORD = re.compile(r"pass|pwd|secret|token|key|credential|auth|bearer|signature|salt|dsn|connection", re.IGNORECASE | re.ASCII)
SIGN = re.compile(rf"[A-Za-z0-9_$.\-]{{0,{NAME_LENGTH}}}+(?:(?P<call>(?=[ \t]*+\())|[\"'`]?\s{{0,{NAME_LENGTH}}}+(?:\)\s{{0,{NAME_LENGTH}}}+)?(?::=|\?=|<-|=>|[:=]|>))", re.ASCII)
QUOTED = re.compile(rf"[^\"'\n]{{0,{NAME_LENGTH}}}+[\"']\s{{0,{NAME_LENGTH}}}+(?:[:,\]]|=>)", re.ASCII)
OPTION_TAIL = re.compile(rf"[A-Za-z0-9_.\-]{{0,{NAME_LENGTH}}}+\s", re.ASCII)
OPTION_HEAD = re.compile(r"(?<![\w.\-])--?[A-Za-z][A-Za-z0-9_.\-]*\Z|(?<![\w.\-])--?\Z", re.ASCII)
#: Directives that bind a name to what follows, credentials in an address, and settings in one string.
DIRECTIVE = re.compile(r"^[ \t]*+(?:ENV|#[ \t]*+define|setx|setenv)[ \t]++(?P<name>[A-Za-z_]\w*+)[ \t]++(?:(?P<quote>[\"'])(?P<quoted>[^\"'\n]++)(?P=quote)|(?P<value>[^\s\"'=]++))", re.ASCII | re.MULTILINE)
ADDRESS = re.compile(rf"://[^\s:/@\"'<>]{{0,{NAME_LENGTH}}}+:(?P<value>[^\s:/@\"'<>]{{1,{NAME_LENGTH}}}+)@", re.ASCII)
SETTINGS = re.compile(r"(?:(?<=[\"'`;])|\A)[ \t]*+(?P<name>[A-Za-z][A-Za-z_ ]*+)=[ \t]*+(?P<value>[^;\s\"'`]++)(?=[ \t]*+(?:;|[\"'`]))", re.ASCII)
XML = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>\n]*)?>(?P<value>[^<>\n]+)</(?P=name)>|<add\s+key=\"(?P<key>[^\"\n]+)\"\s+value=\"(?P<setting>[^\"\n]+)\"", re.ASCII)
#: A binding at the start of a line or behind a declaration word, whose constant may be used later.
#: Calls that bind their first string to their second, or their one string to what their own name sets.
SETTER = re.compile(r"(?:.*\.)?(?:set|put|add|setenv|putenv|define|setitem|setproperty|set_?option|set_?header|setdefault)", re.IGNORECASE | re.ASCII)
SETS = re.compile(r"(?:.*\.)?(?:set|with)_?(?P<name>[A-Z_]\w*)", re.ASCII)
#: What stands before a string's quote in some languages.
PREFIX = re.compile(r"[fFrRbBuU]{1,2}", re.ASCII)
FILLED = re.compile(r"\{[^{}]*\}")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    """How sensitive a name is: its weightiest part, pairs of parts joined, less what is harmless in it."""
    parts = [p.lower() for p in PARTS.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:])]
    good = max((SENSITIVE.get(p, 0) for p in [*parts, *both]), default=0)
    return good - max((HARMLESS.get(p, 0) for p in parts), default=0) if good else 0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(value: str) -> int:
    """How much a literal looks like a secret by its form."""
    if len(value) < 6 or STANDS_FOR_NONE.match(value) or any(c.isspace() for c in value):
        return -9
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    bits = entropy(value)
    score = (len(value) >= 8) + (len(value) >= 16) + (bits >= 2.75) + (bits >= 3.5) + (classes >= 2) + (classes >= 3)
    return score - 3 * (not re.search("[0-9]", value) and classes < 3)


class _Literal:
    """A literal with the spans of text that it is made of and the names it passed through."""

    __slots__ = ("value", "spans", "names")

    def __init__(self, value: str, spans: list[tuple[int, int]], names: tuple[str, ...] = ()):
        self.value, self.spans, self.names = value, spans, names


@functools.cache
def _lexer(dead: str) -> re.Pattern:
    """LEXEME where quotes in dead, which nothing closes, are no strings; other unclosed quotes are found as such."""
    alive = [q for q in _STRINGS if q not in dead]
    strings = "|".join(_STRINGS[q] for q in alive)
    return re.compile((rf"(?P<string>{strings})|(?P<unclosed>[{''.join(alive)}])|" if alive else "") + _REST, re.VERBOSE | re.ASCII)


class _Lexemes:
    """The lexemes of a text as (kind, text, start, end), kept as numbers; tuples are made for some at a time.

    Time and memory are in proportion to the text: a quote that nothing closes is looked at once, not again from
    each of its kind behind it.
    """

    PART = 4096

    def __init__(self, text: str, start: int):
        self.text, self.base = text, start
        self.kind, self.begin, self.end = array("b"), array("i"), array("i")
        #: Lexemes that are line ends and strings, in order; the closing bracket of each opening one, and what opens.
        self.lines, self.strings, self.opened, self.closed = array("i"), array("i"), array("i"), array("i")
        self.parts: dict[int, list[tuple]] = {}
        self._lex(0, len(text), "")
        self.closing = _Closing(self)

    def _lex(self, a: int, b: int, dead: str) -> None:
        todo = [(a, b, dead)]
        kinds = {k: i for i, k in enumerate(GROUPS)}
        kind, begin, end, lines, strings = self.kind, self.begin, self.end, self.lines, self.strings
        while todo:
            a, b, dead = todo.pop()
            for m in _lexer(dead).finditer(self.text, a, b):
                k = m.lastgroup
                if k == "unclosed":
                    quote, at = m.group(), m.start()
                    stop = min(b, _OPEN[quote].match(self.text, at, b).end())
                    todo += [(stop, b, dead), (at + 1, stop, dead + quote)]
                    break
                if k == "line":
                    lines.append(len(kind))
                elif k == "string":
                    strings.append(len(kind))
                kind.append(kinds[k])
                begin.append(m.start())
                end.append(m.end())

    def __len__(self) -> int:
        return len(self.kind)

    def __getitem__(self, i: int) -> tuple[str, str, int, int]:
        if i < 0:
            i += len(self.kind)
        part = self.parts.get(i // self.PART)
        if part is None:
            if len(self.parts) > 3:
                self.parts.clear()
            a = i // self.PART * self.PART
            b = a + self.PART
            part = self.parts[i // self.PART] = [(GROUPS[k], self.text[x:y], x + self.base, y + self.base) for k, x, y in zip(self.kind[a:b], self.begin[a:b], self.end[a:b])]
        return part[i % self.PART]

    def line_end(self, j: int) -> int:
        """The first line end from j on."""
        k = bisect_left(self.lines, j)
        return self.lines[k] if k < len(self.lines) else len(self)

    def strings_before(self, end: int, least: int) -> Iterator[int]:
        """Strings before end and behind least, the last first."""
        k = bisect_left(self.strings, end) - 1
        while k >= 0 and self.strings[k] > least:
            yield self.strings[k]
            k -= 1


class _Closing:
    """The closing bracket of each opening one, by their numbers."""

    def __init__(self, lexemes: _Lexemes):
        opened, self.of = array("i"), array("i", bytes(4 * len(lexemes)))
        text, brackets = lexemes.text, {GROUPS.index("open"), GROUPS.index("close")}
        for k, (kind, a) in enumerate(zip(lexemes.kind, lexemes.begin)):
            if kind in brackets:
                if text[a] == "(":
                    opened.append(k)
                elif text[a] == ")" and opened:
                    self.of[opened.pop()] = k

    def __contains__(self, k: int) -> bool:
        return 0 <= k < len(self.of) and self.of[k] > 0

    def __getitem__(self, k: int) -> int:
        return self.of[k]

    def get(self, k: int, other: int) -> int:
        return self.of[k] if k in self else other


def pairs(text: str, start: int = 0, known: dict[str, _Literal] | None = None) -> Iterator[tuple[str, _Literal]]:
    """(name, literal) pairs of a piece of text, in order; known holds constants and gains those found."""
    known = {} if known is None else known
    lexemes = _Lexemes(text, start)
    for k in lexemes.strings:
        x, y = lexemes.begin[k] + 1, lexemes.end[k] - 1
        if text.find("-", x, y) >= 0 or text.find(":", x, y) >= 0:
            for m in INSIDE.finditer(text[x:y]):
                yield m["header"] or m["option"], _Literal(m["value"], [(start + x + m.start("value"), start + x + m.end("value"))])
        if text.find(";", x, y) >= 0 and text.find("=", x, y) >= 0:
            for m in SETTINGS.finditer(text, x, y + 1):
                yield m["name"], _Literal(m["value"], [(start + m.start("value"), start + m.end("value"))])
    closing = lexemes.closing
    i, n = 0, len(lexemes)
    while i < n:
        kind, got, a, b = lexemes[i]
        if kind not in ("name", "string"):
            i += 1
            continue
        j = i + 1
        if kind == "string" and i > 1 and j + 1 < n and lexemes[i - 1][1] == "(" and lexemes[j][1] == "," and lexemes[j + 1][0] == "string" and SETTER.fullmatch(lexemes[i - 2][1]):
            yield got[1:-1], _literal(lexemes[j + 1][1][1:-1], lexemes[j + 1][2] + 1)
        elif kind == "name" and j + 2 < n and lexemes[j][1] == "(" and lexemes[j + 1][0] == "string" and lexemes[j + 2][1] == ")" and (m := SETS.fullmatch(got)):
            yield m["name"], _literal(lexemes[j + 1][1][1:-1], lexemes[j + 1][2] + 1)
        elif kind == "name" and j + 1 < n and lexemes[j][1] == "+" and lexemes[j + 1][1] == "=" and lexemes[j][3] == lexemes[j + 1][2]:
            known.pop(got, None)  # += makes another value of it
        if j < n and lexemes[j][1] == "]":  # config["name"] = ...
            j += 1
        if j < n and lexemes[j][1] == ":" and kind == "name" and j + 2 < n and lexemes[j + 1][0] == "name" and lexemes[j + 2][1] == "=":
            j += 2  # a type between name and value
        dashed = kind == "name" and i > 0 and lexemes[i - 1][0] == "option" and lexemes[i - 1][3] == a
        if j >= n or lexemes[j][0] != "bind" or lexemes[j][1] in ("==", "!=", "<=", ">="):
            option = OPTION.fullmatch(got, 1, len(got) - 1) if kind == "string" else None
            if option and j + 1 < n and lexemes[j][1] == "," and lexemes[j + 1][0] == "string":
                yield option["name"], _literal(lexemes[j + 1][1][1:-1], lexemes[j + 1][2] + 1)
            elif dashed and j == i + 1 and j < n and lexemes[j][0] in ("string", "name", "bare") and text[b - start] in " \t\\" and not lexemes[j][1].startswith("-") and name_score(got) > 0 and not (j + 1 < n and lexemes[j + 1][0] == "bind"):
                value, j = _value(text, start, lexemes, j, known, closing, a)
                if value is not None:
                    yield got, value
                i = j
            i += 1
            continue
        name = got[1:-1] if kind == "string" else got
        bound = lexemes[j][1]
        value, j = _value(text, start, lexemes, j + 1, known, closing, a)
        if value is not None and name and dashed:  # an option is no constant
            yield name, value
        elif value is not None and name:
            known[name] = _Literal(value.value, value.spans, (*value.names, name)[-4:])
            yield name, value
        elif kind == "name" and bound in ("=", ":="):
            known.pop(name, None)  # bound to what isn't constant
        i = max(j, i + 1)


def _literal(content: str, a: int) -> _Literal:
    """The literal of a string's content at a, without escaped line ends; of a scheme word and a credential, the credential."""
    m = SCHEME.match(content)
    if m and m.end() < len(content):
        a += m.end()
        content = content[m.end() :].rstrip()
    pieces, at = [], 0
    for m in GOES_ON.finditer(content):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(content)))
    return _Literal("".join(content[x:y] for x, y in pieces), [(a + x, a + y) for x, y in pieces])


def _lines(content: str, a: int) -> _Literal | None:
    """The literal of the lines at a, a word each; lines of words or of settings are none. Armor is left out."""
    value, spans = [], []
    for line in content.split("\n"):
        word = line.strip().removesuffix("\\").rstrip()
        m = SCHEME.match(word)
        skip = m.end() if m and not value else 0
        if word and not ARMOR.fullmatch(word):
            x = a + len(line) - len(line.lstrip()) + skip
            word = word[skip:]
            if any(c.isspace() for c in word) or SETTING.match(word):
                return None
            value.append(word)
            spans.append((x, x + len(word)))
        a += len(line) + 1
    return _Literal("".join(value), spans) if value else None


def _block(text: str, at: int, begin: int, start: int) -> _Literal | None:
    """The literal of a block: the lines from begin on that stand deeper than the name at at."""
    deep, end = at - (text.rfind("\n", 0, at) + 1), begin
    while end < len(text):
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        line = text[end:stop]
        if line.strip() and len(line) - len(line.lstrip()) <= deep:
            break
        end = stop + 1
    return _lines(text[begin:end], begin + start)


def _over(text: str, start: int, lexemes: _Lexemes, j: int) -> int:
    """The next lexeme from j on behind line ends and what is noted in front of them."""
    while j < len(lexemes):
        kind, got, a, _ = lexemes[j]
        before = text[lexemes[j - 1][3] - start : a - start] if j else ""
        if kind == "line":
            j += 1
        elif "# " in before or got == "//":
            stop = text.find("\n", a - start)
            if stop < 0:
                return len(lexemes)
            j = bisect_left(lexemes, stop + start, j + 1, key=lambda x: x[2])
        else:
            break
    return j


def _starts(text: str, start: int, lexemes: _Lexemes, j: int, known: dict[str, _Literal], closing: _Closing, at: int) -> bool:
    """Whether the lexeme j, on a later line than the name at at, is that name's value."""
    n = len(lexemes)
    if j >= n:
        return False
    kind, got, a, b = lexemes[j]
    follows = lexemes[j + 1] if j + 1 < n else ("line", "", 0, 0)
    if kind == "string":
        return follows[0] != "bind"
    if kind == "open":
        return got == "(" and j in closing
    line = text.rfind("\n", 0, at - start) + 1
    indent = len(text[line : at - start]) - len(text[line : at - start].lstrip())
    if kind not in ("name", "bare") or a - start - (text.rfind("\n", 0, a - start) + 1) <= indent:
        return False
    if kind == "name" and follows[1] == "(":
        return j + 1 in closing
    if kind == "name" and got in known:
        return follows[0] != "bind"
    m = SCHEME.match(text, a - start)
    m = BARE.match(text, m.end() if m else a - start)
    if not m:
        return False
    stop = text.find("\n", m.end())
    rest = text[m.end() : stop if stop >= 0 else len(text)].strip()
    return not SETTING.match(m.group()) and (not rest or rest[0] in "#;,\\")


def _bracketed(text: str, start: int, lexemes: _Lexemes, j: int, known: dict[str, _Literal], closing: _Closing) -> tuple[list[_Literal], int] | None:
    """The literals between the bracket j and its end, if there is nothing but literals, known names and join signs."""
    parts, end, k = [], closing[j], _over(text, start, lexemes, j + 1)
    while k < end:
        kind, got, a, _ = lexemes[k]
        if kind == "string":
            m = TRIPLE.match(text, a - start)
            part = _lines(m[m.lastindex], start + m.start(m.lastindex)) if m else _literal(got[1:-1], a + 1)
            if part is None:
                return None
            parts.append(part)
            while m and k + 1 < end and lexemes[k + 1][2] < start + m.end():
                k += 1
        elif kind == "name" and got in known and lexemes[k + 1][1] != "(":
            parts.append(known[got])
        elif kind != "join" and got not in "()":
            return None
        k = _over(text, start, lexemes, k + 1)
    return (parts, end + 1) if parts else None


def _value(text: str, start: int, lexemes: _Lexemes, j: int, known: dict[str, _Literal], closing: _Closing, at: int) -> tuple[_Literal | None, int]:
    """The constant value that starts at lexeme j (joined literals and known names) and belongs to the name at at, and the next lexeme."""
    n, bind, first = len(lexemes), lexemes[j - 1], j
    block = BLOCK.match(text, bind[3] - start) if bind[1] == ":" else None
    if block:  # what stands in it is lexed on its own, too
        return _block(text, at - start, block.end(), start), j
    j = _over(text, start, lexemes, j)
    if j > first and not _starts(text, start, lexemes, j, known, closing, at):
        j = first
    spaced = text[bind[3] - start : bind[3] - start + 1].isspace() and bind[1] != ":"
    parts: list[_Literal] = []
    crossed, run = False, 0
    while j < n:
        kind, got, a, b = lexemes[j]
        if parts and crossed and j + 1 < n and lexemes[j + 1][0] == "bind":
            break
        if kind == "string":
            m = TRIPLE.match(text, a - start)
            if m and parts and crossed:
                break
            if m and not parts:
                return _lines(m[m.lastindex], start + m.start(m.lastindex)), j + 1
            parts.append(_literal(got[1:-1], a + 1))
        elif kind == "open" and got == "(" and j in closing and (inner := _bracketed(text, start, lexemes, j, known, closing)):
            parts += inner[0]
            j = inner[1] - 1
        elif kind == "option" and j + 2 < n and lexemes[j + 1][0] == "name" and lexemes[j + 2][0] == "bind":
            return None, j
        elif kind in ("name", "bare", "option"):
            if parts and crossed and not (kind == "name" and got in known):
                break
            if kind == "name" and j + 1 < n and lexemes[j + 1][0] == "string" and lexemes[j + 1][2] == b and PREFIX.fullmatch(got) and not TRIPLE.match(text, b - start):
                j += 1
                parts.append(_literal(lexemes[j][1][1:-1], lexemes[j][2] + 1) if "f" not in got.lower() else _unfilled(lexemes[j][1][1:-1], lexemes[j][2] + 1))
                j += 1
                break
            other = _otherwise(lexemes, j, closing) if not parts and not (kind == "name" and got in known) else 0
            if other:  # the value in place of one that is missing
                j = _over(text, start, lexemes, other)
                continue
            if kind == "name" and j + 1 < n and lexemes[j + 1][1] == "(":
                return _call(lexemes, j, closing)
            if kind == "name" and got in known:
                parts.append(known[got])
            elif parts:
                return None, j + 1
            else:  # unquoted, as in configuration files: up to white space or a closing sign
                m = SCHEME.match(text, a - start)
                m = BARE.match(text, m.end()) if m else None
                if m:
                    a = m.start() + start
                m = m or BARE.match(text, a - start)
                end = m.end() if m else b - start
                pieces = [(a - start, end)]
                while (m := GOES_ON.match(text, end)) and (word := BARE.match(text, m.end())) and not (m.group()[-1] != "\n" and word.group()[0] == "-" or SETTING.match(word.group()) or BOUND.match(text, word.end())):
                    end = word.end()
                    pieces.append(word.span())
                raw = [text[x:y] for x, y in pieces]
                raw[-1] = raw[-1].rstrip(".,;")
                while j < n and lexemes[j][2] < pieces[0][1] + start:
                    j += 1
                return _Literal("".join(raw), [(x + start, x + start + len(r)) for (x, _), r in zip(pieces, raw)]), j
        elif parts and crossed:
            break
        else:
            return None, j
        k = _over(text, start, lexemes, j + 1)
        if j + 1 < n and lexemes[j + 1][1] in ("||", "??"):
            j += 1  # a constant needs nothing in its place
            break
        if j + 1 < n and lexemes[j + 1][0] == "join":
            j, k = _over(text, start, lexemes, j + 2), j + 2
            crossed = j > k
            continue
        whole = k < n and (k + 1 == n or lexemes[k + 1][0] != "bind")
        if k > j + 1 and k + 1 < n and lexemes[k][1] in ("+", ".", "..") and (lexemes[k + 1][0] == "string" or lexemes[k + 1][1] in known) and (k + 2 == n or lexemes[k + 2][0] != "bind"):
            j, crossed = k + 1, True  # the join sign leads the next line
            continue
        if whole and spaced and lexemes[k][0] == "string" and kind == "string" and (k < run or (run := _adjacent(text, start, lexemes, j, k))):
            j, crossed = k, True
            continue
        j += 1
        break
    if len(parts) > 1 and SCHEME.fullmatch(parts[0].value):
        del parts[0]
    if not parts:
        return None, j
    return _Literal("".join(p.value for p in parts), [s for p in parts for s in p.spans], tuple(x for p in parts for x in p.names)), j


def _otherwise(lexemes: _Lexemes, j: int, closing: _Closing) -> int:
    """The lexeme behind ||, ?? or `or` that follows the name j with its call or index; 0 if there is none."""
    k, n = j + 1, len(lexemes)
    if k < n and lexemes[k][1] == "(":
        k = closing.get(k, n) + 1
    elif k + 2 < n and lexemes[k][1] == "[" and lexemes[k + 2][1] == "]":
        k += 3
    return k + 1 if k + 1 < n and lexemes[k][1] in ("||", "??", "or") else 0


def _unfilled(content: str, a: int) -> _Literal:
    """What a format string says itself, without what is filled in."""
    pieces, at = [], 0
    for m in FILLED.finditer(content):
        pieces.append((at, m.start()))
        at = m.end()
    pieces = [(x, y) for x, y in [*pieces, (at, len(content))] if y > x]
    return _Literal("".join(content[x:y] for x, y in pieces), [(a + x, a + y) for x, y in pieces])


def _adjacent(text: str, start: int, lexemes: _Lexemes, j: int, k: int) -> int:
    """The end of the strings from k on that go on with the string j: behind a backslash, or to a ; or , on later lines; else 0."""
    if k == j + 1:
        return k + 1 if GOES_ON.search(text, lexemes[j][3] - start, lexemes[k][2] - start) else 0
    while k < len(lexemes) and lexemes[k][0] == "string":
        last, k = k, _over(text, start, lexemes, k + 1)
    return k if k == last + 1 and k < len(lexemes) and lexemes[k][1] in (";", ",") else 0


def _call(lexemes: _Lexemes, j: int, closing: _Closing) -> tuple[_Literal | None, int]:
    """An environment look-up with a default, or another call: its last string argument if it looks up or decodes."""
    name = lexemes[j][1].lower()
    if re.search(r"getenv|environ|env\.get|config|decode|bytes|string|encode", name):
        line = lexemes.line_end(j)
        for k in lexemes.strings_before(closing.get(j + 1, line), j + 2):
            bound = k > line and lexemes[k - 1][0] == "bind" and lexemes[k - 2][1].lower() not in ("default", "fallback")
            if not bound:
                return _literal(lexemes[k][1][1:-1], lexemes[k][2] + 1), j + 2
    return None, j + 2  # what stands between the brackets is lexed on its own


def _is_worth(text: str) -> bool:
    """Whether a sensitive word stands in what may be a binding, a setter, an option or a quoted key; in time in proportion to the text."""
    for m in WORD.finditer(text):
        a, b = m.span()
        if (t := SIGN.match(text, b)) and (t["call"] is None or _sets(text, a)):
            return True
        low = max(0, a - NAME_LENGTH)
        if OPTION_TAIL.match(text, b) and OPTION_HEAD.search(text, max(low, max(text.rfind(c, low, a) for c in " \t\n\"'(,=[") ), a):
            return True
        if max(text.rfind('"', low, a), text.rfind("'", low, a)) > text.rfind("\n", low, a) and QUOTED.match(text, b):
            return True
    return False


def _sets(text: str, a: int) -> bool:
    """Whether the name that goes on at a begins as a setter does."""
    k = a
    while k > max(0, a - NAME_LENGTH) and (text[k - 1].isalpha() or text[k - 1] == "_"):
        k -= 1
    return bool(re.search("set|with", text[k:a], re.IGNORECASE))


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals bound to sensitive names, with a score of THRESHOLD or more; code points, end exclusive."""
    found: set[tuple[int, int]] = set()
    if _is_worth(text):
        for name, value in pairs(text):
            best = max(name_score(x) for x in (name, *value.names))
            if best > 0 and best + literal_score(value.value) >= THRESHOLD:
                found.update(value.spans)
    for m in DIRECTIVE.finditer(text):
        group = "quoted" if m["quote"] else "value"
        if name_score(m["name"]) > 0 and name_score(m["name"]) + literal_score(m[group]) >= THRESHOLD:
            found.add(m.span(group))
    if "://" in text:
        for m in ADDRESS.finditer(text):
            if SENSITIVE["password"] + literal_score(m["value"]) >= THRESHOLD:
                found.add(m.span("value"))
    if "<" in text:
        for m in XML.finditer(text):
            name, group = (m["name"], "value") if m["name"] else (m["key"], "setting")
            value = m[group]
            bare = value.strip()
            if name_score(name) > 0 and name_score(name) + literal_score(bare) >= THRESHOLD:
                a = m.start(group) + len(value) - len(value.lstrip())
                found.add((a, a + len(bare)))
    return sorted((a, b) for a, b in found if b > a)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, sorted."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str | None) -> tuple[int, int, int, str, str, int]:
    """n_assign, n_access, n_hex, base_sha256, spans and n_lexed of a text; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    n = Counter(k for _, k, _ in base)
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    more = [(a, 3, b) for a, b in lexed_spans(text)]
    return n[0], n[1], n[2], hashlib.sha256(show(base).encode()).hexdigest(), show(sorted([*base, *more])), len(more)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed.

    Null and empty texts have no spans. Rows that repeat are scanned each for itself. Other columns
    are not read. Documents are independent, so there is no shuffle.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = [scan(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(find), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """A text with every span of scan() replaced; overlapping spans once."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]
