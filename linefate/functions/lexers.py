"""Tokens of source lines in Python, Rust, TypeScript/TSX and JavaScript, and of plain text.

Tokens stand for the leaves of a syntax tree: operators whole, comments and string contents word by word, string
delimiters and escapes on their own, code inside interpolations as code. Formatter-only differences are taken out: quote
style, semicolons and type-member separators in JS/TS, trailing commas. Malformed code is cut in some way that still covers
every character that isn't white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from ..operators.hunks import Line

WORD = regex.compile(r"[\p{Alphabetic}\p{N}_]+|[^\s\p{Alphabetic}\p{N}_]")
CONTENT = regex.compile(r"[\p{Alphabetic}\p{N}_]")
IDENTIFIER = r"[^\W\d]\w*"
NUMBER = r"\d(?:[\w.]*[\w](?:[eE][+-]\w+)?|\w*)|\.\d\w*"
OPERATORS = {
    "python": ("**=", "//=", ">>=", "<<=", "...", "!=", "->", ":=", "==", "<=", ">=", "**", "//", "<<", ">>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=", "<>"),
    "rust": ("<<=", ">>=", "...", "..=", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", ".."),
    "script": (">>>=", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "...", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "**", "<<", ">>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="),
}
OPENERS = {"python": ("#",), "rust": ("//!", "///", "//", "/*!", "/**", "/*"), "script": ("//", "/**", "/*")}
ESCAPE = re.compile(r"\\(?:u\{[0-9a-fA-F]*\}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|N\{[^}]*\}|[0-7]{1,3}|\r?\n|.)", re.S)
KEYWORDS = frozenset("and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try while with yield let const mut ref move where impl fn pub use mod struct enum trait type loop unsafe dyn box typeof instanceof new delete void throw switch do of export default extends implements interface var function static this".split())
#: Words after which an opening bracket doesn't call what stands before it.
LOOSE = KEYWORDS - {"this", "type", "default"}
DROP = object()


@dataclass
class Piece:
    line: int
    text: str
    comment: bool = False
    #: None: the text itself; DROP: nothing; a string: that string
    canon: object = None
    comma: bool = False
    separator: bool = False
    #: part of a string's or pattern's own text
    literal: bool = False


class Lexer:
    def __init__(self, source: str, language: str) -> None:
        self.source = source.removeprefix("\ufeff")
        self.language = language
        self.family = language if language in ("python", "rust") else "script"
        self.pieces: list[Piece] = []
        self.starts = [0, *[m.end() for m in re.finditer("\n", self.source)]]
        self.row = 0
        self.operators = re.compile("|".join(map(re.escape, OPERATORS[self.family])))
        self.number, self.identifier = re.compile(NUMBER), re.compile(IDENTIFIER)

    def push(self, at: int, text: str, comment: bool = False, canon: object = None) -> None:
        while self.row + 1 < len(self.starts) and self.starts[self.row + 1] <= at:
            self.row += 1
        self.pieces.append(Piece(self.row, text, comment, canon))

    def words(self, start: int, end: int, comment: bool = False) -> None:
        for m in WORD.finditer(self.source, start, end):
            self.push(m.start(), m[0], comment)
            self.pieces[-1].literal = True

    def last(self) -> str:
        """Text of the last code piece."""
        for p in reversed(self.pieces):
            if not p.comment:
                return p.text
        return ""

    def comment(self, at: int) -> int:
        s = self.source
        if s.startswith("/*", at):
            depth, end = 1, at + 2
            while depth and end < len(s):
                if s.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                elif self.family == "rust" and s.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                else:
                    end += 1
        else:
            end = s.find("\n", at)
            end = len(s) if end < 0 else end
        body = s[at:end]
        closed = body.endswith("*/")
        fits = [o for o in OPENERS[self.family] if body.startswith(o) and not (o.startswith("/*") and closed and len(o) + 2 > len(body))]
        opener = max(fits, key=len, default="")
        if opener:
            self.push(at, opener, True)
        stop = end - 2 if closed and opener.startswith("/*") else end
        self.words(at + len(opener), stop, True)
        if stop < end:
            self.push(stop, "*/", True)
        return end

    def escape(self, at: int) -> int:
        m = ESCAPE.match(self.source, at)
        text = m[0] if m else self.source[at]
        bare = text[1] if self.family != "rust" and text in ("\\'", '\\"') else None
        if text.strip() == text and not any(c.isspace() for c in text):
            self.push(at, text, canon=bare)
        else:
            self.words(at, at + len(text))
        return at + len(text)

    def code(self, at: int, until: str = "") -> int:
        """Lex code from ``at``; with ``until``, up to that closing bracket at this depth, which is left."""
        s, n, depth = self.source, len(self.source), 0
        while at < n:
            c = s[at]
            if c.isspace():
                at += 1
                continue
            if until and not depth and (s.startswith(until, at) or until == "}" and self.family == "python" and (c == ":" or c == "!" and s[at : at + 2] != "!=")):
                return at
            depth += c in "([{"
            depth -= c in ")]}" and depth > 0
            at = self.token(at)
        return at

    def token(self, at: int) -> int:
        s = self.source
        c = s[at]
        if self.family == "python":
            if c == "#":
                return self.comment(at)
            m = PYTHON_STRING.match(s, at)
            if m:
                return self.python_string(at, m)
        elif s.startswith(("//", "/*"), at):
            return self.comment(at)
        elif self.family == "rust":
            m = RAW_STRING.match(s, at)
            if m:
                self.words(at, m.end())
                return m.end()
            m = re.compile(r'[bc]?"').match(s, at)
            if m:
                return self.quoted(at, m[0], '"')
            m = CHARACTER.match(s, at)
            if m:
                self.push(at, m[0]) if not any(x.isspace() for x in m[0]) else self.words(at, m.end())
                return m.end()
            if c == "'":
                self.push(at, c)
                return at + 1
        else:
            if c in "\"'":
                return self.quoted(at, c, c, canon='"' if c == "'" else None)
            if c == "`":
                return self.template(at)
            if c == "/" and self.regex_follows():
                m = REGEX.match(s, at)
                if m:
                    self.push(at, "/")
                    body = m[1]
                    self.push(at + 1, body) if not any(x.isspace() for x in body) else self.words(at + 1, at + 1 + len(body))
                    self.push(at + 1 + len(body), "/")
                    if m[2]:
                        self.push(m.start(2), m[2])
                    return m.end()
        for pattern in (self.identifier, self.number, self.operators):
            m = pattern.match(s, at)
            if m:
                text = m[0]
                if pattern is self.number and ".." in text:
                    text = text[: text.index("..")]
                self.push(at, text)
                return at + len(text)
        self.push(at, c)
        return at + 1

    def regex_follows(self) -> bool:
        before = self.last()
        return not before or before in KEYWORDS - {"this"} or not (before[-1].isalnum() or before[-1] in "_)]}\"'`$")

    def quoted(self, at: int, opener: str, closer: str, canon: object = None) -> int:
        s = self.source
        self.push(at, opener, canon=canon)
        at = start = at + len(opener)
        while at < len(s) and s[at] != closer:
            if s[at] == "\\":
                self.words(start, at)
                at = start = self.escape(at)
            elif s[at] == "\n" and self.family == "script":
                break
            else:
                at += 1
        self.words(start, at)
        if at < len(s) and s[at] == closer:
            self.push(at, closer, canon=canon)
            at += 1
        return at

    def template(self, at: int) -> int:
        s = self.source
        self.push(at, "`")
        at = start = at + 1
        while at < len(s) and s[at] != "`":
            if s[at] == "\\":
                self.words(start, at)
                at = start = self.escape(at)
            elif s.startswith("${", at):
                self.words(start, at)
                self.push(at, "${")
                at = self.code(at + 2, "}")
                if at < len(s):
                    self.push(at, "}")
                at = start = at + 1
            else:
                at += 1
        self.words(start, min(at, len(s)))
        if at < len(s):
            self.push(at, "`")
        return at + 1

    def python_string(self, at: int, m: re.Match) -> int:
        s = self.source
        prefix, quote = m[1].lower(), m[2]
        canon = lambda text: text.lower().replace("'", '"')
        self.push(at, m[0], canon=canon(m[0]))
        at = start = m.end()
        formatted, raw = "f" in prefix or "t" in prefix, "r" in prefix
        while at < len(s) and not s.startswith(quote, at):
            if s[at] == "\\":
                if raw:
                    at += 2
                    continue
                self.words(start, at)
                at = start = self.escape(at)
            elif s[at] == "\n" and len(quote) == 1:
                break
            elif formatted and s.startswith(("{{", "}}"), at):
                self.words(start, at)
                self.push(at, s[at : at + 2])
                at = start = at + 2
            elif formatted and s[at] == "{":
                self.words(start, at)
                self.push(at, "{")
                at = self.code(at + 1, "}")
                if s[at : at + 1] == "!":
                    end = at + 1
                    while end < len(s) and s[end].isalnum():
                        end += 1
                    self.push(at, s[at:end])
                    at = end
                if s[at : at + 1] == ":":
                    end = at
                    while end < len(s) and s[end] not in "}\n":
                        end += 1
                    self.words(at, end)
                    at = end
                if s[at : at + 1] == "}":
                    self.push(at, "}")
                    at += 1
                start = at
            else:
                at += 1
        self.words(start, min(at, len(s)))
        if s.startswith(quote, at):
            self.push(at, quote, canon=canon(quote))
            at += len(quote)
        return at

    # commas, semicolons

    def settle(self) -> None:
        """Decide what separators count for, by the brackets that they stand in."""
        code = [p for p in self.pieces if not p.comment]
        held: list[dict] = [{"open": "", "kind": "", "commas": []}]
        segment: list[Piece] = []  # commas of the bare list that may be a tuple
        statement = ""
        for k, p in enumerate(code):
            before, after = code[k - 1] if k else None, code[k + 1] if k + 1 < len(code) else None
            new_line = self.family == "python" and len(held) == 1 and before is not None and p.line != before.line and before.text != "\\"
            if new_line or before is not None and before.text in (";", "{", "}") and self.family != "python":
                segment, statement = [], p.text
            elif before is None:
                statement = p.text
            if p.text in ("(", "[", "{") and p.canon is None and not p.literal:
                held.append({"open": p.text, "kind": self._kind(code, k, held[-1], statement), "commas": []})
            elif p.text in (")", "]", "}") and len(held) > 1 and not p.literal:
                top = held.pop()
                if top["kind"] == "tuple" and len(top["commas"]) == 1 and before is top["commas"][0]:
                    top["commas"][0].comma = False
            elif p.text == ";" and self.family == "script" and held[-1]["kind"] != "for" and not p.literal:
                p.canon = DROP
            elif p.text == "," and not p.literal:
                if held[-1]["kind"] == "type":
                    p.canon = DROP
                    continue
                p.comma = True
                held[-1]["commas"].append(p)
                if self.family == "python" and len(held) == 1:
                    segment.append(p)
                    ends = after is None or after.line != p.line or after.text in ("=", ";")
                    if len(segment) == 1 and ends:
                        p.comma = False
            elif self.family == "python" and len(held) == 1 and p.text in ("=", "return", "yield", "in", "for", ":", "import"):
                segment = []
        for k, p in enumerate(code):
            if not p.comma:
                continue
            before, after = code[k - 1] if k else None, code[k + 1] if k + 1 < len(code) else None
            if before is not None and before.text in (",", "(", "[", "{") and not before.literal:
                continue
            if after is not None and after.text in (")", "]", "}"):
                p.canon = DROP
            elif (after is None or after.line != p.line) and before is not None and before.line == p.line:
                p.separator = True

    def _kind(self, code: list[Piece], k: int, outer: dict, statement: str) -> str:
        """What an opening bracket opens: tuple, for, type, or nothing of note."""
        before = code[k - 1].text if k else ""
        if code[k].text == "(":
            if self.family == "script":
                return "for" if before == "for" or before == "await" and k > 1 and code[k - 2].text == "for" else ""
            called = bool(before) and before not in LOOSE and (before[-1].isalnum() or before[-1] in "_)]>\"'!?" and before not in ("->", "=>", ">=", ">>="))
            return "" if called else "tuple"
        if code[k].text == "{" and self.family == "script" and self.language != "javascript":
            row = [p.text for p in code[max(0, k - 12) : k]]
            if "interface" in row and not {"{", "}", ";", "="} & set(row[len(row) - row[::-1].index("interface") :]):
                return "type"
            if statement in ("type", "export", "declare") and before in ("=", "|", "&") and "type" in row:
                return "type"
            if outer["kind"] == "type" or before in ("<", "as", "|", "&"):
                return "type"
            if before == ":" and (outer["open"] in ("(", "") or outer["open"] == "{" and statement in ("let", "const", "var") and outer["kind"] == "block"):
                return "type"
        return ""


PYTHON_STRING = re.compile(r"((?:[rbuft]|rb|br|fr|rf|tr|rt)?)('''|\"\"\"|'|\")", re.I)
RAW_STRING = re.compile(r'[bc]?r(#*)".*?"\1', re.S)
CHARACTER = re.compile(r"b?'(?:\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'", re.S)
REGEX = re.compile(r"/((?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+)/([a-z]*)")


def pieces(source: str, language: str) -> list[Piece]:
    lexer = Lexer(source, language)
    if language in ("python", "rust", "typescript", "tsx", "javascript"):
        lexer.code(0)
        lexer.settle()
    else:
        lexer.words(0, len(lexer.source))
    return lexer.pieces


def normalize(source: str, language: str) -> list[Line]:
    """Tracked lines of a source: those with a token; code on a line wins over a comment on it."""
    rows: dict[tuple[int, bool], list[Piece]] = {}
    found = pieces(source, language)
    for p in found:
        rows.setdefault((p.line, p.comment), []).append(p)
    out = []
    for number in sorted({line for line, _ in rows}):
        for comment in (False, True):
            own = rows.get((number, comment), [])
            tokens = tuple(p.text if p.canon is None else p.canon for p in own if p.canon is not DROP)
            matched = tuple(p.text if p.canon is None else p.canon for p in own if p.canon is not DROP and not p.separator)
            if matched:
                out.append(Line(number + 1, "comment" if comment else "code", sum(bool(CONTENT.search(p.text)) for p in own), tokens, matched))
                break
    return out
