"""Tokens of program texts, in linear time: one pattern for each language, and a stack of states for strings with code inside, nested comments and here-documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

C_LIKE = ("//",), ("/*", "*/")
#: Line comment starts and block comments by language.
COMMENTS = {
    **dict.fromkeys(("rust", "javascript", "typescript", "jsx", "tsx", "go", "java", "c", "cpp", "csharp", "kotlin", "swift", "proto"), C_LIKE),
    "css": ((), ("/*", "*/")),
    "php": (("//", "#(?!\\[)"), ("/*", "*/")),
    "sql": (("--",), ("/*", "*/")),
    "html": ((), ("<!--", "-->")),
    "python": (("#",), None),
    "ruby": (("#",), None),
    "hcl": (("#", "//"), ("/*", "*/")),
}
NESTED = {"rust", "kotlin", "swift"}
SCRIPT = {"javascript", "typescript", "jsx", "tsx"}
#: Strings with code inside: their start, what opens code in them, what closes it, their end, and whether they may have several lines.
MIXED = {
    **{x: [("`", "${", "}", "`", True)] for x in SCRIPT},
    "kotlin": [('"""', "${", "}", '"""', True), ('"', "${", "}", '"', False)],
    "swift": [('"""', "\\(", ")", '"""', True), ('"', "\\(", ")", '"', False)],
    "ruby": [('"', "#{", "}", '"', True), ("`", "#{", "}", "`", True)],
    "csharp": [('$"', "{", "}", '"', False)],
    "php": [('"', "{$", "}", '"', True)],
}
#: Strings that go to their end whatever stands in them.
WHOLE = {"java": ['"""'], "csharp": ['"""'], "python": ['"""', "'''"], "go": ["`"]}
#: Words after which a slash starts a regular expression.
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "and", "or", "not", "if", "unless", "while", "when"}
OPEN = re.compile(r"<\?(?:php\b|=)")
PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
NAMES = {"ruby": r"(?:@@?|\$)?[^\W\d]\w*(?:[?!](?![=~]))?", "php": r"\$?[^\W\d]\w*", "rust": r"(?:r\#)?[^\W\d]\w*", "kotlin": r"[^\W\d]\w*|`[^`\n]*`", "swift": r"[^\W\d]\w*|`[^`\n]*`", **{x: r"\#?(?:[^\W\d]|\$)[\w$]*" for x in SCRIPT}}
MARKS = r"=>|\?->|->|::|\?\.(?!\d)|[!=<>]=+|&&|\|\||!!|\.\.+|."


@dataclass(frozen=True)
class Rules:
    token: re.Pattern
    block: tuple[str, str] | None
    both: re.Pattern | None
    nests: bool
    mixed: dict[str, tuple]


@cache
def _rules(language: str | None) -> Rules:
    lines, block = COMMENTS.get(language, ((), None))
    mixed = {m[0]: m for m in MIXED.get(language, [])}
    parts = [("space", r"[^\S\n]+|\n")]
    if language in ("c", "cpp"):
        parts.append(("directive", r"(?m:^[ \t]*)\#(?:[^\n\\]|\\.)*+"))
    parts += [("line", "|".join(rf"(?:{x})[^\n]*" for x in lines))] if lines else []
    parts += [("block", re.escape(block[0]))] if block else []
    if language in ("rust", "cpp"):
        parts.append(("raw", r'b?r\#*"' if language == "rust" else r'(?:u8?|U|L)?R"[^()\\\s]{0,16}\('))
    if language in ("php", "ruby"):
        parts.append(("here", r"<<<[ \t]*(?:\"\w+\"|'\w+'|[^\W\d]\w*)(?=\n)" if language == "php" else r"<<[~-]?(?:\"[A-Za-z_]\w*\"|'[A-Za-z_]\w*'|[A-Z_]\w*)"))
    if language == "php":
        parts.append(("leave", r"\?>"))
    if language == "csharp":
        parts.append(("text", r'\$?@\$?"(?:[^"]|"")*+"?'))
    parts += [("whole", "|".join(map(re.escape, WHOLE[language])))] if language in WHOLE else []
    parts += [("mixed", "|".join(re.escape(m) for m in mixed))] if mixed else []
    if language == "rust":
        parts.append(("text", r"""b?"(?:[^"\\]|\\.)*+"?|b?'(?:\\[^\n][^'\n]{0,10}|[^'\\\n])'"""))
        parts.append(("number", r"'\w+|\d\w*(?:\.\d\w*)?"))
    elif language != "html":
        quotes = [q for q in ("\"'" if language not in ("swift",) else '"') + ("`" if language not in MIXED and language not in WHOLE else "") if q not in mixed]
        parts += [("text", "|".join(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}?" if q != "`" else r"`(?:[^`\\]|\\.)*+`?" for q in quotes))] if quotes else []
        parts.append(("number", r"\d(?:[\w']|\.\d)*" if language in ("c", "cpp") else r"\d\w*(?:\.\d\w*)?" + (r"|:[^\W\d]\w*[?!]?" if language == "ruby" else "")))
    parts += [("name", NAMES.get(language, r"[^\W\d]\w*")), ("mark", MARKS)]
    seen, pattern = set(), []
    for kind, p in parts:  # a kind may stand for two patterns
        pattern.append(rf"(?P<{kind}>{p})" if kind not in seen else rf"(?P<{kind}_>{p})")
        seen.add(kind)
    both = re.compile("|".join(map(re.escape, block))) if block else None
    return Rules(re.compile("|".join(pattern), re.S), block, both, language in NESTED, mixed)


@cache
def _inside(start: str, code: str, end: str, lines: bool) -> re.Pattern:
    doubled = r"\{\{|\}\}|" if code == "{" else ""
    return re.compile(rf"{doubled}{re.escape(code)}|\\.|{re.escape(end)}" + ("" if lines else r"|\n"), re.S)


def tokens(text: str, language: str | None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of everything but white space: name, number, mark, text (a string or a part of one), pattern, directive, comment."""
    rules, n, i = _rules(language), len(text), 0
    states: list[list] = []  # of code in strings: string, depth of brackets
    waiting: list[str] = []  # here-documents that begin with the next line
    last, bad = "", -1  # the last token; a slash before this place starts no pattern
    if language == "php":
        found = OPEN.search(text)
        i = found.end() if found else n
        yield "text", 0, i
    while i < n:
        m = rules.token.match(text, i)
        kind, at, i = m.lastgroup.rstrip("_"), i, m.end()
        value = m.group()
        if kind == "space":
            if waiting and value == "\n":
                begin = i
                for name in waiting:
                    found = re.compile(rf"^[ \t]*{name}\b", re.M).search(text, i)
                    i = found.end() if found else n
                waiting = []
                yield "text", begin, i
            continue
        if kind == "line":
            yield "comment", at, i
            continue
        if kind == "block":
            depth = 1
            while depth and (found := rules.both.search(text, i)):
                i = found.end()
                depth += -1 if found.group() == rules.block[1] else 1 if rules.nests else 0
            i = n if depth else i
            yield "comment", at, i
            continue
        if kind in ("raw", "whole", "leave", "here"):
            if kind == "here" and language == "ruby":
                waiting.append(value.strip("<~-\"'"))
                end = i
            elif kind == "here":
                found = re.compile(rf"^[ \t]*{re.sub(r'[^A-Za-z0-9_]', '', value)}\b", re.M).search(text, i)
                end = found.end() if found else n
            elif kind == "leave":
                found = OPEN.search(text, i)
                end = found.end() if found else n
            else:
                close = value if kind == "whole" else '"' + "#" * value.count("#") if language == "rust" else ")" + value[value.index('"') + 1 : -1] + '"'
                end = text.find(close, i)
                end = n if end < 0 else end + len(close)
            if kind == "leave":
                yield "mark", at, at + 1  # ends a statement as a semicolon does
            yield "text", at, end
            i, last = end, "text"
            continue
        if kind == "mark" and value == "/" and (language in SCRIPT or language == "ruby") and at >= bad and not (last in ("text", "number", "operand", ")", "]")):
            if found := PATTERN.match(text, at):
                i, last = found.end(), "text"
                yield "pattern", at, i
                continue
            bad = text.find("\n", at) % (n + 1)
        state = None
        if kind == "mixed":
            state = rules.mixed[value]
        elif kind == "mark" and states:
            string, depth = states[-1]
            close = string[2]
            if value == close and not depth:
                states.pop()
                state = string
                yield "mark", at, i
                at = i
            elif value == close:
                states[-1][1] -= 1
            elif value == {"}": "{", ")": "("}[close]:
                states[-1][1] += 1
        if state is None:
            yield kind, at, i
            last = value if kind == "mark" else kind if kind != "name" else "word" if value in BEFORE_PATTERN else "operand"
            continue
        inside = _inside(state[0], state[1], state[3], state[4])
        while True:
            found = inside.search(text, i)
            if not found:
                i = n
                yield "text", at, i
            else:
                what, i = found.group(), found.end()
                if what == state[1]:
                    yield "text", at, found.start()
                    brace = 2 if state[1] == "{$" else 1
                    i -= brace - 1
                    yield "mark", found.start(), i
                    states.append([state, 0])
                    last = "("
                    break
                if what not in (state[3], "\n"):
                    continue
                i -= what == "\n"
                yield "text", at, i
            last = "text"
            break
