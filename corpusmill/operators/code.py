"""Definitions and edges of languages with braces, of Ruby and of CSS, by one pass over the tokens of a file.

There is no syntax tree: declarations are told by their keywords and by names with parameters in a type's body, calls by a name before an argument list, the ends of both by matching
brackets, which are found once, so that the time is linear. What only types or macros tell is not seen. Lines count from 1; a call's line is the first of its whole expression.

Scopes are functions and the types that the language's row in SCOPES names. Rust: macros' arguments are no calls, a path gives its whole text, its last name and what stands before; Go: selectors stay
whole; Kotlin: only leading names; C and C++: only bare names, without scopes; Java and Go selectors: no calls are left out as builtin.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from corpusmill.operators.graph import EDGE, first_edges
from corpusmill.operators.lexer import tokens

SCRIPT = ("javascript", "typescript", "jsx", "tsx")
LANGUAGES = ("c", "cpp", "csharp", "css", "go", "java", "javascript", "jsx", "kotlin", "php", "ruby", "rust", "swift", "tsx", "typescript")
#: What a keyword declares, by language.
DECLARES = {
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "mod", "const": "constant", "type": "type_alias"},
    **{x: {"function": "function", "class": "class"} for x in ("javascript", "jsx")},
    **{x: {"function": "function", "class": "class", "interface": "interface", "type": "type_alias"} for x in ("typescript", "tsx")},
    "go": {"func": "function", "type": "struct"},
    "java": {"class": "class", "interface": "interface", "enum": "enum"},
    "php": {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum"},
    "csharp": {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "struct"},
    "kotlin": {"class": "class", "interface": "class", "object": "class", "fun": "function"},
    "swift": {"class": "class", "struct": "class", "enum": "class", "extension": "class", "actor": "class", "protocol": "interface", "func": "function", "init": "method"},
    "c": {"struct": "struct", "enum": "enum"},
    "cpp": {"class": "class", "struct": "struct"},
}
#: Kinds of definitions that are scopes of edges; a constructor is one in C# only, a generator and TSX none.
SCOPES = {
    "rust": {"function", "method"},
    "javascript": {"function", "class"},
    "typescript": {"function", "class"},
    "go": {"function", "method"},
    "java": {"class", "method"},
    "php": {"function", "method", "class"},
    "csharp": {"class", "struct", "interface", "method", "constructor"},
    "kotlin": {"class", "function", "method"},
    "swift": {"class", "interface", "function", "method"},
}
#: Words that stand before a parenthesis or a brace without being called.
WORDS = {
    "rust": "if else while for loop match return in as fn move where let await unsafe break",
    "javascript": "if else for while do switch return catch in of new await typeof function throw yield import void delete case super this instanceof default extends",
    "go": "if else for switch return func go defer select range case import var const type chan",
    "java": "if else for while do switch return catch new super this synchronized throw throws assert try instanceof case yield",
    "php": "if elseif else for foreach while do switch match return catch new throw function fn use array list isset unset empty exit die echo print include include_once require require_once clone instanceof case yield declare and or xor not",
    "csharp": "if else for foreach while do switch return catch new throw lock using fixed in is as case when await typeof sizeof default checked unchecked nameof_ yield",
    "kotlin": "if else for while do when return catch in is as throw try finally constructor init get set fun object this super",
    "swift": "if else for while repeat switch guard return catch in is as throw throws try case let var func where defer do init subscript some any",
    "c": "if else for while do switch return case sizeof typeof goto",
    "cpp": "if else for while do switch return catch case sizeof typeof alignof decltype static_assert noexcept new delete throw operator requires goto",
    "ruby": "if elsif else unless while until case when then end begin rescue ensure def class module return yield self nil true false and or not in do for next break redo retry super alias undef",
    "css": "",
}
WORDS = {x: set(names.split()) for x, names in WORDS.items()}
#: Calls of what every program of a language has.
BUILTIN = {
    "rust": "Ok Err Some None Box Vec String Default From Into Clone Drop",
    "javascript": "require import console setTimeout setInterval clearTimeout clearInterval Promise Array Object String Number Boolean Error Map Set JSON Math Date Symbol parseInt parseFloat isNaN fetch",
    "go": "make new len cap append copy delete close panic recover print println",
    "php": "isset unset empty count echo print printf sprintf var_dump die exit array in_array array_map array_filter array_merge implode explode strlen str_replace trim is_array is_null is_string gettype intval strval",
    "ruby": "puts print p pp raise require require_relative loop lambda proc attr_accessor attr_reader attr_writer new freeze dup clone send format sprintf Integer String Array Hash",
    "csharp": "WriteLine Write ToString Equals GetHashCode GetType Parse TryParse Format Add Remove Contains Count Select Where First FirstOrDefault Any All ToList ToArray nameof typeof",
    "kotlin": "println print listOf mutableListOf mapOf mutableMapOf setOf arrayOf emptyList emptyMap let run apply also with require requireNotNull check error TODO lazy map filter forEach toString",
    "swift": "print debugPrint assert assertionFailure precondition fatalError map filter reduce forEach compactMap flatMap sorted append insert remove contains count min max abs String Int Array",
    "c": "printf fprintf sprintf snprintf scanf fscanf malloc calloc realloc free memcpy memmove memset memcmp strlen strcpy strncpy strcmp strncmp fopen fclose fread fwrite fgets fputs assert exit abort",
}
BUILTIN = {x: set(names.split()) for x, names in BUILTIN.items()}
for _x, _y in (("typescript", "javascript"), ("jsx", "javascript"), ("tsx", "javascript"), ("cpp", "c")):
    BUILTIN[_x] = BUILTIN[_y]
    WORDS.setdefault(_x, WORDS[_y])
#: Words that may stand before a declaration and belong to it.
MODIFIERS = set("pub async unsafe extern public private protected internal static final abstract sealed open override data inner inline suspend operator infix tailrec external enum annotation companion readonly partial virtual new required convenience mutating nonmutating class indirect fileprivate default strictfp synchronized native value lateinit vararg noinline crossinline actual expect const".split())
LINES = {"kotlin", "swift", "go", *SCRIPT}  # a line's end may end a statement
GOES_ON = set("{ : . ?. , = -> => ) ] < & | || && + where throws async rethrows".split())
OPEN_END = set("( [ , : = -> => < & | || && + . ?. { extends implements func fun function class interface struct enum object extension protocol actor type".split())
HOLDERS = {"class", "interface", "struct", "enum", "trait", "impl"}
DOTS = {".", "?.", "::", "->", "?->"}
PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Definition:
    kind: str
    name: str
    first: int
    last: int = 0
    bases: list[tuple[str, str]] = field(default_factory=list)  # (kind of edge, target)


@dataclass
class Scan:
    definitions: list[Definition] = field(default_factory=list)
    calls: list[tuple[str | None, str, int]] = field(default_factory=list)  # innermost scope, name, line
    imports: list[tuple[str | None, str, int]] = field(default_factory=list)
    bases: list[tuple[str | None, str, str, int]] = field(default_factory=list)  # scope, kind of edge, target, line


@dataclass
class Frame:
    end: int
    holder: str | None  # the kind of type whose body this is
    name: str | None
    scope: str | None


class Code:
    """The tokens of a file, with the partner of each bracket, the first token of each postfix expression, and the end of what begins at each token."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.script, self.words = text, language, language in SCRIPT, WORDS[language]
        found = [t for t in tokens(text, language) if t[0] != "comment" and t[2] > t[1]]
        self.kind = [k for k, _, _ in found]
        self.at, self.end = [a for _, a, _ in found], [b for _, _, b in found]
        self.value = [text[a:b] if k != "text" else '"' for k, a, b in found]
        for i, v in enumerate(self.value):
            self.value[i] = {"${": "{", "#{": "{", "\\(": "("}.get(v, v)
        self.n, self.headed = len(found), set()
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.row = [bisect_left(self.breaks, a) + 1 for a in self.at]
        self._match()
        self._firsts()
        self._ends()

    def _match(self) -> None:
        self.partner: list[int | None] = [None] * self.n
        stack: list[int] = []
        for i, v in enumerate(self.value):
            if self.kind[i] != "mark":
                continue
            if v in "([{":
                stack.append(i)
            elif v == "<" and i and (self.kind[i - 1] == "name" or self.value[i - 1] in ("::", ".")):
                stack.append(i)
            elif v == ">" and stack and self.value[stack[-1]] == "<":
                self.partner[i], self.partner[stack[-1]] = stack[-1], i
                stack.pop()
            elif v in PAIRS or v in (";", "&&", "||"):
                while stack and self.value[stack[-1]] == "<":
                    stack.pop()
                if v in PAIRS and stack and self.value[stack[-1]] == PAIRS[v]:
                    self.partner[i], self.partner[stack[-1]] = stack[-1], i
                    stack.pop()
        for i in stack:
            if self.value[i] == "{":
                self.partner[i] = self.n  # open to the end

    def _operand(self, i: int) -> bool:
        return i >= 0 and (self.value[i] in (")", "]") or self.kind[i] in ("text", "number", "pattern") or (self.kind[i] == "name" and (self.value[i] not in self.words or self.value[i] in ("this", "super"))) or (self.value[i] == "}" and self.language in ("kotlin", "swift")))

    def before_arguments(self, i: int) -> int:
        """The token that is called by an argument list at ``i``, past type arguments."""
        k = i - 1
        if k >= 0 and self.value[k] == ">" and self.partner[k] is not None:
            k = self.partner[k] - 1
            k -= k >= 0 and self.value[k] == "::"
        return k

    def _firsts(self) -> None:
        self.first = list(range(self.n))
        for i, v in enumerate(self.value):
            if self.kind[i] == "name" and i > 1 and self.value[i - 1] in DOTS:
                p = i - 2
                p -= self.value[p] in ("!", "?", "!!")
                if p >= 0 and self.value[p] == ">" and self.partner[p] is not None:
                    p = self.before_arguments(p + 1)
                self.first[i] = self.first[p] if self._operand(p) else i - 1
            elif v in (")", "]", "}") and (m := self.partner[i]) is not None and self.kind[i] == "mark":
                p = self.before_arguments(m) if v == ")" else m - 1
                self.first[i] = m
                if self._operand(p) and v != "}":
                    f = self.first[p]
                    self.first[i] = f - 1 if f and self.value[f - 1] == "new" else f
                elif v == "}" and self.language in ("kotlin", "swift") and self._operand(p):
                    self.first[i] = self.first[p]

    def _ends(self) -> None:
        """``body``: the brace that opens the body of what is declared, or the token that ends it without one; ``stop``: the token after a statement."""
        self.body, self.stop = [self.n] * (self.n + 1), [self.n] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            v, new = self.value[i], self.language in LINES and i and self.row[i] > self.row[i - 1] and self.value[i] not in GOES_ON and self.value[i - 1] not in OPEN_END
            after = self.partner[i] + 1 if v in ("(", "[", "{") and self.kind[i] == "mark" and self.partner[i] is not None else i + 1
            after = min(after, self.n)
            if new or (self.kind[i] == "mark" and v in (";", ")", "]", "}")):
                self.body[i] = self.stop[i] = i
                continue
            ends = v == "{" or (v == "=" and self.language == "kotlin") or (v == "=>" and self.language in ("csharp", "php"))
            self.body[i], self.stop[i] = i if ends and self.kind[i] == "mark" else self.body[after], self.stop[after]

    def word(self, i: int) -> str | None:
        return self.value[i] if 0 <= i < self.n and self.kind[i] == "name" else None

    def is_(self, i: int, *values: str) -> bool:
        return 0 <= i < self.n and self.kind[i] == "mark" and self.value[i] in values

    def source(self, a: int, b: int) -> str:
        """The text from token a to before token b."""
        return self.text[self.at[a] : self.end[b - 1]] if b > a else ""

    def begin(self, i: int) -> int:
        """The first token of the modifiers and annotations before a declaration."""
        while i:
            p = i - 1
            if self.value[p] in (")", "]") and self.partner[p] is not None and self.kind[p] == "mark":
                q = self.partner[p]
                if self.value[p] == ")" and self.word(q - 1) and self.is_(q - 2, "@"):
                    i = q - 2
                elif self.value[p] == ")" and self.word(q - 1) in ("pub", "private", "internal"):
                    i = q - 1
                elif self.value[p] == "]" and self.language == "csharp" and (not q or self.value[q - 1] in ("{", "}", ";", "]")):
                    i = q
                else:
                    return i
            elif self.word(p) in MODIFIERS and not (self.script and self.word(p) != "async"):
                i = p
            elif self.word(p) and self.is_(p - 1, "@"):
                i = p - 1
            else:
                return i
        return i


def _names(c: Code, a: int, b: int, kinds: bool = False) -> list[str]:
    """Entries between commas at the level of token a, with type arguments cut unless ``kinds``."""
    out, i, begin = [], a, a
    while i <= b:
        if i == b or c.is_(i, ","):
            end = next((k for k in range(begin, i) if not kinds and c.is_(k, "<", "(")), i)
            out += [c.source(begin, end)] if end > begin else []
            begin = i + 1
        i = c.partner[i] + 1 if i < b and c.is_(i, "(", "[", "<", "{") and c.partner[i] is not None and c.partner[i] < b else i + 1
    return out


def _bases(c: Code, keyword: str, name: int, body: int) -> list[tuple[str, str]]:
    """(kind of edge, target) of a type's header from its name to its body."""
    x, out = c.language, []
    if x in ("java", "php") and keyword == "class":
        at = {c.value[k]: k for k in range(name + 1, body) if c.value[k] in ("extends", "implements", "permits") and not c.is_(k - 1, "<", "&", ",") and c.value[k - 2] != "<"}
        marks = sorted(at.values()) + [body]
        for word, edge in (("extends", "extends"), ("implements", "implements")):
            if word in at:
                said = c.source(at[word] + 1, marks[marks.index(at[word]) + 1])
                found = [said] if x == "java" and word == "extends" else said.split(",")  # by commas, as the rule says, those of type arguments too
                out += [(edge, n.strip()) for n in found if n.strip() and (x == "java" or "\\" not in n)]
    elif x in ("csharp", "kotlin", "swift") and (x != "csharp" or keyword != "enum") and not (x == "swift" and keyword == "protocol"):
        k = name + 1
        while k < body and not c.is_(k, ":"):
            k = c.partner[k] + 1 if c.is_(k, "(", "[", "<") and c.partner[k] is not None else k + 1
        end = next((j for j in range(k, body) if c.word(j) == "where"), body)
        for n in _names(c, k + 1, end, kinds=x == "csharp"):
            if x == "csharp":
                out += [("extends", n)] if re.fullmatch(r"[\w.]+(?:<.*>)?", n, re.S) else []
            else:
                n = re.split(r"\s", re.sub(r"^(?:@\w+\s+)*", "", n))[0]
                out += [("extends", n.split(".")[-1])] if n else []
    return out


def _imported(c: Code, i: int, frame: Frame) -> tuple[str, int] | None:
    """What an import at token i names, and the token after it."""
    x, v, stop = c.language, c.value[i], c.stop[i + 1]
    opens = not i or c.value[i - 1] in (";", "{", "}", "]", "pub", ")", "global", '"') or (x in LINES and c.row[i] > c.row[i - 1])
    if x == "rust" and v == "use" and opens:
        text = c.source(c.begin(i), stop)
        while text.startswith("use "):
            text = text[4:]
        return text.strip(), stop
    if c.script and v == "import" and opens and not c.is_(i + 1, "(", "."):
        k = next((k for k in range(i + 1, stop) if c.kind[k] == "text" or c.is_(k, "=")), stop)
        return (_unquoted(c, k) if k < stop and c.kind[k] == "text" else ""), stop
    if x == "java" and v == "import":
        k = i + 1 + (c.word(i + 1) == "static")
        return re.sub(r"\s|\.\s*\*$", "", c.source(k, stop)), stop
    if x == "php" and v in ("require", "include", "require_once", "include_once") and i + 1 < c.n and c.kind[i + 1] == "text":
        return _unquoted(c, i + 1), i + 2
    if x == "php" and v == "use" and not c.is_(i + 1, "(") and not frame.holder:
        return c.source(i + 1, stop).strip(), stop
    if x == "csharp" and v == "using" and opens:
        said = re.sub(r"^(?:static|unsafe)\s+", "", c.source(i + 1, stop))
        found = re.fullmatch(r"([\w.]+)(?:\s*=.*)?", said, re.S) if "(" not in said else None
        return (found[1], stop) if found and not (frame.scope and "=" in said) else None
    if x in ("kotlin", "swift") and v == "import" and opens:
        k = i + 1 + (x == "swift" and c.word(i + 1) in ("class", "struct", "func", "enum", "protocol", "var", "let", "typealias"))
        end = k + 1
        while c.is_(end, ".") and c.word(end + 1) and c.row[end + 1] == c.row[i]:
            end += 2
        return c.source(k, min(end, c.n)), max(end, stop)
    return None


def _unquoted(c: Code, k: int) -> str:
    return c.text[c.at[k] : c.end[k]].strip("\"'`")


def _called(c: Code, i: int) -> tuple[list[str], int]:
    """The names that a call whose arguments begin at token i gives, and the first token of its expression."""
    k, x = c.before_arguments(i), c.language
    name, generic = c.word(k), k != i - 1
    if not name or (name in c.words and not c.is_(k - 1, *DOTS)):
        return [], k
    first = c.first[k]
    before, dot = (c.value[first - 1] if first else ""), c.value[k - 1] if k and c.value[k - 1] in DOTS else ""
    if before == "new" or (before == "@" and not c.script) or (before == "async" and c.script):
        return [], k
    names = [name]
    if x == "rust":
        if generic or name in ("Fn", "FnMut", "FnOnce", "pub", "crate", "Self") and not dot and name != "Self":
            return [], k
        if dot == "::":
            names = [c.source(first, k + 1), name, c.source(first, k - 1)]
    elif x == "go":
        if c.is_(k - 1, "]"):
            return [], k
        names = [c.source(first, k + 1)] if dot else names
    elif x == "php" and (name.startswith("$") or dot == "?->" or c.is_(k - 1, "\\")):
        return [], k
    elif x == "csharp" and (dot == "?." or (generic and not dot)):
        return [], k
    elif x == "csharp" and generic:
        names = [c.source(k, i)]
    elif x in ("kotlin", "c", "cpp") and dot:
        return [], k
    elif x in ("c", "cpp") and (generic or (c.word(k - 1) and c.value[k - 1] not in c.words)):
        return [], k
    elif x == "swift" and (before == "case" or c.is_(first, ".") or c.value[first] == "super" and name == "init"):
        return [], k
    if x == "go" and dot:
        return names, first
    return [n for n in names if n not in BUILTIN.get(x, ())], first


def _braces(c: Code, out: Scan) -> None:
    x, declares = c.language, DECLARES[c.language]
    scopes = SCOPES.get(x, set())
    stack, opens, jump = [Frame(c.n, None, None, None)], {}, {}
    i = begin = 0

    def declare(kind: str, name: str, first: int, body: int, chunk: bool = True, scope: bool = True) -> Frame:
        """A definition whose body begins at a token, or has none."""
        braced, word = c.is_(body, "{"), body < c.n and c.is_(body, "=", "=>")
        last = c.partner[body] if braced and c.partner[body] is not None else c.stop[body + 1] - 1 if word else body if c.is_(body, ";") else body - 1
        inner = name if scope and kind in scopes else stack[-1].scope
        if chunk:
            out.definitions.append(Definition("method" if kind == "constructor" else kind, name, c.row[first], c.row[min(max(last, first), c.n - 1)]))
        frame = Frame(min(last, c.n), kind if kind in HOLDERS else None, name, inner)
        if braced:
            opens[body] = frame
        elif word:
            stack.append(frame)
        return frame

    while i < c.n:
        i = jump.pop(i, i)
        while len(stack) > 1 and i > stack[-1].end:
            stack.pop()
        frame, v, kind = stack[-1], c.value[i], c.kind[i]
        at_level = frame.holder is not None
        if kind == "directive":
            if found := re.match(r"\s*#\s*include\s*(?:<([^>\n]*)>|\"([^\"\n]*)\")", c.text[c.at[i] : c.end[i]]):
                out.imports.append((None, found[1] or found[2] or "", c.row[i]))
        elif kind == "mark":
            if v == "{":
                stack.append(opens.pop(i, None) or Frame(c.n if c.partner[i] is None else c.partner[i], "class" if x in ("java", "csharp") and c.is_(i - 1, ")") and c.value[c.first[i - 1]] == "new" else None, None, frame.scope))
                if x in ("kotlin", "swift") and i and c.row[i - 1] == c.row[i] and c.word(i - 1) and c.value[i - 1] not in c.words and i not in jump and not stack[-1].holder and stack[-1].name is None and x == "kotlin":
                    names, first = _called(c, i)
                    out.calls += [(frame.scope, n, c.row[first]) for n in names if n not in ("else", "try", "init", "get", "set", "object", "finally", "do", "companion")]
            begin = i + 1 if v in ("{", "}", ";") else begin
            if v == "#" and x == "rust" and c.is_(i + 1 + c.is_(i + 1, "!"), "["):
                i = max(i, c.partner[i + 1 + c.is_(i + 1, "!")] or i)
            elif v == "!" and x == "rust" and c.word(i - 1) and i + 1 < c.n:
                k = i + 1 + bool(c.word(i + 1))
                i = c.partner[k] if c.is_(k, "(", "[", "{") and c.partner[k] is not None else i
            elif v == "[" and x == "csharp" and begin == i and c.partner[i] is not None:
                i = c.partner[i]
            elif v == "(" and i:
                k = c.before_arguments(i)
                name, close = c.word(k), c.partner[i]
                after = c.n if close is None else close + 1
                begins = x not in ("c", "cpp", "csharp", "java") or not any(c.is_(j, "=") for j in range(max(begin, k - 8), k))
                direct = name and c.value[k - 1] not in DOTS and c.value[k - 1] not in ("=", "=>", "(", ",", "?", ":", "+", "&&", "||", "!", "return", "new", "await") or (name and k == begin)
                if x == "java" and frame.holder == "enum" and name and (k == begin or c.is_(k - 1, ",")) and not (name == frame.name and c.is_(after, "{")):
                    pass  # a constant
                elif x in ("java", "csharp") and at_level and direct and begins:
                    if not c.is_(k - 1, "@"):
                        builds = k == begin or c.value[k - 1] in MODIFIERS
                        builds = builds and name == frame.name
                        body = c.body[after]
                        declare("constructor" if builds else "method", name, min(begin, k), body, scope=x == "csharp" or not builds)
                        i = max(i, (body if c.is_(body, "{", "=>", ";") else after) - 1)
                elif c.script and name and name not in c.words and c.value[k - 1] not in DOTS and (c.is_(after, "{") or (at_level and (direct or k == begin))):
                    body = _past_type(c, after) if at_level else after
                    if c.is_(body, "{"):
                        declare("method", name, k, body, scope=False)
                        jump[after] = body
                elif x in ("c", "cpp") and name and name not in c.words and (len(stack) == 1 or at_level or frame.name == "") and begins:
                    body = c.body[after]
                    if c.is_(body, "{") and not c.is_(k - 1, "="):
                        declare("function", name, begin, body)
                        opens[body].name = name
                        i = body - 1
                    else:
                        i = after - 1
                elif x == "go" and frame.holder == "interface" or x in ("rust", "swift") and frame.holder == "enum" or x == "swift" and (c.word(k - 1) == "case" or at_level and c.is_(k - 1, ",")):
                    i = max(i, after - 1)
                elif x == "rust" and name and close is not None and (c.is_(after, "=>") or c.word(after) == "if") and c.value[c.first[k] - 1] in ("{", "}", ",", "|", "(", "&"):
                    i = close  # a pattern
                else:
                    names, first = _called(c, i)
                    out.calls += [(frame.scope, n, c.row[first]) for n in names]
        elif kind == "text" and c.script and i and c.text[c.at[i]] == "`" and c.word(i - 1) and c.end[i - 1] == c.at[i]:
            names, first = _called(c, i)
            out.calls += [(frame.scope, n, c.row[first]) for n in names]
        elif kind == "name":
            found = _imported(c, i, frame)
            if found:
                out.imports += [(frame.scope, found[0], c.row[c.begin(i) if x == "rust" else i])] if found[0] else []
                i = max(i, found[1] - 1)
            elif x == "go" and v == "import":
                end = c.partner[i + 1] if c.is_(i + 1, "(") and c.partner[i + 1] is not None else c.stop[i + 1]
                for k in range(i + 1, end):
                    if c.kind[k] == "text":
                        j = k - 1 if c.word(k - 1) not in (None, "import") or c.is_(k - 1, ".") else k
                        out.imports.append((None, c.text[c.at[k] : c.end[k]].strip('"'), c.row[j]))
                i = max(i, end - 1)
            elif x == "rust" and v == "let":
                end = i + 1
                while end < c.n and not c.is_(end, "=", ";", "{", "}", ":"):
                    end = c.partner[end] + 1 if c.is_(end, "(", "[") and c.partner[end] is not None else end + 1
                i = end - 1
            elif v in ("namespace", "extern") and x in ("cpp", "c", "csharp") and c.is_(c.body[i], "{"):
                opens[c.body[i]] = Frame(c.partner[c.body[i]] or c.n, None, "", frame.scope)
            elif v in declares and not c.is_(i - 1, *DOTS) and not c.is_(i + 1, ":", ",", ")", "=", "."):
                i = _declared(c, i, frame, declare, jump, stack, out)
        i += 1


def _past_type(c: Code, i: int) -> int:
    """The brace that opens a body after parameters, past a returned type that is itself in braces."""
    body = c.body[i]
    if c.is_(i, ":") and c.is_(body, "{") and body < c.n and c.partner[body] is not None and c.is_(body - 1, ":", "|", "<", "&"):
        return c.body[c.partner[body] + 1]
    return body


def _declared(c: Code, i: int, frame: Frame, declare, jump: dict[int, int], stack: list[Frame], out: Scan) -> int:
    """Takes the declaration at a keyword; the last token that is done with."""
    x, v, kind = c.language, c.value[i], DECLARES[c.language][c.value[i]]
    k, first, body = i + 1, c.begin(i), c.body[i + 1]
    before = c.value[i - 1] if i else ""
    if x == "kotlin" and v == "class" and before in ("::",):
        return i
    if c.script and v in ("function", "class"):
        before = c.value[i - 2] if before == "async" and i > 1 else before
        same = c.row[i] == c.row[i - 1] if i else False
        if before and before not in (";", "{", "}", "export", "default", ")", '"', "declare", "abstract") and (same or before in OPEN_END | {"return"}):
            return i  # an expression, without a name of its own here
        first = i - 1 if i and c.value[i - 1] in ("async", "abstract") else i
    if x == "go" and v == "func":
        if c.is_(k, "("):
            k = (c.partner[k] if c.partner[k] is not None else c.n) + 1
            kind = "method"
        if not c.word(k) or not (c.is_(k + 1, "(", "[")) or frame.end != c.n:
            return i
    if x == "go" and v == "type":
        end = c.partner[k] if c.is_(k, "(") and c.partner[k] is not None else None
        last, k = i, k + (end is not None)
        while c.word(k) and (end is None or k < end):
            j = c.partner[k + 1] + 1 if c.is_(k + 1, "[") and c.partner[k + 1] is not None and c.partner[k + 1] > k + 2 else k + 1
            shape, stop = c.word(j), c.stop[j] if j < c.n else c.n
            body = c.body[j] if shape in ("struct", "interface") else stop
            declare("interface" if shape == "interface" else "struct", c.value[k], k if end else i, body)
            last = body - 1 if c.is_(body, "{") else stop - 1
            if end is None:
                break
            k = stop + c.is_(stop, ";")
        return max(i, last if end is None else i)
    if x == "rust":
        if v == "impl":
            cut = next((j for j in range(k, body) if c.word(j) == "for" and not c.is_(j + 1, "<")), k - 1) + 1
            if cut == k and c.is_(k, "<") and c.partner[k] is not None:
                cut = c.partner[k] + 1
            elif cut == k and c.is_(k, "<"):
                cut = next((j + 1 for j in range(k, body) if c.is_(j, ">")), k)
            names = [c.value[j] for j in range(cut, body) if c.word(j) and (c.is_(j + 1, "<", "{") or c.word(j + 1) == "where" or j + 1 == body)]
            if c.is_(body, "{") and names:
                declare("impl", names[0], first, body)
            return max(i, body - 1)
        if v == "const" and (c.word(k) in ("fn", "unsafe", "async", "extern") or not c.word(k) or not c.is_(k + 1, ":")):
            return i
        kind = "method" if v == "fn" and frame.holder in ("impl", "trait") else kind
        if v in ("const", "type"):
            body = c.stop[k]
            declare(kind, c.value[k], first, body)
            return i + 1
    if c.script and v == "type" and not c.is_(k + 1, "=", "<"):
        return i
    if c.script and c.is_(k, "*"):
        k, kind = k + 1, "generator"
    if x == "php" and c.is_(k, "&"):
        k += 1
    if x == "kotlin" and v == "class" and before == "enum":
        kind = "class"
    if x in ("kotlin", "swift", "csharp") and v in ("class", "enum", "struct", "record", "actor") and c.word(k) in ("class", "struct", "interface"):
        return i  # a modifier of the next word
    if x == "swift" and v == "class" and c.word(k) in ("func", "var", "let"):
        return i
    if x == "cpp" and before == "enum" or x in ("c", "cpp") and not c.is_(body, "{"):
        return i
    if x == "kotlin" and v == "fun":
        k = c.partner[k] + 1 if c.is_(k, "<") and c.partner[k] is not None else k
        while c.word(k) and (c.is_(k + 1, ".", "?.") or (c.is_(k + 1, "<") and c.partner[k + 1] is not None and c.is_(c.partner[k + 1] + 1, "."))):  # the receiver
            k = (c.partner[k + 1] + 2) if c.is_(k + 1, "<") else k + 2
    name = "init" if x == "swift" and v == "init" else c.word(k)
    if x == "swift" and v == "init":
        if frame.holder is None:
            return i
        k = i
    if not name or name in ("extends", "implements") or (x in ("c", "cpp") and not (c.is_(k + 1, "{", ":") or c.word(k + 1) == "final")):
        return i
    if kind == "function" and frame.holder and x == "php":
        kind = "method"
    if c.script and v == "type":
        declare(kind, name, i, c.stop[k])
        return k
    if c.script and v == "function" and c.is_(k + 1, "(") and c.partner[k + 1] is not None:
        body = _past_type(c, c.partner[k + 1] + 1)
    done = declare("function" if kind == "generator" else kind, name, first, body, scope=kind != "generator" and v != "init")
    header = kind in HOLDERS
    bases = _bases(c, v, k, min(body, c.n)) if header and body not in c.headed else []
    c.headed.add(body)  # a body has one header
    scope = done.scope
    out.definitions[-1].bases = bases
    out.bases += [(scope, edge, target, c.row[first]) for edge, target in bases]
    if header and x != "kotlin" or x in ("rust", "c", "cpp", "go") or not c.is_(k + 1, "(") or c.partner[k + 1] is None:
        return max(k, body - 1) if body < c.n and c.is_(body, "{", ";", "=", "=>") else k
    stack.append(Frame(c.partner[k + 1], None, name, scope))
    jump[c.partner[k + 1] + 1] = body  # calls in defaults of parameters count, types after them don't
    return k + 1


def _ruby(c: Code, out: Scan) -> None:
    """By ``end``: a word that opens a block opens one where a statement begins, and do and def wherever they stand."""
    stack: list[tuple[Definition | None, str | None, bool]] = []  # definition, scope, a loop that may have a do
    scope, header, i = None, -1, 0

    def starts(i: int) -> bool:
        return not i or c.row[i] > c.row[i - 1] or c.value[i - 1] in (";", "=", "(", "then", "else", "do", "{", "|", "begin", "->", "return", "&&", "||")

    while i < c.n:
        v, kind = c.value[i], c.kind[i]
        if kind == "name" and not c.is_(i - 1, ".", "&.") and not c.is_(i + 1, ":"):
            if v in ("class", "module", "def") and not (v == "class" and c.is_(i + 1, "<", ".")):
                k = i + 1
                while v == "def" and c.is_(k + 1, ".") and c.word(k + 2) or v != "def" and c.is_(k + 1, "::") and c.word(k + 2):
                    k += 2
                name = (c.word(k) or (c.source(k, k + 1) if k < c.n else "")) if v == "def" else c.source(i + 1, min(k + 1, c.n))
                found = Definition("method" if v == "def" else v, name, c.row[i], c.row[i])
                out.definitions.append(found)
                if v == "class" and c.is_(k + 1, "<") and (base := c.word(k + 2)) and not c.is_(k + 3, "::", ".", "("):
                    found.bases.append(("extends", base))
                    out.bases.append((name, "extends", base, c.row[i]))
                i = k + 2 if c.is_(k + 1, "<") else k
                close = c.partner[i + 1] if v == "def" and c.is_(i + 1, "(") and c.partner[i + 1] is not None else i
                if v == "def" and c.is_(close + 1, "=") and c.row[close + 1] == c.row[close]:
                    i = close  # without an end; its calls are the outer scope's
                else:
                    stack.append((found, scope, False))
                    scope = name
                kind = ""
            elif v in ("if", "unless", "case", "begin", "for", "while", "until") and starts(i):
                stack.append((None, scope, v in ("for", "while", "until")))
                header = c.row[i]
            elif v == "do":
                if stack and stack[-1][2] and header == c.row[i]:
                    stack[-1] = (*stack[-1][:2], False)
                else:
                    stack.append((None, scope, False))
            elif v == "end" and stack:
                found, scope, _ = stack.pop()
                if found:
                    found.last = c.row[i]
        dot = c.is_(i - 1, ".", "&.", "::") or (c.is_(i - 1, ".") and c.is_(i - 2, "&"))
        plain = kind == "name" and (v[0].islower() or v[0] == "_") and (dot or v not in c.words)
        if plain:
            near = i + 1 < c.n and c.row[i + 1] == c.row[i]
            gap = near and c.at[i + 1] > c.end[i]
            arguments = near and (c.is_(i + 1, "(") and not gap or gap and (c.kind[i + 1] in ("text", "number") or (c.word(i + 1) and c.value[i + 1] not in RUBY_AFTER) or (c.is_(i + 1, "[", "->", "*", "&", ":", "::") and i + 2 < c.n and c.at[i + 2] == c.end[i + 1])))
            assigned = dot and c.is_(i + 1, "=")
            block = near and (c.is_(i + 1, "{") or c.word(i + 1) == "do")
            if (arguments or (dot and not assigned and not c.is_(i - 1, "::")) or block):
                line = c.row[c.first[i]] if dot else c.row[i]
                if v in ("require", "require_relative", "load", "autoload"):
                    k = next((k for k in range(i + 1, min(c.stop[i + 1] if i + 1 < c.n else i, i + 6)) if c.kind[k] == "text"), None)
                    if k is not None and (name := _unquoted(c, k)):
                        out.imports.append((scope, name, line))
                elif v in ("include", "extend", "prepend"):
                    k = i + 1 + c.is_(i + 1, "(")
                    while (name := c.word(k)) and name[0].isupper() and not c.is_(k + 1, "::"):
                        out.bases.append((scope, "implements", name, line))
                        k += 1 + c.is_(k + 1, ",")
                elif v not in BUILTIN["ruby"]:
                    out.calls.append((scope, v, line))
        i += 1
    for found, _, _ in stack:
        if found:
            found.last = c.row[-1]


RUBY_AFTER = set("if unless while until and or then do rescue end in when else".split())


def _css(c: Code, out: Scan) -> None:
    """Rules by their selectors, and @media, @keyframes and @supports; @import's target."""
    begin = 0
    for i, v in enumerate(c.value):
        if c.kind[i] == "mark" and v in ("{", "}", ";"):
            if c.is_(begin, "@") and c.word(begin + 1) == "import" and v == ";":
                target = c.source(begin + 2, i).split(")")[0].strip()
                target = re.match(r"(?:url\(\s*)?(\"[^\"]*\"|'[^']*'|[^\s\"')]+)?", target)[1] or ""
                out.imports += [(None, target.strip("\"'"), c.row[begin])] if target.strip("\"'") else []
            if v == "{" and begin < i:
                end, word = c.partner[i], c.word(begin + 1) if c.is_(begin, "@") else None
                kind = {"media": "mod", "supports": "mod", "keyframes": "function", None: "rule"}.get(word)
                if kind and not (kind == "rule" and c.is_(begin, "@")):
                    out.definitions.append(Definition(kind, "@" + word if word else c.source(begin, i), c.row[begin], c.row[min(c.n - 1 if end is None else end, c.n - 1)]))
            begin = i + 1


def scan(text: str, language: str) -> Scan:
    c, out = Code(text, language), Scan()
    (_ruby if language == "ruby" else _css if language == "css" else _braces)(c, out)
    return out


def definitions(text: str, language: str) -> list[Definition]:
    return scan(text, language).definitions


def _edges(text: str, language: str) -> Iterator[tuple]:
    found = scan(text, language)
    yield from ((scope, name, "imports", at) for scope, name, at in found.imports)
    yield from ((scope, target, kind, at) for scope, kind, target, at in found.bases)
    yield from ((scope, name, "calls", at) for scope, name, at in found.calls)


def code_edges(files: DataFrame, file_col: str, text_col: str, language_col: str) -> DataFrame:
    """Imports, extends, implements and calls of files in LANGUAGES, in their innermost scope; the first of (scope, target, kind) in each file. JSX, TSX, other languages and null texts give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, *e) for f, t, x in zip(frame[file_col], frame[text_col], frame[language_col], strict=True) if t and x in LANGUAGES and x not in ("jsx", "tsx") for e in _edges(t, x)]
            yield pd.DataFrame(rows, columns=["source_file", "source_name", "target_name", "kind", "line"])

    return first_edges(files.select(file_col, text_col, language_col).mapInPandas(run, EDGE))
