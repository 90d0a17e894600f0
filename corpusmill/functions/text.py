"""Text and scalar functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKENS, SUMMARY_TOKENS, MAX_LITERALS, LITERAL_CHARS, CAP_BYTES = 1, 96, 6, 65_536, 16_000

#: Words that are never mentions.
MENTION_STOPWORDS = [
    "fn", "let", "mut", "pub", "use", "mod", "struct", "enum", "impl", "trait", "type", "where", "async", "await", "move", "dyn", "ref", "box", "unsafe", "true", "false", "self",
    "super", "crate", "extern", "None", "Some", "Ok", "Err", "Vec", "String", "str", "bool", "usize", "i32", "i64", "u32", "u64", "f32", "f64", "isize", "u8", "i8", "u16", "i16",
    "def", "class", "import", "from", "with", "pass", "raise", "yield", "lambda", "global", "nonlocal", "assert", "del", "var", "const", "function", "typeof", "instanceof", "new",
    "delete", "export", "default", "extends", "static", "func", "package", "interface", "chan", "select", "defer", "goto", "fallthrough", "void", "null", "int", "long", "double",
    "float", "char", "byte", "short", "final", "this", "throws", "throw", "catch", "finally", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return",
    "match", "in", "not", "and", "or", "is", "get", "set", "add", "into", "data", "val",
]

#: Marks of subjects that say nothing, and of subjects that report a failure.
FORMAT_TOOLS = ["prettier", "eslint", "gofmt", "cargo fmt", "rustfmt", "black", "isort", "rubocop", "stylelint", "clang-format", "yapf", "autopep8", "swiftformat", "ktlint"]
ROUTINE_MARKS = [
    "format code", "formatting", "fix whitespace", "whitespace", "trailing whitespace", "lint fix", "ran linter", "apply linting", "merge branch ", "merge pull request",
    "merge remote-tracking", "bump version", "version bump", "release v", "chore: release", "update changelog", "update lock", "cargo.lock",
]
REVERT_STARTS = ['revert "', "revert: ", "revert "]
FAILURE_MARKS = [
    "fix(", "fix!(", "fix: ", "fix!: ", "bug: ", "bug(", "bugfix", "hotfix", "regression", "crash", "broken", "broke", "incorrect", "wrong ", "oops", "mistake", "error: ", "panic", "deadlock",
    "memory leak", "data loss", "data corruption", "infinite loop", "stack overflow",
]

#: Fixed values.
NOTE_KINDS = ["decision", "context", "requirement", "note", "question", "answer", "handoff", "intent", "antipattern"]


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(MIN_TOKENS), (F.length(text) / 4).cast("int"))


def embedding_text(name: Column, docstring: Column, summary: Column, content: Column) -> Column:
    """``title: … | summary: … | text: …``; a missing name reads none, a missing summary drops its part, a docstring stands before the content."""
    body = F.when(docstring.isNotNull(), F.concat(docstring, F.lit("\n"), content)).otherwise(content)
    middle = F.when(summary.isNotNull(), F.concat(F.lit(" | summary: "), summary)).otherwise(F.lit(""))
    return F.concat(F.lit("title: "), F.coalesce(name, F.lit("none")), middle, F.lit(" | text: "), body)


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier; acronyms stay whole."""
    humps = F.regexp_replace(name, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    return F.trim(F.lower(F.regexp_replace(humps, r"[_\-:.\s]+", " ")))


def first_sentence(doc: Column) -> Column:
    """White space collapsed; up to the first . ! or ? before white space or the end."""
    flat = F.trim(F.regexp_replace(F.coalesce(doc, F.lit("")), r"\s+", " "))
    cut = F.regexp_extract(flat, r"^.*?[.!?](?=\s|$)", 0)
    return F.when(cut != "", cut).otherwise(flat)


def split_callees(callees: Column) -> Column:
    """Words of all callees, each where it first appears."""
    words = F.flatten(F.transform(callees, lambda c: F.split(split_identifier(c), " ")))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: w != "")), " ")


def salient_literals(content: Column) -> Column:
    """The first distinct double-quoted strings with a blank in them, unescaped and trimmed."""
    head = F.substring(content, 1, LITERAL_CHARS)
    found = F.regexp_extract_all(head, F.lit(r'(?s)"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"(?s)\\(.)", "$1")))
    good = F.filter(plain, lambda s: F.contains(s, F.lit(" ")) & (F.length(s) >= 3))
    return F.array_join(F.slice(F.array_distinct(good), 1, MAX_LITERALS), " ")


def take_while_fits(parts: Column, cap: int) -> Column:
    """Parts joined by blanks, whole, in order, until one would pass the cap in tokens; empty parts are skipped."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(state: Column, part: Column) -> Column:
        longer = F.when(state["s"] == "", part).otherwise(F.concat(state["s"], F.lit(" "), part))
        over = estimate_tokens(longer) > cap
        skip = (part == "") | state["full"]
        return F.struct(F.when(skip | over, state["s"]).otherwise(longer).alias("s"), (state["full"] | ((part != "") & over)).alias("full"))

    return F.aggregate(parts, start, add, lambda state: state["s"])


def structural_summary(name: Column, docstring: Column, callees: Column, content: Column) -> Column:
    """First sentence, split name, callee words and literals, as far as they fit."""
    return take_while_fits(F.array(first_sentence(docstring), split_identifier(name), split_callees(callees), salient_literals(content)), SUMMARY_TOKENS)


def mention_tokens(code: Column) -> Column:
    """Up to 40 distinct words of 3 to 50 characters that are neither numbers nor stopwords, in order."""
    words = F.regexp_extract_all(code, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # array_except keeps the first of equal words, in order, and looks stopwords up by hash; only distinct words are judged
    distinct = F.array_except(words, F.split(F.lit(" ".join(MENTION_STOPWORDS)), " "))
    return F.slice(F.filter(distinct, lambda w: (F.length(w) >= 3) & (F.length(w) <= 50) & ~F.rlike(w, F.lit(r"^\p{N}+$"))), 1, 40)


def case_style(name: Column) -> Column:
    """snake, camel, pascal, screaming or unknown; under 3 bytes unknown."""
    upper, lower, under = F.rlike(name, F.lit(r"\p{Lu}")), F.rlike(name, F.lit(r"\p{Ll}")), F.contains(name, F.lit("_"))
    starts = F.rlike(name, F.lit(r"^\p{Lu}"))
    return (
        F.when(name.isNull() | (F.octet_length(name) < 3), "unknown")
        .when(upper & ~lower & under, "screaming")
        .when(starts & ~under, "pascal")
        .when(~starts & upper & ~under, "camel")
        .when(lower & ~upper, "snake")
        .otherwise("unknown")
    )


def has_doc_prefix(content: Column) -> Column:
    return F.rlike(content, F.lit(r"""^\s*(///|//!|/\*\*|/\*!|\"\"\"|'''|\* )"""))


def strip_ansi(text: Column) -> Column:
    """Without escape sequences and control characters other than line ends and tabs."""
    out = F.regexp_replace(text, r"\x1b\[[^\x40-\x7e]*[\x40-\x7e]?|\x1b\](?s:.*?)(?:\x07|\x1b(?s:.)|$)|\x1b(?s:.)?", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def index_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def age(created: Column, now: Column) -> Column:
    """Age of a time in epoch seconds, in words."""
    s = F.greatest(now - created, F.lit(0)).cast("long")
    part = lambda n: F.floor(s / n).cast("string")
    return F.when(s < 90, F.concat(s.cast("string"), F.lit(" sec ago"))).when(s < 3600, F.concat(part(60), F.lit(" min ago"))).when(s < 86400, F.concat(part(3600), F.lit(" hr ago"))).otherwise(F.concat(part(86400), F.lit(" days ago")))


def parse_iso8601(text: Column) -> Column:
    """Epoch seconds of a date, or of a date and time with or without seconds, in UTC; a final Z is allowed; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(text, "Z+$", ""), "^([^ T]*) ", "$1T")
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd"]
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in forms]))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def union_list(current: Column, incoming: Column) -> Column:
    """Add-wins union of a comma-separated list and an array, in order; null if nothing is in either."""
    both = F.array_union(split_list(current), incoming)
    return F.when(F.size(both) > 0, F.array_join(both, ","))


def atx_heading(line: Column) -> Column:
    """Title of a Markdown heading of one to six hashes, else null."""
    return F.when(F.rlike(line, F.lit(r"(?s)^#{1,6}( .*)?$")), F.trim(F.regexp_replace(line, "^#+", "")))


def entity_id(kind: Column, title: Column, body: Column) -> Column:
    """SHA-256 of the compact JSON object of body, kind and title, in that order."""
    made = F.to_json(F.struct(F.coalesce(body, F.lit("")).alias("body"), F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(title, F.lit("")).alias("title")))
    for c in (*range(0x1A, 0x20), 0x0B, 0x0E, 0x0F):  # Jackson writes hex digits in capitals
        made = F.regexp_replace(made, rf"\\u00{c:02X}", rf"\\u00{c:02x}")
    return F.sha2(made, 256)


def valid_kind(kind: Column) -> Column:
    return kind.isin(NOTE_KINDS)


def cap_text(text: Column, limit: int = CAP_BYTES, marker: str = "\n\n[...truncated]") -> Column:
    """Cut at a character so that at most limit bytes stay, with a marker; text within the limit as it is."""
    # a character takes four bytes at most: the longest prefix within the limit is found between limit / 4 and limit characters
    sizes = F.sequence(F.lit(1), F.lit(17))
    low = F.aggregate(sizes, F.struct(F.lit(limit // 4).alias("a"), F.lit(limit).alias("b")), lambda s, _: F.when(F.octet_length(F.substring(text, F.lit(1), F.ceil((s["a"] + s["b"]) / 2).cast("int"))) <= limit, F.struct(F.ceil((s["a"] + s["b"]) / 2).cast("int").alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), (F.ceil((s["a"] + s["b"]) / 2).cast("int") - 1).alias("b"))), lambda s: s["a"])
    cut = F.substring(text, F.lit(1), low)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit(marker)))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total).cast("long")).otherwise(F.lit(0).cast("long"))


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def is_routine_subject(subject: Column) -> Column:
    s = F.lower(F.trim(subject))
    return F.exists(_words(FORMAT_TOOLS + ROUTINE_MARKS), lambda m: F.contains(s, m))


def is_failure_subject(subject: Column) -> Column:
    s = F.lower(F.trim(subject))
    return F.exists(_words(REVERT_STARTS), lambda m: F.startswith(s, m)) | F.exists(_words(FAILURE_MARKS), lambda m: F.contains(s, m))


def contains_secret(text: Column) -> Column:
    """Credentials by shape: AWS access keys, GitHub tokens, private keys, bearer and assigned tokens. The pattern set is this package's own."""
    shapes = [r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[=:]\s*['\"][A-Za-z0-9_\-/+]{16,}['\"]"]
    return F.rlike(text, F.lit("|".join(shapes)))


def escape_xml(text: Column) -> Column:
    """The five characters that XML reserves, as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
