"""Predicates over paths and file contents that decide what is read, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILE_BYTES, MAX_PARSE_BYTES, HEAD_BYTES, HEAD_LINES, SNIFF_BYTES = 64 << 20, 512 << 10, 4096, 5, 512

#: Names that are never read, whatever else says so.
SENSITIVE = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.p8", "*.cer", "*.crt", "*.der", "id_rsa", "id_ecdsa", "id_ed25519", "id_dsa", "*.keystore", "*.jks", ".netrc", ".npmrc"]

#: Excludes in gitignore syntax that come before a user's own.
DEFAULT_EXCLUDES = [
    "package-lock.json", "npm-shrinkwrap.json", "packages.lock.json", "*.min.js", "*.min.css", "vendor/", "node_modules/", "third_party/", "dist/", "generated/", "__generated__/",
    "*.generated.*", "*.gen.go", "*.gen.ts", "zz_generated*.go", "*.pb.go", "*.pb.cc", "*.pb.h", "*_pb2.py", "*_pb2_grpc.py", "*_pb.js", "*_pb.d.ts", "schema.json", "*.schema.json",
    "**/translations/**/*.json", "**/locales/**/*.json", "**/locale/**/*.json", "**/i18n/**/*.json",
]

#: Language of a file extension, in its own case, and of text files, in lower case.
CODE_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "tsx": "tsx", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "json": "json", "html": "html", "htm": "html", "css": "css",
    "tf": "hcl", "hcl": "hcl", "php": "php", "phtml": "php", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
    "sql": "sql", "sequel": "sql", "proto": "proto",
}
TEXT_LANGUAGES = {
    "md": "markdown", "mdx": "markdown", "markdown": "markdown", "rmd": "markdown", "qmd": "markdown", "txt": "text", "rst": "text", "adoc": "text", "asciidoc": "text",
    "ipynb": "notebook",
}
TEXT_NAMES = ["README", "CHANGELOG", "CHANGES", "CONTRIBUTING", "NOTICE", "AUTHORS", "HISTORY"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def glob_regex(pattern: str) -> str:
    """Java regex of a gitignore pattern, without its leading ``!``, for a whole relative path; what it matches as a directory it matches with all below."""
    directory, body = pattern.endswith("/"), pattern.strip("/") if pattern != "/" else ""
    anchored = "/" in pattern.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$")


def is_sensitive(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit("|".join(f"(?:{glob_regex(p)})" for p in SENSITIVE)))


def index_decision(path: Column, user_lines: list[str] = (), use_defaults: bool = True) -> Column:
    """struct(decision, pattern, from_default) of the last line that matches: keep, exclude or include (a user's ``!`` line).

    A line's position is the order; paths under an excluded directory count as matched by it.
    """
    lines = [(p, True) for p in DEFAULT_EXCLUDES] * use_defaults + [(p, False) for p in user_lines]
    out = F.struct(F.lit("keep").alias("decision"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("boolean").alias("from_default"))
    for pattern, default in lines:
        text = pattern.strip()
        if not text or text.startswith("#"):
            continue
        verdict = "include" if text.startswith("!") else "exclude"
        hit = F.struct(F.lit(verdict).alias("decision"), F.lit(pattern).alias("pattern"), F.lit(default).alias("from_default"))
        out = F.when(F.rlike(path, F.lit(glob_regex(text.lstrip("!")))), hit).otherwise(out)
    return out


def generated_marker(content: Column) -> Column:
    """Marker in the first lines of a text that says it is generated, else null."""
    lines = F.slice(F.split(F.substring(content, 1, HEAD_BYTES), "\r?\n"), 1, HEAD_LINES)
    head = F.filter(lines, lambda x: F.contains(x, F.lit("@generated")) | F.rlike(x, F.lit(r"^// Code generated by .* DO NOT EDIT\.\s*$")))
    first = F.get(head, F.lit(0))
    return F.when(first.isNull(), F.lit(None).cast("string")).when(F.contains(first, F.lit("@generated")), F.lit("@generated")).otherwise(F.lit("Code generated ... DO NOT EDIT."))


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes of a binary column."""
    return F.coalesce(F.call_function("instr", F.hex(F.substring(content, 1, SNIFF_BYTES)), F.lit("00")) > 0, F.lit(False)) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(SNIFF_BYTES), F.octet_length(content)))), lambda i: F.call_function("substring", content, i, F.lit(1)) == F.lit(b"\0")
    )


def within_size(length: Column, limit: int = MAX_FILE_BYTES) -> Column:
    return length <= limit


def detect_language(path: Column) -> Column:
    """Language by extension or, without one, by name; null if unknown."""
    name = file_name(path)
    ext = F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.regexp_extract(name, r"\.([^.]*)$", 1))
    code = F.create_map(*[F.lit(x) for pair in CODE_LANGUAGES.items() for x in pair])
    text = F.create_map(*[F.lit(x) for pair in TEXT_LANGUAGES.items() for x in pair])
    named = F.when(F.upper(name).isin(TEXT_NAMES), F.lit("text"))
    return F.when(ext.isNull(), named).otherwise(F.coalesce(F.try_element_at(code, ext), F.try_element_at(text, F.lower(ext))))
