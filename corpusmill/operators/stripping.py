"""Code without comments and strings."""

from __future__ import annotations

from corpusmill.operators.lexer import COMMENTS, tokens


def strip_code(code: str, language: str | None) -> str:
    """Code without comments and the insides of strings; line ends of block comments stay, and code in strings."""
    out, done = [], 0
    for kind, at, end in tokens(code, language):
        out.append(code[done:at])
        done = end
        if kind in ("text", "pattern") and end > at:
            out.append(" ")
        elif kind != "comment":
            out.append(code[at:end])
        elif (block := COMMENTS.get(language, ((), None))[1]) and code.startswith(block[0], at):
            out.append("\n" * code.count("\n", at, end) + " ")
    return "".join(out) + code[done:]
