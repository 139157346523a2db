"""Lexers with a pushdown stack for JSON and Python; ``lexer`` holds the one for JavaScript and TypeScript."""

from __future__ import annotations

import re

_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |$)", re.M)
_PAIRS = {")": "(", "]": "[", "}": "{"}

_JSON = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))|(true|false|null)\b|([{}\[\],:])|(\S))')


def json_problem(text: str) -> str | None:
    """The first reason why ``text`` is no JSON value, or None; an empty text counts as valid, as everywhere here."""
    pos = 1 if text[:1] == "\ufeff" else 0
    stack: list[str] = []
    want = "value"  # value, first (or the closing bracket), key, colon, next (comma or closing bracket), end
    while True:
        m = _JSON.match(text, pos)
        if m is None:
            break
        pos, token = m.end(), m[m.lastindex]
        if m[5]:
            if _CONFLICT.match(text, m.start(5)):
                return "conflict marker"
            return "unterminated string" if token == '"' else "unbalanced delimiter" if token in "()" else "unknown character"
        if want == "end":
            return "data after the end"
        if token in "]}":
            if not stack or stack[-1] != _PAIRS[token]:
                return "unbalanced delimiter"
            if want not in ("first", "next"):
                return "premature end of a list"
            stack.pop()
            want = "next" if stack else "end"
        elif token == ",":
            if want != "next":
                return "operator without an operand"
            want = "key" if stack[-1] == "{" else "value"
        elif token == ":":
            if want != "colon":
                return "operator without an operand"
            want = "value"
        elif want in ("colon", "next"):
            return "operands without an operator"
        elif want == "key" or want == "first" and stack[-1] == "{":
            if not m[1]:
                return "key without quotes"
            want = "colon"
        elif token in "[{":
            stack.append(token)
            want = "first"
        else:
            want = "next" if stack else "end"
    return "premature end" if stack or want not in ("end", "value") else None


_PYTHON = re.compile(
    r"[ \t\f]*(?:(\\\r?\n)|(\#[^\n]*)|(\r?\n)|((?:[rRbBuUfFtT]{0,2})(?:'''|\"\"\"|'|\"))|([^\W\d]\w*)|((?:\d|\.\d)[\w.]*(?:(?<=[eE])[+-]\d[\w.]*)?)|([()\[\]{}])|(:=|->|\.\.\.|\*\*=?|//=?|<<=?|>>=?|[<>=!]=|[-+*/%@&|^]=|[-+*/%@&|^~<>=.,:;!])|(\S))"
)
_QUOTE_END = {q: re.compile(rf"(?:[^\\]|\\.)*?{q}", re.S) for q in ("'''", '"""')} | {q: re.compile(rf"(?:[^\\\n{q}]|\\.)*{q}", re.S) for q in "'\""}
_BINARY = set("+ - * / % @ & | ^ < > = . ** // << >> == != <= >= := -> += -= *= /= %= @= &= |= ^= **= //= <<= >>=".split())
_OPENERS = set("if elif else for while try except finally with def class match case async".split())


_QUOTE = re.compile(r"([rRbBuUfFtT]{0,2})(\'\'\'|\"\"\"|\'|\")")


def _formatted_end(text: str, pos: int, quote: str) -> int | None:
    """The place after a formatted string whose text begins at ``pos``, or None; its fields may hold strings of their own."""
    stack = [quote]  # quotes of open formatted strings and the brackets of their fields
    while stack:
        if pos >= len(text):
            return None
        top, c = stack[-1], text[pos]
        if top in _QUOTE_END:
            if c == "\\":
                pos += 2
            elif text.startswith(top, pos):
                stack.pop()
                pos += len(top)
            elif text.startswith(("{{", "}}"), pos):
                pos += 2
            elif c == "{":
                stack.append("{")
                pos += 1
            elif c == "\n" and len(top) == 1:
                return None
            else:
                pos += 1
        elif c in ")]}":
            if _PAIRS[c] != top:
                return None
            stack.pop()
            pos += 1
        elif c in "([{":
            stack.append(c)
            pos += 1
        elif (m := _QUOTE.match(text, pos)) and not (pos and (text[pos - 1].isalnum() or text[pos - 1] == "_")):
            if set(m[1].lower()) & {"f", "t"}:
                stack.append(m[2])
                pos = m.end()
            else:
                end = _QUOTE_END[m[2]].match(text, m.end())
                if end is None:
                    return None
                pos = end.end()
        elif c == ":" and top == "{" and stack[-2] in _QUOTE_END:
            # The format is literal text up to the field's end, with fields of its own.
            depth = 0
            while pos < len(text) and (depth or text[pos] != "}"):
                depth += {"{": 1, "}": -1}.get(text[pos], 0)
                pos += 1
        else:
            pos += 1
    return pos


def python_problem(text: str) -> str | None:
    """The first reason why ``text`` cannot be a Python module, or None: literals, brackets, indentation, blocks without
    a body, operators without an operand, conflict markers and premature ends."""
    pos = 1 if text[:1] == "\ufeff" else 0
    brackets: list[str] = []
    levels = [0]  # indentation of the open blocks
    block = False  # the last line opened a block
    fresh, first, last, before = True, "", "", ""  # at the start of a logical line; its first, last and last but one token
    while pos < len(text):
        if fresh and not brackets:
            conflict = _CONFLICT.match(text, pos)
            if conflict and text[pos] != "=" or conflict and not first:
                return "conflict marker"
        m = _PYTHON.match(text, pos)
        if m is None:
            break
        start, group = pos, m.lastindex
        pos, token = m.end(), m[group]
        if group in (1, 2):
            continue
        if group == 3:
            if brackets or not last:
                fresh = True
                continue
            if last in _BINARY and before != "import":
                return "operator without an operand"
            block = last == ":" and first in _OPENERS
            if last == ":" and not block:
                return "operator without an operand"
            fresh, first, last = True, "", ""
            continue
        if fresh and not brackets and not last:
            width = len(text[start : m.start(group)].replace("\f", "").expandtabs(8))
            if block and width <= levels[-1]:
                return "block without a body"
            if not block and width > levels[-1]:
                return "unexpected indent"
            if block:
                levels.append(width)
            while width < levels[-1]:
                levels.pop()
            if width != levels[-1]:
                return "indent matches no block"
            block, first = False, token
        fresh = False
        if group == 4:
            quote = token.lstrip("rRbBuUfFtT")
            plain = not set(token.lower()) & {"f", "t"}
            found = _QUOTE_END[quote].match(text, pos) if plain else None
            end = found.end() if found else None if plain else _formatted_end(text, pos, quote)
            if end is None:
                return "unterminated string"
            pos, last = end, "value"
        elif group == 7:
            if token in "([{":
                brackets.append(token)
            elif not brackets or brackets.pop() != _PAIRS[token]:
                return "unbalanced delimiter"
            last = token
        elif group == 9:
            return "unknown character"
        else:
            if group == 6 and last == "value" or group == 6 and not re.match(r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?[jJ]?)\Z", token):
                return "bad number"
            before, last = last, token if group in (5, 8) else "value"
    if brackets or last in _BINARY and before != "import" or block or last == ":" and first in _OPENERS:
        return "premature end"
    return None
