"""Lexers for the ECMAScript family with a pushdown stack: finds why a source text cannot parse.

One pass over the tokens keeps a stack of open delimiters, template holes and JSX elements, and whether
the grammar now wants an operand. That decides regex against division, tag against comparison, and shows
unterminated literals, unbalanced delimiters, premature ends, merge-conflict markers, operators without an
operand, operands without an operator, and constructs of another language than the extension names.
It is no full parser: what passes may still be rejected by one, but what it rejects is invalid.
"""

from __future__ import annotations

import re

from twinscan.llm.lexers import json_problem, python_problem

# Words of the ECMAScript and TypeScript grammars.
# Words after which an operand (or a declaration) follows.
_BEFORE_OPERAND = set("await case delete do else extends implements in instanceof new of return throw typeof void yield as is keyof satisfies unique asserts infer default".split())
# Statement and declaration words, after which another word may stand on the same line.
_BEFORE_WORD = _BEFORE_OPERAND | set("abstract accessor async class const declare enum export from function get global import interface let module namespace override private protected public readonly set static type var using export break continue goto debugger out".split())
# Words that may stand between two operands on one line.
_INFIX = set("as extends from if implements in instanceof is of satisfies while else catch finally".split())
_HEADERS = {"if", "while", "for", "switch", "with", "catch"}
_RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return switch throw try typeof var void while with".split())

_TOKEN = re.compile(
    r"""(\s*)(?:
    (\#?[A-Za-z_$ª-\U0010ffff](?:[\w$\u200c\u200d])*)                                # 2 word
   |('(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*")             # 3 string
   |([()\[\]{};,])                                                                        # 4 delimiter
   |(\d[\w.]*(?:(?<=[eE])[+-]\d[\w]*)?|\.\d[\w]*(?:(?<=[eE])[+-]\d+)?)                    # 5 number
   |(//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)                                               # 6 comment
   |(^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z))                                             # 7 conflict marker
   |(=>|\.\.\.|\?\.(?!\d)|\?\?=?|[=!]==?|\*\*=?|\+\+|--|&&=?|\|\|=?|<<=?|<=|[-+*%&|^]=?|[=!~?:.<>@]) # 8 operator
   |(/)                                                                                   # 9 division or regex
   |(`)                                                                                   # 10 template
   |(['"\#\\]|\S)                                                                         # 11 nothing known
    )""",
    re.X | re.M,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)")
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?)n?\.?\Z")
_MEMBER_OF_NUMBER = re.compile(r"\.(?=\.?[A-Za-z_$]{2})")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u(?![\da-fA-F]{4}|\{[\da-fA-F]{1,6}\})|x(?![\da-fA-F]{2}))")
_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
_TYPE_PARAMS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_ATTRIBUTE = re.compile(r"""\s*(?:([A-Za-z_$][\w$:-]*)(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?=\{)|(?=<)))?|(\{)|(/>)|(>))""")
_JSX_TEXT = re.compile(r"[^<{}>]*")
_CLOSE_TAG = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>")
_TS_MEMBER = re.compile(r"\s*(?:interface|type|enum|namespace|declare|abstract)\s+[A-Za-z_$][\w$]*\s*(?:[<{=]|extends\b|class\b|function\b|const\b)")
_ANNOTATED = re.compile(r"\s+[A-Za-z_$][\w$]*\s*:\s*[A-Za-z_$({\['\"]")
_EMPTY_TAG = re.compile(r"<\s*>")
_THEN_NAME = re.compile(r"[ \t]+[\w$#]+")
_THEN_TYPE = re.compile(r"[ \t]+[\w${\[]")
_THEN_TYPE_IMPORT = re.compile(r"\s+type\s*[{*\w]")
_TYPE_NAMED = re.compile(r"\s+type\s+from\b")
_SELF_CLOSED = re.compile(r"<[\w$.]+(?:\s+[\w$-]+=(?:\"[^\"]*\"|\{[^}]*\}))*\s*/>")
_GENERIC_CALL = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*>\s*\(")
_EXPORTS = set("default const let var function class async interface type enum declare abstract namespace import as module global".split())
_LAST = (_RESERVED | {"await", "let", "interface", "enum"}) - {"break", "continue", "debugger", "return"}
_PAIRS = {")": "(", "]": "[", "}": "{"}

LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "json": "json", "py": "python"}


def language_of(path: str | None) -> str | None:
    """Language named by a path's extension, or None."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def problem(text: str, language: str) -> str | None:
    """The first reason why ``text`` cannot be a program in ``language``, or None."""
    if language in ("json", "python"):
        return (json_problem if language == "json" else python_problem)(text)
    typed, tags = language in ("typescript", "tsx"), language in ("tsx", "jsx")
    pos, end = 0, len(text)
    if text[:1] == "\ufeff":
        pos = 1
    if text.startswith("#!", pos):
        pos = text.find("\n", pos) + 1 or end
    # Entries: opener, kind. Kinds: of "(" the word before it; of "{" block, hole, or JSX place.
    stack: list[tuple[str, str]] = []
    operand = True  # an operand may start here
    kind = ""  # what the last token was: word, value, op, close, or the delimiter or operator itself
    word = ""  # the last token if it was a word
    previous = ""  # the word right before it, if any
    closed = ""  # kind of the bracket just closed
    lead = ""  # what came right before it
    last_end = pos
    absent: set[str] = set()  # closing tags that occur nowhere further on
    match = _TOKEN.match
    while True:
        m = match(text, pos)
        if m is None:
            break  # white space to the end
        pos, group = m.end(), m.lastindex
        if group == 6:
            continue
        token = m[group]
        if group == 2:
            if not token.isascii() and not token.lstrip("#").replace("$", "_").isidentifier():
                return "unknown character"
            property_name = kind in (".", "?.")
            if not operand and not property_name:
                newline = "\n" in text[last_end : m.start(2)]
                if token not in _INFIX and (not newline or (stack and stack[-1][0] in "([" and stack[-1][1] != "for")):
                    if not (kind == "word" and word in _BEFORE_WORD) and kind not in (">", "}", "?") and not (kind == ")" and closed in _HEADERS):
                        if not (kind == "word" and (_contextual(word, token) or word == "for" and token == "await")):
                            return "operands without an operator"
            if not property_name and token in _RESERVED and kind == "op" and token in ("else", "catch", "finally", "case", "extends", "instanceof", "in"):
                return "operator without an operand"
            if not typed and not property_name:
                if token in ("interface", "type", "enum", "namespace", "declare", "abstract") and kind in ("", ";", "{", "}", "word") and _TS_MEMBER.match(text, m.start(2)):
                    if kind != "word" or word in ("export", "default", "declare"):
                        return "typescript in javascript"
                if token in ("const", "let", "var") and _ANNOTATED.match(text, pos):
                    return "typescript in javascript"
                if token == "import" and _THEN_TYPE_IMPORT.match(text, pos) and not _TYPE_NAMED.match(text, pos):
                    return "typescript in javascript"
                if token in ("private", "public", "protected", "readonly") and _THEN_NAME.match(text, pos) and kind in (";", "{", "}", "(", ","):
                    return "typescript in javascript"
                if token == "as" and not operand and kind != "*" and not _names_open(stack) and _THEN_TYPE.match(text, pos):
                    return "typescript in javascript"
            if stack and not property_name and token == "return" and not any(k in ("{", "hole") for _, k in stack) and stack[-1][0] in "([":
                return "statement inside an expression"
            previous, word = word if kind == "word" else "", token
            if previous == "export" and token not in _EXPORTS and "." not in previous:
                return "operands without an operator"
            if previous == "for" and token == "await":
                word = "for"
            lead, kind = kind, "word"
            operand = token in _BEFORE_OPERAND and not property_name or (token in ("function", "class", "const", "let", "var", "import", "export") and not property_name)
            if property_name:
                word = "." + token
        elif group == 4:
            if token in "([{":
                if token == "{":
                    if kind == "{" and stack[-1][1] == "object":
                        return "operands without an operator"
                    if kind in ("(", ",", "=", "op", "?", ":", "[", "=>", "...") or kind == "word" and word in ("return", "typeof", "default", "await", "yield", "in", "of", "case", "new", "as", "throw"):
                        inner = "object" if kind != "=>" else "block"
                    elif kind == "word" and word in ("import", "export"):
                        inner = "names"
                    else:
                        inner = "bare" if kind in ("", ";", "}") else "block"
                    stack.append(("{", inner))
                else:
                    stack.append((token, word if kind == "word" else kind if kind == ">" else ""))
                operand, kind = True, token
            elif token in ")]}":
                if not stack:
                    return "unbalanced delimiter"
                opener, inner = stack.pop()
                if opener != _PAIRS[token]:
                    return "unbalanced delimiter"
                if kind in ("op", "=", ".", "?.", "=>", "...", "@") or kind == ":" and token != "}" or kind == "word" and operand and word in ("typeof", "delete", "new", "extends", "instanceof", "in", "throw", "case"):
                    return "operator without an operand"
                if token == "}" and kind == ")" and closed in ("if", "while", "for", "switch", "with") or token == "}" and kind == "word" and word in ("else", "try", "do", "if", "function", "while"):
                    if not (kind == ")" and closed == "while"):
                        return "premature end"
                if token == "}" and inner == "hole":
                    t = _TEMPLATE.match(text, pos)
                    if t is None:
                        return "unterminated template"
                    pos = t.end()
                    if t[1] == "${":
                        stack.append(("{", "hole"))
                        operand, kind = True, "{"
                    else:
                        operand, kind, word = False, "value", ""
                    last_end = pos
                    continue
                if token == "}" and inner in ("attribute", "child"):
                    pos, why = _jsx(text, pos, stack, inner)
                    if why:
                        return why
                    if stack and stack[-1][1] in ("attribute", "child"):
                        operand, kind = True, "{"
                    else:
                        operand, kind, word = False, "value", ""
                    last_end = pos
                    continue
                closed = inner
                operand = token == "}" and inner in ("block", "bare") or token == ")" and inner in _HEADERS
                kind = token
            else:
                if kind in ("op", "=", ".", "?.", "=>", "...", "@") or kind == ":" and token == ",":
                    return "operator without an operand"
                if token == "," and kind in ("(", "{", ",") and (kind != "," or not stack or stack[-1][0] != "["):
                    return "operator without an operand"
                if token == ";" and stack and stack[-1][0] in "([" and not (stack[-1][0] == "(" and stack[-1][1] in ("for", "await")):
                    return "unbalanced delimiter"
                operand, kind = True, token
        elif group == 8:
            if token == "<" and operand and kind not in ("word",) or token == "<" and operand and kind == "word" and word in ("return", "default", "yield", "await", "case"):
                at = m.start(8)
                if not _TYPE_PARAMS.match(text, at) and not _GENERIC_CALL.match(text, at) or _EMPTY_TAG.match(text, at):
                    tag = _TAG.match(text, at)
                    looks = tag[1] is None and text[tag.end() : tag.end() + 1] == ">" or tag[1] is not None
                    if looks and tags:
                        pos, why = _open_tag(text, tag, stack)
                        if why:
                            return why
                        if stack and stack[-1][1] in ("attribute", "child"):
                            operand, kind = True, "{"
                        else:
                            operand, kind, word = False, "value", ""
                        last_end = pos
                        continue
                    closing = f"</{tag[1] or ''}"
                    if looks and closing not in absent and text.find(closing, at) < 0:
                        absent.add(closing)
                    if looks and (closing not in absent or _SELF_CLOSED.match(text, at)):
                        return "markup outside a tsx file" if typed else "markup in javascript"
                    if not looks:
                        return "operator without an operand"
                    if not typed:
                        return "operator without an operand"
                kind, operand = "<", True
            elif token in ("++", "--"):
                operand = operand or "\n" in text[last_end : m.start(8)]
                kind = "op" if operand else "value"
                if kind == "value":
                    operand = False
                    word = ""
            elif token == "!":
                if operand:
                    kind = "op"
                elif text[pos : pos + 1] and not typed:
                    return "operands without an operator"
                else:
                    kind, operand, word = "value", False, ""
            elif token in ("-", "+", "~", "...", "@"):
                kind, operand = ("..." if token == "..." else "op"), True
            elif token in (">", "<"):
                kind, operand = token, True
            elif token == ":":
                if kind in ("op", "=", "=>", "...") or (not typed and stack and stack[-1][0] == "(" and kind == "word" and lead in ("(", ",", "...")):
                    return "operator without an operand" if kind != "word" else "typescript in javascript"
                kind, operand = ":", True
            elif token == "?":
                if operand and kind in ("op", "=", "(", ",", "[", "=>"):
                    return "operator without an operand"
                kind, operand = "?", True
            elif token == "*":
                if operand and kind in ("op", "=", "=>", "?", "["):
                    return "operator without an operand"
                kind, operand = ("*" if kind in ("word", "{", ",", ";", "}", "") else "op"), True
            elif token == ".":
                if operand and kind not in (">", "?", "}", ")", "word"):
                    return "operator without an operand"
                kind, operand = ".", False
            elif token == "?.":
                kind, operand = "?.", True
            elif token in ("|", "&"):
                kind, operand = "op", True
            else:
                if operand and kind in ("op", "=", "(", "[", ",", ";", "=>", ":", "...", ".", "?."):
                    return "operator without an operand"
                if operand and kind in ("{", "") and token != "=>":
                    return "operator without an operand"
                if kind == "word" and word in ("const", "var") and token not in ("=>", ">="):
                    return "operator without an operand"
                kind, operand = ("=" if token == "=" else "=>" if token == "=>" else "op"), True
        elif group == 3:
            if not operand and kind not in (">", "}", "?") and not (kind == "word" and (word in _BEFORE_WORD or word in ("with", "assert", "require"))):
                if "\n" not in text[last_end : m.start(3)] or stack and stack[-1][0] in "([":
                    return "operands without an operator"
            if kind in ("{", ",") and stack and stack[-1][1] == "bare" and text[pos : pos + 1] == ":":
                return "data instead of a program"
            if "\\" in token and _BAD_ESCAPE.search(token):
                return "bad escape"
            operand, kind, word = False, "value", ""
        elif group == 5:
            if not operand and kind not in (">", "}", "?", ".") and "\n" not in text[last_end : m.start(5)]:
                return "operands without an operator"
            if not _NUMBER.match(_MEMBER_OF_NUMBER.split(token, maxsplit=1)[0]):
                return "bad number"
            operand, kind, word = False, "value", ""
        elif group == 9:
            if text[pos : pos + 1] == "*":
                return "unterminated comment"
            if operand:
                r = _REGEX.match(text, m.start(9))
                if r is None:
                    return "unterminated regex"
                if len(set(r[1])) != len(r[1]) or not set(r[1]) <= set("dgimsuvy"):
                    return "bad regex flags"
                pos = r.end()
                operand, kind, word = False, "value", ""
            else:
                if text[pos : pos + 1] == "=":
                    pos += 1
                kind, operand = "op", True
        elif group == 10:
            t = _TEMPLATE.match(text, pos)
            if t is None:
                return "unterminated template"
            pos = t.end()
            if t[1] == "${":
                stack.append(("{", "hole"))
                operand, kind = True, "{"
            else:
                operand, kind, word = False, "value", ""
        elif group == 7:
            return "conflict marker"
        else:
            return "unterminated string" if token in "'\"" else "unterminated comment" if token == "/" else "unknown character"
        last_end = pos
    if stack:
        return "premature end"
    if kind in ("op", "=", ".", "?.", "=>", "...", "@", ",", "<", ":", "?") or kind == "word" and (word in _LAST or previous == "const") or kind == ")" and closed in ("if", "for", "switch", "with"):
        return "premature end"
    return None


def _contextual(word: str, token: str) -> bool:
    return word in ("of", "as", "async", "await") or word == "." or token in ("of", "is")


def _names_open(stack: list[tuple[str, str]]) -> bool:
    return bool(stack) and stack[-1] == ("{", "names")


def _open_tag(text: str, tag: re.Match, stack: list[tuple[str, str]]) -> tuple[int, str | None]:
    stack.append(("<", tag[1] or ""))
    return _jsx(text, tag.end(), stack, "attribute")


def _jsx(text: str, pos: int, stack: list[tuple[str, str]], place: str) -> tuple[int, str | None]:
    """From a place inside a tag ("attribute") or between tags to the next brace or to the end of the outermost element.

    One loop over the stack: neither the number of elements nor their depth is bounded.
    """
    while True:
        if place == "attribute":
            m = _ATTRIBUTE.match(text, pos)
            if m is None:
                return pos, "bad markup"
            pos = m.end()
            if m[2] or m[1] and text[pos : pos + 1] == "{" and text[pos - 1] in "= \t\n":
                if not m[2]:
                    pos += 1
                stack.append(("{", "attribute"))
                return pos, None
            if m[3]:
                stack.pop()
                if not _in_element(stack):
                    return pos, None
            if m[3] or m[4]:
                place = "child"
            continue
        pos = _JSX_TEXT.match(text, pos).end()
        c = text[pos : pos + 1]
        if not c:
            return pos, "premature end"
        if c in ">}":
            return pos, "bad markup"
        if c == "{":
            stack.append(("{", "child"))
            return pos + 1, None
        close = _CLOSE_TAG.match(text, pos)
        if close:
            if not stack or stack[-1][0] != "<" or stack[-1][1] != (close[1] or ""):
                return pos, "unbalanced markup"
            stack.pop()
            pos = close.end()
            if not _in_element(stack):
                return pos, None
            continue
        tag = _TAG.match(text, pos)
        if tag[1] is None and text[tag.end() : tag.end() + 1] != ">":
            return pos, "bad markup"
        stack.append(("<", tag[1] or ""))
        pos, place = tag.end(), "attribute"


def _in_element(stack: list[tuple[str, str]]) -> bool:
    """Whether what follows a complete element is a child of another one; else it is code again."""
    return bool(stack) and stack[-1][0] == "<"
