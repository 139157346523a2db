"""Type annotations as text: one normal form, and the likeness of two annotations.

The functions are pure and cached: a corpus has far fewer distinct annotations than properties.
"""

from __future__ import annotations

import re
from functools import lru_cache

_BOXED = {"String": "string", "Number": "number", "Boolean": "boolean", "Object": "object"}
_OPEN, _CLOSE = "<([{", ">)]}"
_WORD = re.compile(r"[\w#$]+\Z")
_PARAMETER = re.compile(r"(?:\.\.\.)?([\w$]*)\??\s*:(?!:)")
_CAMEL = re.compile(r"[A-Za-z0-9_]+")


def depths(text: str, quotes: bool = True):
    """(index, character, bracket depth after it, inside a quoted string) of a text; ``=>`` closes nothing."""
    depth, quote, last = 0, "", ""
    for i, c in enumerate(text):
        inside = bool(quote)
        if quote:
            if c == quote and last != "\\":
                quote = ""
        elif quotes and c in "'\"`":
            quote, inside = c, True
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and last == "="):
            depth -= 1
        yield i, c, depth, inside
        last = c


def parts(text: str, separator: str) -> list[str]:
    """The trimmed pieces between separators outside brackets and strings."""
    cuts = [-1, *(i for i, c, depth, inside in depths(text) if c == separator and depth == 0 and not inside), len(text)]
    return [text[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:])]


def balanced(text: str) -> bool:
    last = 0
    for _, _, depth, _ in depths(text, quotes=False):
        if depth < 0:
            return False
        last = depth
    return last == 0


def arrow(text: str) -> tuple[str, str] | None:
    """Parameters and result of a function type, or None."""
    if not text.startswith("("):
        return None
    end = next((i for i, c, depth, _ in depths(text, quotes=False) if c == ")" and depth == 0), None)
    rest = text[end + 1 :].lstrip() if end is not None else ""
    return (text[1:end], rest[2:].strip()) if rest.startswith("=>") else None


def element(text: str) -> str | None:
    """The element type of an array type, or None."""
    inner = text[:-2]
    return inner if text.endswith("[]") and inner and balanced(inner) else None


def generic(text: str) -> tuple[str, list[str]] | None:
    """Base and arguments of a generic reference, or None."""
    base, mark, rest = text.partition("<")
    if not mark or not rest.endswith(">") or not re.fullmatch(r"\w+", base.strip()) or not balanced(rest[:-1]):
        return None
    return base.strip(), parts(rest[:-1], ",")


def unwrapped(text: str) -> str:
    """The text without parentheses around the whole of it."""
    text = text.strip()
    while text.startswith("(") and text.endswith(")") and next((i for i, c, depth, _ in depths(text, quotes=False) if c in _CLOSE and depth == 0), -1) == len(text) - 1:
        text = text[1:-1].strip()
    return text


@lru_cache(maxsize=100_000)
def normal_type(text: str) -> str:
    """One spelling for equal types.

    Members of unions and intersections are sorted without repeats, parameter names dropped, ``Array<T>``
    written ``T[]`` and boxed primitives as primitives, at any depth.
    """
    text = text.strip()
    for mark in "|&":
        members = parts(text, mark)
        if len(members) > 1:
            return f" {mark} ".join(sorted({normal_type(m) for m in members}))
    if found := arrow(text):
        kept = [_PARAMETER.sub("", p, count=1) if _PARAMETER.match(p) else p.removeprefix("...") for p in parts(found[0], ",") if p]
        return f"({', '.join(map(normal_type, kept))}) => {normal_type(found[1])}"
    if inner := element(text):
        return normal_type(inner) + "[]"
    if found := generic(text):
        arguments = [normal_type(a) for a in found[1]]
        if found[0] == "Array" and len(arguments) == 1:
            a = arguments[0]
            return f"({a})[]" if " | " in a or " & " in a or "=>" in a else f"{a}[]"
        return f"{found[0]}<{', '.join(arguments)}>"
    return _BOXED.get(text, text)


def levenshtein(a: str, b: str) -> int:
    """Edit distance in characters."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _edit_ratio(a: str, b: str) -> float:
    longest = max(len(a.encode()), len(b.encode()))
    return max(0.0, 1 - levenshtein(a, b) / longest) if longest else 1.0


@lru_cache(maxsize=200_000)
def type_likeness(a: str, b: str) -> float:
    """Likeness of two annotations; differences of contract weigh more than differences of spelling.

    Equal 1. Unions 0.6 of their members' Dice, intersections Dice. Functions 0.35 parameters + 0.65
    result (0.3 for other arity), one function alone 0.15. Arrays by their elements, one alone 0.2. Generics of
    one base and arity 0.35 + 0.4 of the arguments' mean, 0.25 for swapped arguments, other 0.2. Two
    plain names 0.2. Anything else by edit distance.
    """
    a, b = normal_type(a), normal_type(b)
    if a == b:
        return 1.0
    for mark, scale in (("|", 0.6), ("&", 1.0)):
        x, y = parts(a, mark), parts(b, mark)
        if len(x) > 1 or len(y) > 1:
            overlap = 2 * sum(m in y for m in x) / (len(x) + len(y))
            return overlap if overlap >= 1 else overlap * scale
    f, g = arrow(a), arrow(b)
    if f and g:
        x, y = parts(f[0], ","), parts(g[0], ",")
        same = 1.0 if f[0] == g[0] else sum(map(type_likeness, x, y)) / len(x) if len(x) == len(y) else 0.3
        return min(1.0, 0.35 * same + 0.65 * type_likeness(f[1], g[1]))
    if f or g:
        return 0.15
    x, y = element(a), element(b)
    if x and y:
        return type_likeness(unwrapped(x), unwrapped(y))
    if x or y:
        return 0.2
    p, q = generic(a), generic(b)
    if p and q and p[0] == q[0] and len(p[1]) == len(q[1]):
        if len(p[1]) > 1 and p[1] != q[1] and sorted(p[1]) == sorted(q[1]):
            return 0.25
        return 0.35 + 0.4 * sum(map(type_likeness, p[1], q[1])) / max(1, len(p[1]))
    if p or q or (_WORD.match(a) and _WORD.match(b)):
        return 0.2
    return _edit_ratio(a, b)


@lru_cache(maxsize=100_000)
def property_likeness(a: str, b: str) -> float:
    """Scalar twin of ``likeness.property_name_likeness``."""
    if a == b:
        return 1.0
    x, y = a.lower().strip(), b.lower().strip()
    return 0.95 if x == y else _edit_ratio(x, y)


@lru_cache(maxsize=200_000)
def plain_likeness(a: str, b: str) -> float:
    """Scalar twin of ``likeness.name_likeness``."""
    return 1.0 if a == b else 1 - levenshtein(a, b) / max(len(a), len(b))


def class_type(text: str) -> str:
    """The class comparison's own light normal form of a type."""
    return text.replace("Array<", "[").replace(">", "]").replace(" ", "").strip()


def placeholders(text: str) -> str:
    """Class-shaped names (a capital first, some lower case) replaced by one mark."""
    return _CAMEL.sub(lambda m: "#T" if m[0][0].isupper() and any(c.islower() for c in m[0]) else m[0], text)


def loose_signature(parameters: list[str], result: str) -> str:
    """A method's signature without parameter names and class names."""
    kept = [placeholders(p.partition(":")[2].strip() if ":" in p else p) for p in _pieces(", ".join(parameters)) if p]
    return f"({', '.join(kept)}) => {placeholders(result)}"


def _pieces(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
        elif c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


@lru_cache(maxsize=200_000)
def overlap_of_words(a: str, b: str) -> float:
    """Scalar twin of ``likeness.token_overlap``."""
    x, y = set(re.findall("[A-Za-z]+", a)), set(re.findall("[A-Za-z]+", b))
    return len(x & y) / len(x | y) if x | y else 1.0
