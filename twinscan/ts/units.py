"""Units of a source file: functions, types, type literals and classes, found in one parse.

Each unit carries what scoring needs, so that no text is parsed twice: functions their canonical tree, atoms and
literal subtrees, classes the fingerprints of their method bodies.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

from twinscan.ts.canon import canonical_tree, make
from twinscan.ts.parse import Node, ParseError, parse
from twinscan.ts.tree import Renderer, Tree, literal_tree

# Fixed value: the comment that takes a unit out of the comparison.
DIRECTIVE = "similarity-ignore"
_WORDS = re.compile(r"[\w$]+")
_PLAIN = re.compile(r"[^\W\d]\w*\Z|[$_][\w$]*\Z|[^\W\d][\w$]*\Z")


def copy(n: Node) -> Node:
    """A deep copy of a syntax tree."""
    out = Node(n.t, n.s, n.e)
    for k, v in n.__dict__.items():
        if k in ("t", "s", "e"):
            continue
        out.__dict__[k] = copy(v) if isinstance(v, Node) else [copy(x) if isinstance(x, Node) else x for x in v] if isinstance(v, list) else v
    return out


def ignored(lines: list[str], start: int) -> bool:
    """Whether a comment right above line ``start`` (from 1) holds the ignore directive.

    Blank lines and comment lines are passed upwards; the first line of code ends the search.
    """
    inside = False
    for text in reversed(lines[: start - 1]):
        line = text.strip()
        if not line:
            continue
        comment = inside or line.startswith(("//", "/*", "*/", "*")) or line.endswith("*/")
        if not comment:
            return False
        if DIRECTIVE in line:
            return True
        if inside:
            inside = "/*" not in line
        elif line.startswith("/*"):
            return False
        elif line.endswith("*/") or line.startswith("*/"):
            inside = "/*" not in line
    return False


class Lines:
    """Line numbers (from 1) and UTF-8 byte offsets of character positions."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode("utf-8", "surrogatepass"))

    def span(self, s: int, e: int) -> dict[str, int]:
        return {"s": self.byte(s), "e": self.byte(e)}


# Trees as rows: preorder labels, kinds and numbers of children.


def arrays(t: Tree) -> dict[str, list]:
    nodes = list(t.walk())
    return {"labels": [x.label for x in nodes], "kinds": [x.kind for x in nodes], "kids": [len(x.kids) for x in nodes]}


# Atoms: what a function does, apart from its shape.
_OPERATIONS = {
    "BinaryExpression", "LogicalExpression", "UnaryExpression", "UpdateExpression", "AssignmentExpression", "RegExpLiteral",
    "StaticMemberExpression", "ComputedMemberExpression", "PrivateFieldExpression", "CallExpression", "NullLiteral",
}
_NAMES = {"Identifier", "BindingIdentifier", "PrivateIdentifier"}
_CONTROL = {"ForOfStatement", "ForInStatement", "ForStatement", "WhileStatement", "DoWhileStatement", "BreakStatement", "ContinueStatement"}
# Built-ins whose literal indexes matter, with their number of meaningful arguments.
_BOUNDARY = {"at": 1, "charAt": 1, "charCodeAt": 1, "codePointAt": 1, "slice": 2, "substring": 2, "substr": 2, "splice": None}


def _index_text(t: Tree) -> str | None:
    if t.kind == "NumericLiteral":
        return t.label
    if t.label == "UnaryNegation" and len(t.kids) == 1 and t.kids[0].kind == "NumericLiteral":
        return "-" + t.kids[0].label
    return None


def _boundary(t: Tree) -> list[str]:
    """Arity and literal indexes of a call of an indexing built-in, in one spelling for equal meanings."""
    callee = t.kids[0] if t.kids else None
    if callee is None or len(callee.kids) != 2:
        return []
    key = callee.kids[1]
    if callee.kind == "StaticMemberExpression" and key.kind == "Identifier":
        name = key.label
    elif callee.kind == "ComputedMemberExpression" and key.kind == "StringLiteral":
        name = key.label.strip('"')
    else:
        return []
    if name not in _BOUNDARY:
        return []
    args, most = t.kids[1:], _BOUNDARY[name]
    if most is not None:
        while args and args[-1].kind == "Identifier" and args[-1].label == "undefined":
            args = args[:-1]
        args = args[:most] or [Tree("0", "NumericLiteral")]
    out = [f"boundary:{name}/{len(args)}"]
    for i, a in enumerate(args[:2] if most is None else args):
        v = _index_text(a)
        if v is not None:
            out.append(f"boundary:{name}[]={'0' if v.startswith('-') else v}" if name == "substring" else f"boundary:{name}[{i}]={v}")
    return out


def _summands(t: Tree) -> list[Tree]:
    if t.kind == "BinaryExpression" and t.label == "Addition":
        return [x for k in t.kids for x in _summands(k)]
    return [t]


def _folds(t: Tree, strings: set[str]) -> list[str]:
    """Where an assignment that builds a string puts the old value: head, middle or tail."""
    if len(t.kids) != 2:
        return []
    target, value = t.kids
    if target.kind not in ("Identifier", "BindingIdentifier", "StaticMemberExpression", "PrivateFieldExpression", "ComputedMemberExpression"):
        return []
    leaves = _summands(value)
    evidence = target.kind in ("Identifier", "BindingIdentifier") and target.label in strings or any(x.kind == "StringLiteral" for x in leaves)
    if not evidence:
        return []
    if t.label == "Addition":
        return ["fold:head"]
    if t.label != "Assign" or value.kind != "BinaryExpression" or value.label != "Addition":
        return []
    return [f"fold:{'head' if i == 0 else 'tail' if i == len(leaves) - 1 else 'mid'}" for i, x in enumerate(leaves) if x.same(target)]


def atoms(root: Tree) -> tuple[set[str], set[str], Counter]:
    """Value atoms, control atoms and counted boundary and fold atoms of a tree."""
    strings = {t.kids[0].label for t in root.walk() if t.kind == "VariableDeclarator" and len(t.kids) == 2 and t.kids[0].kind == "BindingIdentifier" and t.kids[1].kind == "StringLiteral"}
    values, control, counted = set(), set(), Counter()
    stack = [root]
    while stack:
        t = stack.pop()
        if t.kind in _NAMES and not t.label.startswith("§") or t.kind in _OPERATIONS:
            values.add(t.label)
        if t.kind in _CONTROL:
            control.add(t.label)
        if t.kind == "CallExpression":
            counted.update(_boundary(t))
        elif t.kind == "AssignmentExpression":
            counted.update(_folds(t, strings))
        stack.extend(t.kids[1:] if t.kind == "BindingProperty" else t.kids)
    return values, control, counted


def statements(root: Tree) -> list[tuple[str, list[str]]]:
    """Hash and names of every statement of the function's body."""
    f = next((k for k in root.kids if k.kind in ("FunctionDeclaration", "ClassDeclaration")), None)
    block = next((k for k in f.kids if k.kind == "BlockStatement"), None) if f else None
    if block is None:
        return []
    return [(k.key().hex(), sorted({x.label for x in k.walk() if x.kind in ("Identifier", "BindingIdentifier")})) for k in block.kids]


# Subtrees of the literal tree, for partial overlaps.
_SPANNED = re.compile(r"(?:Statement|Declaration)\Z")


def subtrees(text: str, path: str) -> list[dict] | None:
    """Every subtree of a function's whole lines but the root, in preorder; None if the lines do not parse.

    Lines are relative to the text; a node inside a statement has the statement's lines.
    """
    try:
        root = literal_tree(parse(text, path))
    except ParseError:
        return None
    at = Lines(text)
    out: list[dict] = []
    number = lambda key: int.from_bytes(bytes.fromhex(key), "big", signed=True)

    def visit(t: Tree, span: tuple[int, int], depth: int) -> str:
        if _SPANNED.search(t.kind) and t.e > t.s:
            span = (at.line(t.s), at.line(max(t.s, t.e - 1)))
        row = None
        if depth:
            row = {"weight": t.size, "start_line": span[0], "end_line": span[1], "node_type": t.kind, "depth": depth}
            out.append(row)
        kids = [visit(k, span, depth + 1) for k in t.kids]
        key = Tree(t.label + "\0" + "\0".join(kids), t.kind).key().hex()
        if row is not None:
            row["hash"], row["child_hashes"] = number(key), [number(k) for k in kids]
        return key

    visit(root, (1, at.line(max(0, len(text) - 1))), 0)
    return out


class Extractor:
    """Units of one file."""

    def __init__(self, path: str, text: str, parts: bool = True, trees: bool = True):
        self.path, self.text, self.parts, self.trees = path, text, parts, trees  # whether functions carry subtrees, and canonical trees
        self.program = parse(text, path)
        self.at = Lines(text)
        self.lines = text.split("\n")

    def where(self, n: Node) -> dict:
        start = self.at.line(n.s)
        return {"start_line": start, "end_line": self.at.line(max(n.s, n.e)), "has_ignore": ignored(self.lines, start)}

    # functions
    def functions(self) -> list[dict]:
        out: list[dict] = []
        self.in_body(self.program.body, None, None, out)
        return out

    def in_body(self, body: list[Node], cls: str | None, parent: str | None, out: list[dict]) -> None:
        for n in body:
            d = n.declaration if n.t in ("ExportNamedDeclaration", "ExportDefaultDeclaration") else n
            default = n.t == "ExportDefaultDeclaration"
            if d is None:
                continue
            if d.t == "FunctionDeclaration" and d.id is not None:
                self.function(d, d.id.name, "function", cls, parent, out)
            elif d.t == "ClassDeclaration" and not default:
                name = d.id.name if d.id else None
                for m in d.body:
                    if m.t == "Method":
                        self.method(m, name, parent, out)
            elif d.t == "VariableDeclaration" and not default:
                for v in d.declarations:
                    if v.id.t == "Identifier" and v.init is not None and v.init.t == "ArrowFunctionExpression":
                        self.function(v.init, v.id.name, "arrow", cls, parent, out)

    def function(self, f: Node, name: str, kind: str, cls: str | None, parent: str | None, out: list[dict]) -> None:
        wrapped = make("FunctionDeclaration", id=make("Identifier", name=name), params=f.params, rest=f.rest, body=self.body(f), is_async=f.is_async, generator=f.generator)
        self.add(f, name, name, kind, "normal", None, parent, wrapped, out)
        if f.body is not None and f.body.t == "BlockStatement":
            self.in_body(f.body.body, None, name, out)

    def body(self, f: Node) -> Node | None:
        if f.body is None or f.body.t == "BlockStatement":
            return f.body
        return make("BlockStatement", body=[make("ReturnStatement", argument=f.body)])

    def method(self, m: Node, cls: str | None, parent: str | None, out: list[dict]) -> None:
        known = not m.computed and m.key.t in ("Identifier", "PrivateIdentifier")
        name = ("#" if m.key.t == "PrivateIdentifier" else "") + m.key.name if known else "anonymous"
        shown = f"[{self.text[m.key.s : m.key.e]}]" if m.computed else self.text[m.key.s : m.key.e]
        kind = "constructor" if m.kind == "constructor" else "method"
        accessor = {"get": "getter", "set": "setter"}.get(m.kind, "normal")
        if kind == "method" and accessor == "normal" and not m.static and _PLAIN.match(shown):
            wrapped = make("FunctionDeclaration", id=make("Identifier", name=f"__m_{shown}"), params=m.params, rest=m.rest, body=m.body, is_async=m.is_async, generator=m.generator)
        else:
            wrapped = make("ClassDeclaration", id=make("Identifier", name="__C__"), body=[m])
        self.add(m, name, shown, kind, accessor, cls, parent, wrapped, out)
        if m.body is not None:
            self.in_body(m.body.body, None, f"{cls}.{name}" if cls else name, out)

    def add(self, f: Node, name: str, shown: str, kind: str, accessor: str, cls: str | None, parent: str | None, wrapped: Node, out: list[dict]) -> None:
        block = (f.body.s, f.body.e) if f.body is not None else (f.s, f.e)
        tree = canonical_tree(make("Program", body=[copy(wrapped)])) if self.trees and f.body is not None else None
        values, control, counted = atoms(tree) if tree else (set(), set(), Counter())
        place = self.where(f)
        lines = "\n".join(self.lines[place["start_line"] - 1 : place["end_line"]])
        out.append(
            place
            | {
                "name": name, "display_name": shown, "function_type": kind, "method_kind": accessor, "class_name": cls, "parent_function": parent,
                "parameters": [p.pattern.name for p in f.params if p.pattern.t == "Identifier"],
                "body_span": self.at.span(f.s, f.e), "params_span": self.at.span(*f.params_span), "body_block_span": self.at.span(*block),
                "is_arrow_expression": bool(f.plain), "is_async": bool(f.is_async), "is_generator": bool(f.generator), "is_static": bool(f.static),
                "tree": arrays(tree) if tree else None, "tree_hash": tree.key().hex() if tree else None,
                "value_atoms": sorted(values), "control_atoms": sorted(control), "counted_atoms": dict(counted),
                "statements": [{"hash": h, "names": names} for h, names in (statements(tree) if tree else [])],
                "subtrees": subtrees(lines, self.path) if self.parts else None,
            }
        )

    # types
    def types(self, literals: bool = False) -> list[dict]:
        out = []
        for n in self.program.body:
            d = n.declaration if n.t == "ExportNamedDeclaration" and n.declaration is not None else n
            if d.t == "InterfaceDeclaration":
                out.append(self.type_unit(d, d.id.name, "interface", self.members(d.members), d.type_params, [TypeText(self.text).full(b) for b in d.bases]))
            elif d.t == "TypeAlias":
                properties = self.members(d.type.members) if d.type.t == "TObject" else []
                if d.type.t != "TObject":
                    properties = [_property("<type-body>", collapsed(self.text[d.type.s : d.type.e]))]
                out.append(self.type_unit(d, d.id.name, "type", properties, d.type_params, []))
        if literals:
            self.literals(self.program.body, out)
        return out

    def members(self, members: list[Node]) -> list[dict]:
        return TypeText(self.text).properties(members)

    def type_unit(self, n: Node, name: str, kind: str, properties: list[dict], generics: list[str], bases: list[str]) -> dict:
        if generics:
            place = {g: f"#{i}" for i, g in reversed(list(enumerate(generics)))}
            for p in properties:
                p["type_annotation"] = _WORDS.sub(lambda m: place.get(m[0], m[0]), p["type_annotation"])
        return self.where(n) | {"name": name, "kind": kind, "properties": properties, "generics": list(generics), "extends_names": bases}

    def literals(self, body: list[Node], out: list[dict]) -> None:
        """Object types written in signatures and variables, under names that say where."""
        for n in body:
            d = n.declaration if n.t in ("ExportNamedDeclaration", "ExportDefaultDeclaration") and n.declaration is not None else n
            if d.t == "FunctionDeclaration":
                self.signature(d, d.id.name if d.id else "default", "return type", out)
            elif d.t == "VariableDeclaration":
                for v in d.declarations:
                    if v.id.t == "Identifier":
                        self.literal(v.type, f"{v.id.name} (variable)", out)
                        if v.init is not None and v.init.t in ("ArrowFunctionExpression", "FunctionExpression"):
                            self.signature(v.init, v.id.name, "arrow function", out)
            elif d.t == "ArrowFunctionExpression":
                self.signature(d, "default", "arrow function", out)

    def signature(self, f: Node, name: str, result: str, out: list[dict]) -> None:
        self.literal(f.result, f"{name} ({result})", out)
        for p in f.params:
            if p.pattern.t == "Identifier":
                self.literal(p.type, f"{name} (parameter: {p.pattern.name})", out)
        if f.body is not None and f.body.t == "BlockStatement":
            self.literals(f.body.body, out)

    def literal(self, kind: Node | None, name: str, out: list[dict]) -> None:
        if kind is not None and kind.t == "TObject":
            out.append(self.type_unit(kind, name, "typeLiteral", self.members(kind.members), [], []))

    # classes
    def classes(self) -> list[dict]:
        out = []
        for n in self.program.body:
            d = n.declaration if n.t in ("ExportNamedDeclaration", "ExportDefaultDeclaration") and n.declaration is not None else n
            if d.t == "ClassDeclaration":
                out.append(self.class_unit(d))
        return out

    def class_unit(self, c: Node) -> dict:
        render = ClassText(self.text)
        fields, methods, ctor = [], [], []
        for m in c.body:
            if m.t not in ("Method", "Property") or m.computed or m.key.t not in ("Identifier", "StringLiteral"):
                continue
            name = m.key.name if m.key.t == "Identifier" else m.key.value
            if m.t == "Property" and m.value is not None and m.value.t == "ArrowFunctionExpression":
                methods.append(self.member_method(m.value, name, "method", bool(m.static), render))
            elif m.t == "Property":
                fields.append({"name": name, "type_annotation": render.full(m.type), "is_static": bool(m.static), "is_private": False, "is_readonly": "readonly" in m.mods, "is_optional": bool(m.optional)})
            elif m.kind == "constructor":
                ctor = [render.parameter(p) for p in m.params]
                for p in m.params:
                    if (p.access or p.readonly) and p.pattern.t == "Identifier":
                        fields.append({"name": p.pattern.name, "type_annotation": render.full(p.type), "is_static": False, "is_private": p.access == "private", "is_readonly": bool(p.readonly), "is_optional": False})
            else:
                methods.append(self.member_method(m, name, {"get": "getter", "set": "setter"}.get(m.kind, "method"), bool(m.static), render))
        return self.where(c) | {
            "name": c.id.name if c.id else "AnonymousClass", "is_abstract": bool(c.abstract),
            "extends_name": c.base.name if c.base is not None and c.base.t == "Identifier" else None,
            "implements_names": [i.name for i in c.implements if i.t == "TReference" and "." not in i.name],
            "constructor_params": ctor, "properties": fields, "methods": methods,
        }

    def member_method(self, f: Node, name: str, kind: str, static: bool, render: ClassText) -> dict:
        return {
            "name": name, "parameters": [", ".join(render.parameter(p) for p in f.params)], "return_type": render.plain(f.result, "void"),
            "is_static": static, "is_private": False, "is_async": bool(f.is_async), "is_generator": bool(f.generator), "kind": kind,
            "body_fingerprint": self.fingerprint(f),
        }

    def fingerprint(self, f: Node) -> int | None:
        """Hash of a method body's canonical tree, field names aside."""
        if f.body is None:
            return None
        wrapped = make("FunctionDeclaration", id=make("Identifier", name="__m__"), params=f.params, rest=f.rest, body=self.body(f), is_async=f.is_async, generator=f.generator)
        root = canonical_tree(make("Program", body=[copy(wrapped)]))
        for t in root.walk():
            if t.kind in ("StaticMemberExpression", "PrivateFieldExpression") and t.kids and t.kids[0].kind == "ThisExpression":
                t.kids[1].label = "§field"
        return int.from_bytes(root.key(), "big", signed=True)


def _property(name: str, text: str, optional: bool = False, readonly: bool = False) -> dict:
    return {"name": name, "type_annotation": text, "optional": optional, "readonly": readonly}


def collapsed(text: str) -> str:
    """Type text with comments gone and white space as one blank, strings and templates untouched."""
    pieces = re.findall(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*[\s\S]*?\*/|\s+|[^\s'\"`/]+|.", text)
    out = ""
    for p in pieces:
        if p[0].isspace() or p.startswith(("//", "/*")):
            if out and not out.endswith(" "):
                out += " "
        else:
            out += p
    return out.strip()


class TypeText:
    """Type annotations of the type comparison as text; what it does not know is ``unknown``."""

    missing, parameter_name = "any", "_"

    def __init__(self, text: str):
        self.text = text

    def full(self, n: Node | None, default: str | None = None) -> str:
        return self.render(n) if n is not None else default or self.missing

    plain = full

    def render(self, n: Node) -> str:
        handler = getattr(self, "r_" + n.t, None)
        return handler(n) if handler else "unknown"

    def r_TReference(self, n: Node) -> str:
        return n.name + (f"<{', '.join(map(self.render, n.args))}>" if n.args else "")

    def r_TKeyword(self, n: Node) -> str:
        return n.name

    def r_TLiteral(self, n: Node) -> str:
        return f'"{n.value}"' if n.string else n.value

    def r_TArray(self, n: Node) -> str:
        return self.render(n.element) + "[]"

    def r_TTuple(self, n: Node) -> str:
        return f"[{', '.join(('...' if e.rest else '') + self.render(e.type) + ('?' if e.optional else '') for e in n.elements)}]"

    def r_TOperator(self, n: Node) -> str:
        inner = self.render(n.type)
        return f"ReadonlyArray<{inner.removesuffix('[]')}>" if n.operator == "readonly" else f"{n.operator} {inner}"

    def r_TIndexed(self, n: Node) -> str:
        return f"{self.render(n.object)}[{self.render(n.index)}]"

    def r_TParen(self, n: Node) -> str:
        return self.render(n.type)

    def r_TUnion(self, n: Node) -> str:
        return " | ".join(map(self.render, n.types))

    def r_TIntersection(self, n: Node) -> str:
        return " & ".join(map(self.render, n.types))

    def r_TFunction(self, n: Node) -> str:
        return f"({', '.join(map(self.parameter, n.params))}) => {self.render(n.result)}"

    def r_TObject(self, n: Node) -> str:
        return f"{{ {'; '.join(sorted(p['name'] + ('?' if p['optional'] else '') + ': ' + p['type_annotation'] for p in self.properties(n.members)))} }}"

    def parameter(self, p: Node) -> str:
        return f"{p.pattern.name if p.pattern.t == 'Identifier' else self.parameter_name}: {self.full(p.type)}"

    def properties(self, members: list[Node]) -> list[dict]:
        out = []
        for m in members:
            if m.t == "IndexSignature":
                out.append(_property(f"[index: {self.render(m.key_type)}]", self.full(m.type), readonly=bool(m.readonly)))
            elif m.t in ("TProperty", "TMethod") and not m.computed and m.key.t in ("Identifier", "StringLiteral"):
                name = m.key.name if m.key.t == "Identifier" else m.key.value
                text = self.full(m.type) if m.t == "TProperty" else f"({', '.join(map(self.parameter, m.params))}) => {self.full(m.result, 'void')}"
                out.append(_property(name, text, bool(m.optional), bool(m.readonly)))
        return out


class ClassText(TypeText):
    """Type annotations of the class comparison: plainer, ``any`` for the unknown, no arguments below the top."""

    parameter_name = "param"
    known = {"TReference", "TKeyword", "TArray", "TUnion", "TIntersection", "TFunction", "TObject"}
    top = True

    def full(self, n: Node | None, default: str | None = None) -> str:
        return self.at(n, True) if n is not None else default or self.missing

    def plain(self, n: Node | None, default: str | None = None) -> str:
        return self.at(n, False) if n is not None else default or self.missing

    def at(self, n: Node, top: bool) -> str:
        if n.t not in self.known or n.t == "TKeyword" and n.name in ("true", "false", "this"):
            return "any"
        saved, self.top = self.top, top
        try:
            return super().render(n)
        finally:
            self.top = saved

    def render(self, n: Node) -> str:
        return self.at(n, False)

    def r_TReference(self, n: Node) -> str:
        if "." in n.name:
            return "unknown"
        if n.name in ("object", "symbol", "bigint"):
            return "any"
        return super().r_TReference(n) if self.top else n.name

    def r_TObject(self, n: Node) -> str:
        named = [m for m in n.members if m.t == "TProperty" and not m.computed and m.key.t in ("Identifier", "StringLiteral")]
        return f"{{ {', '.join((m.key.name if m.key.t == 'Identifier' else m.key.value) + ('?' if m.optional else '') + ': ' + self.full(m.type) for m in named)} }}"


__all__ = ["Extractor", "ParseError", "Renderer", "atoms", "statements", "subtrees"]
