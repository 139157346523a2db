"""Renaming of locally declared names, so that trees do not depend on them."""

from __future__ import annotations

from collections.abc import Iterator

from twinscan.ts.parse import Node

MARK = "§"
_FUNCTIONS = {"FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "Method"}
_SKIP = {"type", "result", "type_params", "implements", "key_type", "t", "s", "e"}


def parts(n: Node) -> Iterator[Node]:
    """Child nodes in source order of fields, type annotations aside."""
    for name, v in n.__dict__.items():
        kind = type(v)
        if kind is Node:
            if name not in _SKIP and (name != "key" or n.computed):
                yield v
        elif kind is list and name not in _SKIP:
            for x in v:
                if type(x) is Node:
                    yield x


def bound(pattern: Node | None) -> Iterator[Node]:
    """Identifiers a pattern declares."""
    if pattern is None:
        return
    if pattern.t == "Identifier":
        yield pattern
    elif pattern.t == "AssignmentPattern":
        yield from bound(pattern.left)
    elif pattern.t in ("ArrayPattern", "ObjectPattern"):
        for x in pattern.elements or []:
            yield from bound(x)
        for x in pattern.properties or []:
            yield from bound(x.value)
        yield from bound(pattern.rest)


class Renamer:
    """Gives every declared symbol of a program a name of its own; free names stay."""

    def __init__(self) -> None:
        self.count = 0

    def program(self, n: Node) -> None:
        scope = {}
        self.declare(scope, self.hoisted(n.body))
        self.declare(scope, self.lexical(n.body))
        for x in n.body:
            self.visit(x, [scope])

    def declare(self, scope: dict[str, str], names: Iterator[str]) -> None:
        for name in names:
            if name not in scope:
                scope[name] = f"{MARK}{self.count}"
                self.count += 1

    def hoisted(self, body: list[Node]) -> Iterator[str]:
        """Names that ``var`` declares in a function, at any depth of blocks."""
        for n in body:
            if n.t == "VariableDeclaration" and n.kind == "var":
                for d in n.declarations:
                    yield from (i.name for i in bound(d.id))
            if n.t not in _FUNCTIONS and n.t not in ("ClassDeclaration", "ClassExpression"):
                yield from self.hoisted(list(parts(n)))

    def lexical(self, body: list[Node]) -> Iterator[str]:
        """Names that the statements of one block declare."""
        for n in body:
            d = n.declaration if n.t in ("ExportNamedDeclaration", "ExportDefaultDeclaration") and n.declaration is not None else n
            if d.t == "VariableDeclaration" and d.kind != "var":
                for x in d.declarations:
                    yield from (i.name for i in bound(x.id))
            elif d.t in ("FunctionDeclaration", "ClassDeclaration") and d.id is not None:
                yield d.id.name

    def visit(self, n: Node, scopes: list[dict[str, str]]) -> None:
        t = n.t
        if t == "Identifier":
            for scope in reversed(scopes):
                if n.name in scope:
                    n.name = scope[n.name]
                    break
            return
        if t in _FUNCTIONS:
            own: dict[str, str] = {}
            if n.id is not None:
                if t == "FunctionExpression":
                    self.declare(own, iter([n.id.name]))
                    self.visit(n.id, [*scopes, own])
                else:
                    self.visit(n.id, scopes)
            if n.computed and n.key is not None:
                self.visit(n.key, scopes)
            inner: dict[str, str] = {}
            for p in [*n.params, *([n.rest] if n.rest is not None else [])]:
                self.declare(inner, (i.name for i in bound(p.pattern)))
            body = n.body.body if n.body is not None and n.body.t == "BlockStatement" else []
            self.declare(inner, self.hoisted(body))
            deeper = [*scopes, own, inner]
            for p in [*n.params, *([n.rest] if n.rest is not None else [])]:
                self.visit(p, deeper)
            if n.body is not None:
                if n.body.t == "BlockStatement":
                    block: dict[str, str] = {}
                    self.declare(block, self.lexical(body))
                    for x in body:
                        self.visit(x, [*deeper, block])
                else:
                    self.visit(n.body, deeper)
            return
        if t in ("ClassDeclaration", "ClassExpression"):
            own = {}
            if n.id is not None:
                if t == "ClassExpression":
                    self.declare(own, iter([n.id.name]))
                self.visit(n.id, [*scopes, own])
            if n.base is not None:
                self.visit(n.base, [*scopes, own])
            for m in n.body:
                self.visit(m, [*scopes, own])
            return
        scope = {}
        if t in ("BlockStatement", "StaticBlock"):
            self.declare(scope, self.lexical(n.body))
        elif t == "SwitchStatement":
            self.declare(scope, self.lexical([s for c in n.cases for s in c.consequent]))
        elif t in ("ForStatement", "ForOfStatement", "ForInStatement"):
            head = n.init if t == "ForStatement" else n.left
            self.declare(scope, self.lexical([head] if head is not None else []))
        elif t == "CatchClause":
            self.declare(scope, (i.name for i in bound(n.param)))
        deeper = [*scopes, scope] if scope else scopes
        for x in parts(n):
            self.visit(x, deeper)
