"""Labelled ordered trees of syntax, and how syntax nodes become them.

A tree node has a label (what it says), a kind (its syntactic class) and children. The shape of every
syntax node is one row of ``SHAPES``: kind, label and the fields that become children, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from twinscan.ts.parse import Node


class Tree:
    __slots__ = ("label", "kind", "kids", "s", "e", "_size")

    def __init__(self, label: str, kind: str, kids: list[Tree] | None = None, s: int = 0, e: int = 0):
        self.label, self.kind, self.kids, self.s, self.e, self._size = label, kind, kids if kids is not None else [], s, e, 0

    @property
    def size(self) -> int:
        if not self._size:
            self._size = 1 + sum(k.size for k in self.kids)
        return self._size

    def walk(self) -> Iterator[Tree]:
        """Preorder."""
        stack = [self]
        while stack:
            t = stack.pop()
            yield t
            if t.kids:
                stack += t.kids[::-1]

    def same(self, other: Tree) -> bool:
        return self.label == other.label and self.kind == other.kind and len(self.kids) == len(other.kids) and all(a.same(b) for a, b in zip(self.kids, other.kids))

    def key(self) -> bytes:
        """Structural hash: equal for equal trees."""
        text = "".join([f"{t.label}\0{t.kind}\0{len(t.kids)}\0" for t in self.walk()])
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()

    def __repr__(self) -> str:
        return self.label + (f"({', '.join(map(repr, self.kids))})" if self.kids else "")


# Names of operators in labels.
BINARY = {
    "+": "Addition", "-": "Subtraction", "*": "Multiplication", "/": "Division", "%": "Remainder", "**": "Exponential",
    "<<": "ShiftLeft", ">>": "ShiftRight", ">>>": "ShiftRightZeroFill", "|": "BitwiseOR", "^": "BitwiseXOR", "&": "BitwiseAnd",
    "==": "Equality", "!=": "Inequality", "===": "StrictEquality", "!==": "StrictInequality",
    "<": "LessThan", "<=": "LessEqualThan", ">": "GreaterThan", ">=": "GreaterEqualThan", "in": "In", "instanceof": "Instanceof",
}
LOGICAL = {"&&": "And", "||": "Or", "??": "Coalesce"}
UNARY = {"-": "UnaryNegation", "+": "UnaryPlus", "!": "LogicalNot", "~": "BitwiseNot", "typeof": "Typeof", "void": "Void", "delete": "Delete"}
UPDATE = {"++": "Increment", "--": "Decrement"}
ASSIGN = {"=": "Assign", "&&=": "LogicalAnd", "||=": "LogicalOr", "??=": "LogicalNullish"} | {k + "=": v for k, v in BINARY.items() if k in "+ - * / % ** << >> >>> | ^ &".split()}


def number_text(v: float) -> str:
    return str(int(v)) if v == int(v) else repr(v)


def key_text(key: Node, computed: bool | None) -> str:
    """A member key as part of a label."""
    if computed:
        return "ComputedKey"
    return {
        "Identifier": lambda: key.name,
        "PrivateIdentifier": lambda: f"#{key.name}",
        "StringLiteral": lambda: f'"{key.value}"',
        "NumericLiteral": lambda: number_text(key.value),
        "BigIntLiteral": lambda: key.value,
    }.get(key.t, lambda: "ComputedKey")()


def _function_label(n: Node) -> str:
    return ("Async" if n.is_async else "") + ("Generator" if n.generator else "") + "FunctionExpression"


def _optional(mark: str) -> Callable[[Node], str]:
    return lambda n: "?" + mark if mark[0] == "." and n.optional else "?." + mark if n.optional else mark


_METHOD = {"constructor": "Constructor", "method": "Method", "get": "Getter", "set": "Setter"}

# Syntax type -> (kind, label or how to get it, fields that become children).
SHAPES: dict[str, tuple[str, object, tuple[str, ...]]] = {
    "Program": ("Program", "Program", ("body",)),
    "BlockStatement": ("BlockStatement", "BlockStatement", ("body",)),
    "ExpressionStatement": ("ExpressionStatement", "ExpressionStatement", ("expression",)),
    "IfStatement": ("IfStatement", "IfStatement", ("test", "consequent", "alternate")),
    "ReturnStatement": ("ReturnStatement", "ReturnStatement", ("argument",)),
    "ForStatement": ("ForStatement", "ForStatement", ("init", "test", "update", "body")),
    "ForOfStatement": ("ForOfStatement", lambda n: "ForAwaitOfStatement" if n.is_await else "ForOfStatement", ("left", "right", "body")),
    "ForInStatement": ("ForInStatement", "ForInStatement", ("left", "right", "body")),
    "WhileStatement": ("WhileStatement", "WhileStatement", ("test", "body")),
    "DoWhileStatement": ("DoWhileStatement", "DoWhileStatement", ("body", "test")),
    "ThrowStatement": ("ThrowStatement", "ThrowStatement", ("argument",)),
    "TryStatement": ("TryStatement", "TryStatement", ("block", "handler", "finally_")),
    "CatchClause": ("CatchClause", "CatchClause", ("param", "body")),
    "FinallyClause": ("FinallyClause", "FinallyClause", ("body",)),
    "SwitchStatement": ("SwitchStatement", "SwitchStatement", ("discriminant", "cases")),
    "SwitchCase": ("SwitchCase", lambda n: "SwitchCase" if n.test else "DefaultCase", ("test", "consequent")),
    "BreakStatement": ("BreakStatement", lambda n: f"break:{n.label}" if n.label else "BreakStatement", ()),
    "ContinueStatement": ("ContinueStatement", lambda n: f"continue:{n.label}" if n.label else "ContinueStatement", ()),
    "LabeledStatement": ("LabeledStatement", lambda n: f"label:{n.label}", ("body",)),
    "EmptyStatement": ("EmptyStatement", "EmptyStatement", ()),
    "DebuggerStatement": ("DebuggerStatement", "DebuggerStatement", ()),
    "WithStatement": ("WithStatement", "WithStatement", ("object", "body")),
    "FunctionDeclaration": ("FunctionDeclaration", lambda n: n.id.name if n.id else n.default_label or "Function", ("params", "body")),
    "ClassDeclaration": ("ClassDeclaration", lambda n: n.id.name if n.id else n.default_label or "Class", ("body",)),
    "ClassExpression": ("ClassDeclaration", lambda n: n.id.name if n.id else "ClassExpression", ("body",)),
    "VariableDeclaration": ("VariableDeclaration", lambda n: f"{n.kind.capitalize()}Declaration", ("declarations",)),
    "VariableDeclarator": ("VariableDeclarator", "VariableDeclarator", ("id", "init")),
    "Parameter": ("Parameter", "Parameter", ("pattern",)),
    "Method": ("MethodDefinition", lambda n: ("static_" if n.static else "") + f"{_METHOD[n.kind]}:{key_text(n.key, n.computed)}", ("params", "body")),
    "Property": ("PropertyDefinition", lambda n: ("static_" if n.static else "") + key_text(n.key, n.computed), ("value",)),
    "StaticBlock": ("StaticBlock", "StaticBlock", ("body",)),
    "Accessor": ("AccessorProperty", "AccessorProperty", ()),
    "StringLiteral": ("StringLiteral", lambda n: f'"{n.value}"', ()),
    "NumericLiteral": ("NumericLiteral", lambda n: number_text(n.value), ()),
    "BooleanLiteral": ("BooleanLiteral", lambda n: "true" if n.value else "false", ()),
    "NullLiteral": ("NullLiteral", "null", ()),
    "BigIntLiteral": ("BigIntLiteral", lambda n: n.value, ()),
    "RegExpLiteral": ("RegExpLiteral", lambda n: f"/{n.pattern}/{n.flags}", ()),
    "TaggedTemplate": ("TaggedTemplateExpression", "TaggedTemplateExpression", ("tag", "quasi")),
    "BinaryExpression": ("BinaryExpression", lambda n: BINARY[n.operator], ("left", "right")),
    "LogicalExpression": ("LogicalExpression", lambda n: LOGICAL[n.operator], ("left", "right")),
    "AssignmentExpression": ("AssignmentExpression", lambda n: ASSIGN[n.operator], ("left", "right")),
    "UnaryExpression": ("UnaryExpression", lambda n: UNARY[n.operator], ("argument",)),
    "UpdateExpression": ("UpdateExpression", lambda n: f"{UPDATE[n.operator]}-{'prefix' if n.prefix else 'postfix'}", ("argument",)),
    "ConditionalExpression": ("ConditionalExpression", "ConditionalExpression", ("test", "consequent", "alternate")),
    "SequenceExpression": ("SequenceExpression", "SequenceExpression", ("expressions",)),
    "Index": ("ComputedMemberExpression", _optional("[]"), ("object", "index")),
    "CallExpression": ("CallExpression", lambda n: "?.()" if n.optional else "CallExpression", ("callee", "arguments")),
    "NewExpression": ("NewExpression", "NewExpression", ("callee", "arguments")),
    "AwaitExpression": ("AwaitExpression", "AwaitExpression", ("argument",)),
    "YieldExpression": ("YieldExpression", lambda n: "YieldDelegateExpression" if n.delegate else "YieldExpression", ("argument",)),
    "ObjectExpression": ("ObjectExpression", "ObjectExpression", ("properties",)),
    "ArrayExpression": ("ArrayExpression", "ArrayExpression", ("elements",)),
    "SpreadElement": ("SpreadElement", "SpreadElement", ("argument",)),
    "SpreadProperty": ("SpreadProperty", "SpreadProperty", ("argument",)),
    "ThisExpression": ("ThisExpression", "ThisExpression", ()),
    "Super": ("Super", "Super", ()),
    "MetaProperty": ("MetaProperty", lambda n: n.name, ()),
    "ImportExpression": ("ImportExpression", "ImportExpression", ("source",)),
    "ChainExpression": ("ChainExpression", "ChainExpression", ("expression",)),
    "ArrowFunctionExpression": ("ArrowFunctionExpression", lambda n: "AsyncArrowFunction" if n.is_async else "ArrowFunction", ("params", "body")),
    "FunctionExpression": ("FunctionExpression", _function_label, ("params", "body")),
    "ArrayPattern": ("ArrayPattern", "ArrayPattern", ("elements", "rest_")),
    "ObjectPattern": ("ObjectPattern", "ObjectPattern", ("properties", "rest_")),
    "RestElement": ("RestElement", "RestElement", ("argument",)),
    "AssignmentPattern": ("AssignmentPattern", "AssignmentPattern", ("left", "right")),
    "PrivateIdentifier": ("PrivateIdentifier", lambda n: f"#{n.name}", ()),
}
_TRANSPARENT = {"Paren", "As", "NonNull"}
_TYPE_ONLY = {"InterfaceDeclaration", "TypeAlias", "EnumDeclaration", "ModuleDeclaration", "DeclareStatement", "ImportDeclaration", "ExportAllDeclaration", "ExportAssignment"}


class Renderer:
    """Turns syntax into trees; ``canonical`` labels async and generator declarations apart."""

    def __init__(self, canonical: bool = False, statements: Callable[[list[Tree]], list[Tree]] | None = None):
        self.canonical, self.statements = canonical, statements

    def render(self, n: Node, binding: bool = False) -> Tree:
        t = n.t
        if t in _TRANSPARENT:
            return self.render(n.expression)
        if t == "Identifier":
            return Tree(n.name, "BindingIdentifier" if binding else "Identifier", None, n.s, n.e)
        if t in ("Member", "PrivateMember"):
            private = t == "PrivateMember"
            name = Tree(f"#{n.property}", "PrivateIdentifier") if private else Tree(n.property, "Identifier")
            label = ("?.#" if n.optional else ".#") if private else ("?." if n.optional else ".")
            return Tree(label, "PrivateFieldExpression" if private else "StaticMemberExpression", [self.render(n.object), name], n.s, n.e)
        if t == "TemplateLiteral":
            kids = [Tree(f"`{q}`", "TemplateElement") for q in n.quasis]
            return Tree("TemplateLiteral", "TemplateLiteral", kids + [self.render(e) for e in n.expressions], n.s, n.e)
        if t == "ObjectProperty":
            return Tree("ObjectProperty", "ObjectProperty", [self.key(n), self.render(n.value)], n.s, n.e)
        if t == "BindingProperty":
            return Tree("BindingProperty", "BindingProperty", [self.key(n), self.render(n.value, True)], n.s, n.e)
        if t in ("ExportNamedDeclaration", "ExportDefaultDeclaration"):
            return self.export(n)
        if t in _TYPE_ONLY:
            return Tree("Statement", "Statement", None, n.s, n.e)
        if t == "AssignmentExpression" and n.left.t in ("ArrayExpression", "ObjectExpression"):
            opaque = n.left.t.replace("Expression", "AssignmentTarget")
            return Tree("Assign", t, [Tree(opaque, opaque), self.render(n.right)], n.s, n.e)
        if t == "ChainExpression":
            inner = self.render(n.expression)
            inner.label = {"CallExpression": "?.()", "StaticMemberExpression": "?.", "ComputedMemberExpression": "?.[]", "PrivateFieldExpression": "?.#"}.get(inner.kind, inner.label)
            return Tree(t, t, [inner], n.s, n.e)
        shape = SHAPES.get(t)
        if shape is None:
            return Tree("Expression", "Expression", None, n.s, n.e)
        kind, label, names = shape
        text = label if isinstance(label, str) else label(n)  # type: ignore[operator]
        if self.canonical and t == "FunctionDeclaration":
            text = ("async " if n.is_async else "") + ("*" if n.generator else "") + text
        kids: list[Tree] = []
        for name in names:
            self.field(n, name, kids)
        return Tree(text, kind, kids, n.s, n.e)

    def field(self, n: Node, name: str, kids: list[Tree]) -> None:
        t = n.t
        if name == "rest_":
            if n.rest is not None:
                kids.append(Tree("RestElement", "RestElement", [self.render(n.rest, True)]))
            return
        if name == "finally_":
            if n.finalizer is not None:
                kids.append(Tree("FinallyClause", "FinallyClause", [self.render(n.finalizer)]))
            return
        value = getattr(n, name)
        if value is None:
            return
        if isinstance(value, list):
            if name in ("body", "consequent") and t in ("Program", "BlockStatement", "StaticBlock", "SwitchCase"):
                kids.extend(self.sequence(value, t == "BlockStatement"))
            elif t in ("ClassDeclaration", "ClassExpression"):
                kids.extend(self.render(m) for m in value if m.t in ("Method", "Property", "StaticBlock", "Accessor"))
            elif t == "ObjectExpression":
                for p in value:
                    if p.t == "SpreadElement":
                        kids.append(Tree("SpreadProperty", "SpreadProperty", [self.render(p.argument)]))
                    else:
                        kids.append(self.render(p))
            else:
                pattern = t in ("ArrayPattern", "ObjectPattern")
                kids.extend(Tree("Elision", "Elision") if v is None else self.render(v, pattern) for v in value)
            return
        if name in ("id", "pattern", "param") or t == "AssignmentPattern" and name == "left":
            kids.append(self.render(value, True))
        else:
            kids.append(self.render(value))

    def sequence(self, body: list[Node], block: bool) -> list[Tree]:
        out = [self.render(n) for n in body]
        return self.statements(out) if block and self.statements else out

    def key(self, n: Node) -> Tree:
        if n.key.t == "Identifier" and not n.computed:
            return Tree(n.key.name, "Identifier")
        return self.render(n.key)

    def export(self, n: Node) -> Tree:
        d = n.declaration
        if n.t == "ExportNamedDeclaration":
            if d is None:
                return Tree(n.t, n.t, None, n.s, n.e)
            return Tree("Declaration", "Declaration", None, n.s, n.e) if d.t in _TYPE_ONLY else self.render(d)
        if d.t in ("FunctionDeclaration", "ClassDeclaration"):
            d.default_label = "DefaultFunction" if d.t == "FunctionDeclaration" else "DefaultClass"
            return self.render(d)
        if d.t in _TYPE_ONLY:
            return Tree(n.t, n.t, None, n.s, n.e)
        return Tree(n.t, n.t, [self.render(d)], n.s, n.e)


def literal_tree(program: Node) -> Tree:
    """The tree of a program as written."""
    return Renderer().render(program)
