"""Canonical forms: programs that do the same in different words become one tree.

Three steps. Names are made positional (``scope``). Syntax is desugared to syntax: ternaries to branches,
callbacks to loops, templates to sums, and so on, each rewrite under the guard that keeps its meaning. Then the
rendered statement lists go through peepholes written as tree patterns, and symbols are renumbered by first use.
"""

from __future__ import annotations

from twinscan.ts.parse import Node
from twinscan.ts.scope import MARK, Renamer, bound
from twinscan.ts.tree import BINARY, Renderer, Tree

_EQUALITY = {"==", "!=", "===", "!=="}
_OPPOSITE = {"==": "!=", "!=": "==", "===": "!==", "!==": "==="}
_LITERALS = {"StringLiteral", "NumericLiteral", "BooleanLiteral", "NullLiteral", "BigIntLiteral"}
_COMPOUND = {op for op in BINARY if op in "+ - * / % ** << >> >>> | ^ &".split()}
_JUMPS = {"ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement"}


def make(t: str, **fields) -> Node:
    return Node(t, 0, 0, **fields)


def bare(n: Node) -> Node:
    """The expression inside parentheses and type wrappers."""
    while n.t in ("Paren", "As", "NonNull"):
        n = n.expression
    return n


def pure(n: Node) -> bool:
    """Whether reading it has no effect: a name, this, a literal, or a plain member of one."""
    n = bare(n)
    return n.t in ("Identifier", "ThisExpression") or n.t in _LITERALS or n.t == "Member" and not n.optional and pure(n.object)


def equal(a: Node, b: Node) -> bool:
    """Whether two pure expressions read the same."""
    a, b = bare(a), bare(b)
    if a.t != b.t:
        return False
    if a.t == "Identifier":
        return a.name == b.name
    if a.t in ("ThisExpression", "NullLiteral"):
        return True
    if a.t in ("StringLiteral", "NumericLiteral", "BooleanLiteral"):
        return a.value == b.value
    return a.t == "Member" and not a.optional and not b.optional and a.property == b.property and equal(a.object, b.object)


def undefined(n: Node) -> bool:
    n = bare(n)
    return n.t == "Identifier" and n.name == "undefined" or n.t == "UnaryExpression" and n.operator == "void" and pure(n.argument)


def literal(n: Node) -> bool:
    return bare(n).t in _LITERALS or undefined(n)


def null(n: Node) -> bool:
    return bare(n).t == "NullLiteral"


def nullish(n: Node) -> tuple[Node, bool] | None:
    """(subject, positive) of a test for null and undefined together, in any spelling."""
    n = bare(n)
    if n.t == "BinaryExpression" and n.operator in ("==", "!="):
        for x, y in ((n.left, n.right), (n.right, n.left)):
            if (null(y) or undefined(y)) and pure(x) and not literal(x):
                return bare(x), n.operator == "=="
    if n.t == "LogicalExpression" and n.operator in ("||", "&&"):
        op = "===" if n.operator == "||" else "!=="
        sides = []
        for side in (bare(n.left), bare(n.right)):
            if side.t != "BinaryExpression" or side.operator != op:
                return None
            x, y = (side.left, side.right) if literal(side.right) else (side.right, side.left)
            if not pure(x) or literal(x) or not (null(y) or undefined(y)):
                return None
            sides.append((bare(x), null(y)))
        if sides[0][1] != sides[1][1] and equal(sides[0][0], sides[1][0]):
            return sides[0][0], n.operator == "||"
    return None


def jumps(body: list[Node]) -> bool:
    """Whether a statement list always leaves by a jump."""
    if not body:
        return False
    n = body[-1]
    if n.t == "BlockStatement":
        return jumps(n.body)
    if n.t == "IfStatement":
        return n.alternate is not None and jumps([n.consequent]) and jumps([n.alternate])
    return n.t in _JUMPS


def returns(n: Node) -> bool:
    """Whether a statement has a return of its own, not of a nested function."""
    if n.t == "ReturnStatement":
        return True
    inner = [n.consequent if isinstance(n.consequent, Node) else None, n.alternate, n.block, n.finalizer, n.handler, n.body if isinstance(n.body, Node) else None]
    lists = [*(n.body if isinstance(n.body, list) else []), *(n.cases or []), *(n.consequent if isinstance(n.consequent, list) else [])]
    if not n.t.endswith(("Statement", "Clause", "Case")):
        return False
    return any(returns(x) for x in [*inner, *lists] if x is not None)


def block_of(n: Node | list[Node]) -> Node:
    if isinstance(n, list):
        return make("BlockStatement", body=n)
    return n if n.t == "BlockStatement" else make("BlockStatement", body=[n])


class Desugar:
    """Rewrites syntax into its canonical words."""

    # statements
    def block(self, n: Node) -> Node:
        body = n.body if n.t == "BlockStatement" else [n]
        return Node("BlockStatement", n.s, n.e, body=self.list(body))

    def list(self, body: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in body:
            for x in self.statement(n):
                if not x.e:
                    x.s, x.e = n.s, n.e
                out.append(x)
        return out

    def statement(self, n: Node) -> list[Node]:
        rewrite = getattr(self, "on_" + n.t, None)
        return rewrite(n) if rewrite else [self.node(n)]

    def on_ReturnStatement(self, n: Node) -> list[Node]:
        return self.returned(n.argument)

    def returned(self, argument: Node | None) -> list[Node]:
        if argument is None:
            return [make("ReturnStatement")]
        e = bare(argument)
        if e.t == "AwaitExpression":
            e = bare(e.argument)
        then = self.then(e)
        if then:
            return self.awaited(then, "ReturnStatement")
        if e.t == "ConditionalExpression" and self.contracted(e) is None:
            test, yes, no = self.branches(e)
            return [make("IfStatement", test=test, consequent=make("BlockStatement", body=self.returned(yes))), *self.returned(no)]
        return [make("ReturnStatement", argument=self.expr(e))]

    def branches(self, e: Node) -> tuple[Node, Node, Node]:
        """Test and branches of a ternary, turned round where the test is negative."""
        test, yes, no = bare(e.test), bare(e.consequent), bare(e.alternate)
        if test.t == "UnaryExpression" and test.operator == "!":
            return self.test(test.argument), no, yes
        if test.t == "BinaryExpression" and test.operator in ("!==", "!="):
            return self.negated(test), no, yes
        return self.test(test), yes, no

    def then(self, e: Node) -> tuple[Node, Node | None, Node, bool] | None:
        """(promise, parameter, body, body is an expression) of a ``.then`` with one inline callback."""
        if e.t != "CallExpression" or e.optional or len(e.arguments) != 1:
            return None
        callee, f = bare(e.callee), bare(e.arguments[0])
        if callee.t != "Member" or callee.optional or callee.property != "then":
            return None
        if f.t not in ("ArrowFunctionExpression", "FunctionExpression") or f.generator or f.rest is not None or len(f.params) > 1 or f.body is None:
            return None
        return callee.object, f.params[0].pattern if f.params else None, f.body, bool(f.plain)

    def awaited(self, then: tuple, last: str) -> list[Node]:
        promise, name, body, plain = then
        wait = make("AwaitExpression", argument=self.expr(promise))
        if name is not None:
            first = make("VariableDeclaration", kind="const", declarations=[make("VariableDeclarator", id=self.pattern(name), init=wait)])
        else:
            first = make("ExpressionStatement", expression=wait)
        if plain:
            value = self.expr(body)
            rest = [make(last, argument=value) if last == "ReturnStatement" else make(last, expression=value)]
        else:
            rest = self.list(body.body)
        return [first, *rest]

    def on_ExpressionStatement(self, n: Node) -> list[Node]:
        e = bare(n.expression)
        awaited = bare(e.argument) if e.t == "AwaitExpression" else e
        then = self.then(awaited)
        if then and (then[3] or not any(map(returns, then[2].body))):
            return self.awaited(then, "ExpressionStatement")
        if e.t == "AssignmentExpression" and e.operator == "=":
            value = bare(e.right)
            if value.t == "ConditionalExpression" and self.contracted(value) is None and e.left.t not in ("ArrayExpression", "ObjectExpression"):
                return [self.branch(value, lambda v: make("ExpressionStatement", expression=self.expr(make("AssignmentExpression", operator="=", left=e.left, right=v))))]
        if e.t == "CallExpression" and not e.optional and len(e.arguments) == 1:
            callee, f = bare(e.callee), bare(e.arguments[0])
            if callee.t == "Member" and not callee.optional and callee.property == "forEach" and f.t in ("ArrowFunctionExpression", "FunctionExpression"):
                if not f.is_async and not f.generator and f.rest is None and len(f.params) == 1 and f.params[0].pattern.t == "Identifier" and not f.params[0].init:
                    plain = f.plain
                    if plain or not any(map(returns, f.body.body)):
                        body = [make("ExpressionStatement", expression=f.body)] if plain else f.body.body
                        name = make("VariableDeclaration", kind="const", declarations=[make("VariableDeclarator", id=f.params[0].pattern)])
                        return [make("ForOfStatement", left=name, right=self.expr(callee.object), body=make("BlockStatement", body=self.list(body)))]
        return [Node(n.t, n.s, n.e, expression=self.discarded(e))]

    def discarded(self, n: Node) -> Node:
        """An expression whose value nobody reads: a step by one is a compound assignment."""
        e = bare(n)
        if e.t == "UpdateExpression":
            return make("AssignmentExpression", operator="+=" if e.operator == "++" else "-=", left=self.expr(e.argument), right=make("NumericLiteral", value=1.0))
        return self.expr(e)

    def branch(self, e: Node, leaf) -> Node:
        """A chain of branches with ``leaf`` at the ends of a ternary."""
        test, yes, no = self.branches(e)
        other = self.branch(no, leaf) if no.t == "ConditionalExpression" else make("BlockStatement", body=[leaf(no)])
        return make("IfStatement", test=test, consequent=make("BlockStatement", body=[leaf(yes)]), alternate=other)

    def on_VariableDeclaration(self, n: Node) -> list[Node]:
        if len(n.declarations) == 1:
            d = n.declarations[0]
            value = bare(d.init) if d.init is not None else None
            if value is not None and d.id.t == "Identifier" and value.t == "ConditionalExpression" and self.contracted(value) is None:
                name = d.id.name
                declare = make("VariableDeclaration", kind="let", declarations=[make("VariableDeclarator", id=d.id)])
                assign = lambda v: make("ExpressionStatement", expression=make("AssignmentExpression", operator="=", left=make("Identifier", name=name), right=self.expr(v)))
                return [declare, self.branch(value, assign)]
            if value is not None and d.id.t == "ObjectPattern" and d.id.rest is None and d.id.properties and pure(value):
                if all(p.value.t == "Identifier" and not p.computed and p.key.t == "Identifier" for p in d.id.properties):
                    return [make("VariableDeclaration", kind=n.kind, declarations=[make("VariableDeclarator", id=p.value, init=make("Member", object=self.expr(value), property=p.key.name))]) for p in d.id.properties]
        return [self.node(n)]

    def on_IfStatement(self, n: Node) -> list[Node]:
        test, yes, no = bare(n.test), n.consequent, n.alternate
        if no is not None and no.t == "BlockStatement" and len(no.body) == 1 and no.body[0].t == "IfStatement":
            no = no.body[0]
        if no is not None and no.t != "IfStatement":
            if test.t == "UnaryExpression" and test.operator == "!":
                test, yes, no = bare(test.argument), no, yes
            elif test.t == "BinaryExpression" and test.operator in ("!==", "!="):
                test, yes, no = make("BinaryExpression", operator=_OPPOSITE[test.operator], left=test.left, right=test.right), no, yes
        then = self.block(yes)
        if no is None:
            return [Node(n.t, n.s, n.e, test=self.test(test), consequent=then)]
        if jumps(then.body):
            rest = self.list(no.body if no.t == "BlockStatement" else [no])
            return [Node(n.t, n.s, n.e, test=self.test(test), consequent=then), *rest]
        if no.t == "IfStatement":
            inner = self.statement(no)
            other = inner[0] if len(inner) == 1 else make("BlockStatement", body=inner)
        else:
            other = self.block(no)
        return [Node(n.t, n.s, n.e, test=self.test(test), consequent=then, alternate=other)]

    def on_SwitchStatement(self, n: Node) -> list[Node]:
        lowered = self.switch(n)
        if lowered is not None:
            return lowered
        cases = [make("SwitchCase", test=self.expr(c.test) if c.test is not None else None, consequent=self.list(c.consequent)) for c in n.cases]
        return [Node(n.t, n.s, n.e, discriminant=self.expr(n.discriminant), cases=cases)]

    def switch(self, n: Node) -> list[Node] | None:
        """Branches for a switch over something pure whose cases all end in a jump, default last."""
        if not n.cases or not pure(n.discriminant):
            return None
        groups: list[tuple[list[Node | None], list[Node]]] = []
        tests: list[Node | None] = []
        for i, c in enumerate(n.cases):
            tests.append(c.test)
            last = i == len(n.cases) - 1
            if not c.consequent and not last:
                continue
            body = c.consequent[0].body if len(c.consequent) == 1 and c.consequent[0].t == "BlockStatement" else c.consequent
            if not last and not (body and body[-1].t in _JUMPS):
                return None
            groups.append((tests, body))
            tests = []
        if any(None in t for t, _ in groups[:-1]) or None in groups[-1][0] and len(groups[-1][0]) > 1:
            return None
        plain: list[tuple[list, list[Node], bool]] = []
        for t, body in groups:
            breaks = bool(body) and body[-1].t == "BreakStatement" and not body[-1].label
            inner = body[:-1] if breaks else body
            if any(self.leaves(x) for x in inner):
                return None
            plain.append((t, inner, breaks or not jumps(body)))
        chain: list[Node] = []
        for t, body, falls in reversed(plain):
            if t == [None]:
                chain = self.list(body)
                continue
            test = None
            for x in t:
                one = self.expr(make("BinaryExpression", operator="===", left=n.discriminant, right=x))
                test = one if test is None else make("LogicalExpression", operator="||", left=test, right=one)
            branch = make("IfStatement", test=test, consequent=make("BlockStatement", body=self.list(body)))
            if not falls:
                chain = [branch, *chain]
            else:
                if chain:
                    branch.alternate = chain[0] if len(chain) == 1 and chain[0].t == "IfStatement" else make("BlockStatement", body=chain)
                chain = [branch]
        return chain

    def leaves(self, n: Node) -> bool:
        """Whether a statement breaks out of an enclosing switch."""
        if n.t == "BreakStatement":
            return not n.label
        if n.t in ("ForStatement", "ForOfStatement", "ForInStatement", "WhileStatement", "DoWhileStatement", "SwitchStatement") or not n.t.endswith(("Statement", "Clause")):
            return False
        kids = [n.consequent, n.alternate, n.block, n.finalizer, n.handler, *(n.body if isinstance(n.body, list) else [n.body])]
        return any(self.leaves(x) for x in kids if isinstance(x, Node))

    def on_ForStatement(self, n: Node) -> list[Node]:
        body = self.block(n.body)
        if n.init is None and n.update is None:
            return [Node("WhileStatement", n.s, n.e, test=self.test(n.test) if n.test is not None else make("BooleanLiteral", value=True), body=body)]
        init = self.node(n.init) if n.init is not None and n.init.t == "VariableDeclaration" else self.expr(n.init) if n.init is not None else None
        return [Node(n.t, n.s, n.e, init=init, test=self.test(n.test) if n.test is not None else None, update=self.discarded(n.update) if n.update is not None else None, body=body)]

    def on_WhileStatement(self, n: Node) -> list[Node]:
        return [Node(n.t, n.s, n.e, test=self.test(n.test), body=self.block(n.body))]

    on_DoWhileStatement = on_WhileStatement

    def _for_each(self, n: Node) -> list[Node]:
        left = self.node(n.left) if n.left.t == "VariableDeclaration" else self.expr(n.left)
        return [Node(n.t, n.s, n.e, left=left, right=self.expr(n.right), is_await=n.is_await, body=self.block(n.body))]

    on_ForOfStatement = on_ForInStatement = _for_each

    def on_BlockStatement(self, n: Node) -> list[Node]:
        return [self.block(n)]

    # expressions
    def pattern(self, n: Node) -> Node:
        return self.node(n)

    def node(self, n: Node) -> Node:
        """The node with its fields desugared."""
        out = Node(n.t, n.s, n.e)
        for name, v in n.__dict__.items():
            if name in ("t", "s", "e") or name in out.__dict__:
                continue
            if isinstance(v, Node):
                out.__dict__[name] = self.block(v) if v.t == "BlockStatement" else self.child(v)
            elif isinstance(v, list):
                if name in ("body", "consequent") and n.t in ("Program", "StaticBlock", "SwitchCase"):
                    out.__dict__[name] = self.list(v)
                else:
                    out.__dict__[name] = [self.child(x) if isinstance(x, Node) else x for x in v]
            else:
                out.__dict__[name] = v
        return out

    def child(self, n: Node) -> Node:
        if n.t.startswith("T") and n.t not in ("TemplateLiteral", "TaggedTemplate", "ThisExpression", "TryStatement", "ThrowStatement"):
            return n  # a type annotation
        if n.t.endswith("Statement") or n.t in ("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration"):
            out = self.statement(n)
            return out[0] if len(out) == 1 else make("BlockStatement", body=out)
        return self.expr(n)

    def expr(self, n: Node) -> Node:
        n = bare(n)
        rewrite = getattr(self, "x_" + n.t, None)
        return rewrite(n) if rewrite else self.node(n)

    def x_TemplateLiteral(self, n: Node) -> Node:
        text = lambda v: make("StringLiteral", value=v)
        items: list[Node] = []
        if n.expressions and not n.quasis[0] and not n.quasis[1]:
            items.append(text(""))
        for i, q in enumerate(n.quasis):
            if q:
                items.append(text(q))
            if i < len(n.expressions):
                items.append(self.expr(n.expressions[i]))
        if not items:
            return text("")
        out = items[0]
        for x in items[1:]:
            out = make("BinaryExpression", operator="+", left=out, right=x)
        return out

    def x_TaggedTemplate(self, n: Node) -> Node:
        quasi = Node("TemplateLiteral", n.quasi.s, n.quasi.e, quasis=n.quasi.quasis, expressions=[self.expr(e) for e in n.quasi.expressions])
        return Node(n.t, n.s, n.e, tag=self.expr(n.tag), quasi=quasi)

    def x_BinaryExpression(self, n: Node) -> Node:
        a, b = n.left, n.right
        if n.operator in _EQUALITY and literal(a) and not literal(b):
            a, b = b, a
        return Node(n.t, n.s, n.e, operator=n.operator, left=self.expr(a), right=self.expr(b))

    def x_LogicalExpression(self, n: Node) -> Node:
        found = nullish(n)
        if found:
            return self.null_test(*found)
        return Node(n.t, n.s, n.e, operator=n.operator, left=self.expr(n.left), right=self.expr(n.right))

    def null_test(self, subject: Node, positive: bool) -> Node:
        return make("BinaryExpression", operator="==" if positive else "!=", left=self.expr(subject), right=make("NullLiteral"))

    def x_AssignmentExpression(self, n: Node) -> Node:
        left, right = bare(n.left), bare(n.right)
        if n.operator == "=" and right.t == "BinaryExpression" and right.operator in _COMPOUND and self.short_target(left) and equal(left, right.left):
            return Node(n.t, n.s, n.e, operator=right.operator + "=", left=self.expr(left), right=self.expr(right.right))
        target = left if left.t in ("ArrayExpression", "ObjectExpression") else self.expr(left)
        return Node(n.t, n.s, n.e, operator=n.operator, left=target, right=self.expr(right))

    def short_target(self, n: Node) -> bool:
        return n.t == "Identifier" or n.t == "Member" and not n.optional and bare(n.object).t in ("Identifier", "ThisExpression")

    def x_UnaryExpression(self, n: Node) -> Node:
        if n.operator == "!":
            return self.negated(n.argument)
        if n.operator == "void" and pure(n.argument):
            return make("Identifier", name="undefined")
        return self.node(n)

    def negated(self, n: Node) -> Node:
        """The negation of an expression, pushed to where the meaning allows."""
        n = bare(n)
        if n.t == "BinaryExpression" and n.operator in _EQUALITY:
            return self.expr(make("BinaryExpression", operator=_OPPOSITE[n.operator], left=n.left, right=n.right))
        if n.t == "LogicalExpression" and n.operator in ("&&", "||"):
            found = nullish(n)
            if found:
                return self.null_test(found[0], not found[1])
            return make("LogicalExpression", operator="||" if n.operator == "&&" else "&&", left=self.negated(n.left), right=self.negated(n.right))
        call = self.boolean_call(n)
        if call is not None:
            return make("UnaryExpression", operator="!", argument=self.expr(call))
        return make("UnaryExpression", operator="!", argument=self.expr(n))

    def boolean_call(self, n: Node) -> Node | None:
        if n.t == "CallExpression" and not n.optional and len(n.arguments) == 1 and n.arguments[0].t != "SpreadElement":
            callee = bare(n.callee)
            if callee.t == "Identifier" and callee.name == "Boolean":
                return n.arguments[0]
        return None

    def test(self, n: Node) -> Node:
        """An expression in a place that reads only its truth."""
        n = bare(n)
        while True:
            if n.t == "UnaryExpression" and n.operator == "!" and bare(n.argument).t == "UnaryExpression" and bare(n.argument).operator == "!":
                n = bare(bare(n.argument).argument)
                continue
            inner = self.boolean_call(n)
            if inner is None:
                return self.expr(n)
            n = bare(inner)

    def contracted(self, n: Node) -> Node | None:
        """The logical operator a ternary stands for, if it does."""
        test, yes, no = bare(n.test), bare(n.consequent), bare(n.alternate)
        found = nullish(test)
        if found:
            subject, positive = found
            same, other = (no, yes) if positive else (yes, no)
            if equal(subject, same):
                return make("LogicalExpression", operator="??", left=self.expr(same), right=self.expr(other))
        if pure(test):
            if equal(test, yes):
                return make("LogicalExpression", operator="||", left=self.expr(test), right=self.expr(no))
            if equal(test, no):
                return make("LogicalExpression", operator="&&", left=self.expr(test), right=self.expr(yes))
        return None

    def x_ConditionalExpression(self, n: Node) -> Node:
        short = self.contracted(n)
        return short if short is not None else Node(n.t, n.s, n.e, test=self.test(n.test), consequent=self.expr(n.consequent), alternate=self.expr(n.alternate))

    def x_Index(self, n: Node) -> Node:
        i, xs = bare(n.index), n.object
        if not n.optional and pure(xs) and i.t == "BinaryExpression" and i.operator == "-":
            length, one = bare(i.left), bare(i.right)
            if length.t == "Member" and length.property == "length" and not length.optional and one.t == "NumericLiteral" and one.value == 1 and equal(length.object, xs):
                minus = make("UnaryExpression", operator="-", argument=make("NumericLiteral", value=1.0))
                return make("CallExpression", callee=make("Member", object=self.expr(xs), property="at"), arguments=[minus])
        return self.node(n)

    def x_CallExpression(self, n: Node) -> Node:
        inner = self.boolean_call(n)
        if inner is not None:
            return make("UnaryExpression", operator="!", argument=make("UnaryExpression", operator="!", argument=self.expr(inner)))
        callee = bare(n.callee)
        if not n.optional and callee.t == "Member" and not callee.optional and callee.property == "assign" and len(n.arguments) >= 2:
            owner, first = bare(callee.object), bare(n.arguments[0])
            if owner.t == "Identifier" and owner.name == "Object" and first.t == "ObjectExpression" and not first.properties and all(a.t != "SpreadElement" for a in n.arguments):
                props: list[Node] = []
                for a in n.arguments[1:]:
                    a = bare(a)
                    props.extend(self.node(a).properties if a.t == "ObjectExpression" else [make("SpreadElement", argument=self.expr(a))])
                return make("ObjectExpression", properties=props)
        return self.node(n)

    def x_ArrowFunctionExpression(self, n: Node) -> Node:
        out = self.node(Node(n.t, n.s, n.e, params=n.params, rest=n.rest, is_async=n.is_async))
        out.body = make("BlockStatement", body=self.returned(n.body)) if n.plain else self.block(n.body)
        return out


# Peepholes over statement lists. A pattern is (label, kind, children) with None for anything; "?x" captures a
# subtree, again if equal; "$x" is a use of the name captured as x; "*" stands for any further children.


def match(t: Tree, pattern, got: dict[str, Tree]) -> bool:
    if isinstance(pattern, str):
        name = pattern[1:]
        if pattern[0] == "$":
            return t.kind == "Identifier" and t.label == got[name].label
        if name in got:
            return got[name].same(t)
        got[name] = t
        return True
    label, kind, kids = pattern
    if label is not None and t.label != label or kind is not None and t.kind != kind:
        return False
    if kids is None:
        return True
    if kids and kids[-1] == "*":
        kids = kids[:-1]
        return len(t.kids) >= len(kids) and all(match(k, p, got) for k, p in zip(t.kids, kids))
    return len(t.kids) == len(kids) and all(match(k, p, got) for k, p in zip(t.kids, kids))


def _declaration(name: str, *value) -> tuple:
    return (None, "VariableDeclaration", [(None, "VariableDeclarator", [name, *value])])


_INDEX_LOOP = (
    "ForStatement", None,
    [
        _declaration("?i", ("0", None, [])),
        ("LessThan", None, ["$i", (".", None, ["?xs", ("length", None, [])])]),
        ("Addition", "AssignmentExpression", ["$i", ("1", None, [])]),
        (None, "BlockStatement", [_declaration("?x", ("[]", None, ["?xs", "$i"])), "*"]),
    ],
)
_EMPTY_LIST = _declaration("?out", (None, "ArrayExpression", []))
_EACH = ("ForOfStatement", None, [_declaration("?x"), "?xs", (None, "BlockStatement", ["?do"])])


def _push(value: str) -> tuple:
    return (None, "ExpressionStatement", [("CallExpression", None, [(".", None, ["$out", ("push", None, [])]), value])])


def uses(t: Tree, label: str, bindings: bool = True) -> int:
    return sum(x.label == label and (x.kind == "Identifier" or bindings and x.kind == "BindingIdentifier") for x in t.walk())


def named(t: Tree) -> tuple[Tree, Tree | None] | None:
    """Name and value of a declaration of one plain name."""
    got: dict[str, Tree] = {}
    if match(t, _declaration("?x", "?v"), got) or match(t, _declaration("?x"), got):
        if got["x"].kind == "BindingIdentifier":
            return got["x"], got.get("v")
    return None


def index_loop(t: Tree) -> Tree:
    """``for (let i = 0; i < xs.length; i += 1) { const x = xs[i]; ... }`` as for-of, if i is used nowhere else."""
    got: dict[str, Tree] = {}
    if not match(t, _INDEX_LOOP, got):
        return t
    i, rest = got["i"].label, t.kids[3].kids[1:]
    if got["i"].kind != "BindingIdentifier" or got["x"].kind != "BindingIdentifier" or uses(got["xs"], i) or any(uses(k, i) for k in rest):
        return t
    name = Tree("ConstDeclaration", "VariableDeclaration", [Tree("VariableDeclarator", "VariableDeclarator", [got["x"]])])
    return Tree("ForOfStatement", "ForOfStatement", [name, got["xs"], Tree("BlockStatement", "BlockStatement", rest)], t.s, t.e)


def chain(t: Tree) -> bool:
    """A name, this, a literal, or a plain member of one."""
    if t.kind in ("Identifier", "BindingIdentifier", "ThisExpression") or t.kind in _LITERALS:
        return True
    return t.kind == "StaticMemberExpression" and t.label == "." and bool(t.kids) and chain(t.kids[0])


def inline_once(body: list[Tree]) -> list[Tree]:
    """Pure constants used exactly once move to their use, past other pure constants only."""
    body, i = list(body), 0
    while i < len(body):
        found = named(body[i])
        if not (found and found[1] is not None and body[i].label == "ConstDeclaration" and found[0].label.startswith(MARK) and chain(found[1])):
            i += 1
            continue
        name, value = found[0].label, found[1]
        counts = [uses(t, name, False) for t in body[i + 1 :]]
        at = next((k for k, c in enumerate(counts) if c), None)
        between = body[i + 1 : i + 1 + at] if at is not None else []
        simple = all((f := named(t)) and t.label == "ConstDeclaration" and f[1] is not None and chain(f[1]) for t in between)
        if sum(counts) != 1 or not simple:
            i += 1
            continue
        body[i + 1 + at] = replaced(body[i + 1 + at], name, value)
        del body[i]
    return body


def replaced(t: Tree, name: str, value: Tree) -> Tree:
    if t.kind == "Identifier" and t.label == name:
        return value
    return Tree(t.label, t.kind, [replaced(k, name, value) for k in t.kids], t.s, t.e) if t.kids else t


def collected(first: Tree, loop: Tree) -> Tree | None:
    """An empty list filled by a loop that only pushes, as map or filter."""
    got: dict[str, Tree] = {}
    if not (match(first, _EMPTY_LIST, got) and match(loop, _EACH, got)) or got["out"].kind != "BindingIdentifier" or got["x"].kind != "BindingIdentifier":
        return None
    out, x, xs, do = got["out"], got["x"], got["xs"], got["do"]
    if match(do, _push("?v"), got):
        method, value = "map", got["v"]
    elif match(do, (None, "IfStatement", ["?test", (None, "BlockStatement", [_push("$x")])]), got):
        method, value = "filter", got["test"]
    else:
        return None
    if uses(xs, out.label) or uses(value, out.label):
        return None
    give = Tree("BlockStatement", "BlockStatement", [Tree("ReturnStatement", "ReturnStatement", [value])])
    arrow = Tree("ArrowFunction", "ArrowFunctionExpression", [Tree("Parameter", "Parameter", [x]), give])
    call = Tree("CallExpression", "CallExpression", [Tree(".", "StaticMemberExpression", [xs, Tree(method, "Identifier")]), arrow])
    return Tree(first.label, "VariableDeclaration", [Tree("VariableDeclarator", "VariableDeclarator", [out, call])], first.s, loop.e)


_EFFECTS = {"CallExpression", "NewExpression", "AwaitExpression", "YieldExpression", "AssignmentExpression", "UpdateExpression", "TaggedTemplateExpression", "ImportExpression"}


def sort_constants(body: list[Tree]) -> list[Tree]:
    """Runs of constants without effects that do not mention each other, in order of their values' hashes."""

    def value(t: Tree) -> Tree | None:
        found = named(t)
        return found[1] if found and found[1] is not None and t.label == "ConstDeclaration" and not any(x.kind in _EFFECTS for x in found[1].walk()) else None

    out, i = list(body), 0
    while i < len(out):
        j = i
        while j < len(out) and value(out[j]) is not None:
            j += 1
        names = [named(t)[0].label for t in out[i:j]]
        if j - i > 1 and not any(uses(value(t), n) for t in out[i:j] for n in names):
            out[i:j] = sorted(out[i:j], key=lambda t: value(t).key())
        i = max(j, i + 1)
    return out


def direct_return(body: list[Tree]) -> list[Tree]:
    """``const x = v; return x`` as ``return v``."""
    got: dict[str, Tree] = {}
    if len(body) > 1 and match(body[-2], _declaration("?x", "?v"), got) and got["x"].kind == "BindingIdentifier" and match(body[-1], ("ReturnStatement", None, ["$x"]), got):
        return [*body[:-2], Tree("ReturnStatement", "ReturnStatement", [got["v"]], body[-1].s, body[-1].e)]
    return body


def ends(t: Tree) -> bool:
    if t.kind == "BlockStatement":
        return bool(t.kids) and ends(t.kids[-1])
    return t.kind in _JUMPS or t.kind == "IfStatement" and len(t.kids) == 3 and ends(t.kids[1]) and ends(t.kids[2])


def flip_guard(body: list[Tree]) -> list[Tree]:
    """A negative guard before a tail that always leaves, as the positive guard around the tail."""
    positive = {"StrictInequality": "StrictEquality", "Inequality": "Equality"}
    for i, t in enumerate(body[:-1]):
        if t.kind != "IfStatement" or len(t.kids) != 2 or not ends(t.kids[1]) or not ends(body[-1]):
            continue
        test = t.kids[0]
        if test.kind == "BinaryExpression" and test.label in positive:
            test = Tree(positive[test.label], test.kind, test.kids)
        elif test.kind == "UnaryExpression" and test.label == "LogicalNot" and test.kids:
            test = test.kids[0]
        else:
            continue
        tail = Tree("BlockStatement", "BlockStatement", flip_guard(body[i + 1 :]))
        return [*body[:i], Tree("IfStatement", "IfStatement", [test, tail], t.s, t.e), *t.kids[1].kids]
    return body


def peepholes(body: list[Tree]) -> list[Tree]:
    body = inline_once([index_loop(t) for t in body])
    i = 0
    while i + 1 < len(body):
        merged = collected(body[i], body[i + 1])
        if merged is not None:
            body[i : i + 2] = [merged]
        else:
            i += 1
    return flip_guard(direct_return(sort_constants(body)))


_SYMBOLS = {"Identifier", "BindingIdentifier", "FunctionDeclaration", "ClassDeclaration"}


def renumbered(root: Tree) -> Tree:
    """Symbols numbered by their first place in the tree."""
    numbers: dict[str, str] = {}

    def label(t: Tree) -> str:
        at = t.label.find(MARK) if t.kind in _SYMBOLS else -1
        if at < 0:
            return t.label
        return t.label[:at] + numbers.setdefault(t.label[at:], f"{MARK}{len(numbers)}")

    def copy(t: Tree) -> Tree:
        text = label(t)
        return Tree(text, t.kind, [copy(k) for k in t.kids], t.s, t.e)

    return copy(root)


def canonical_tree(program: Node) -> Tree:
    """The canonical tree of a program; renames the program's own nodes."""
    Renamer().program(program)
    sugarless = Desugar().node(program)
    return renumbered(Renderer(canonical=True, statements=peepholes).render(sugarless))


def declared(pattern: Node) -> list[str]:
    return [i.name for i in bound(pattern)]
