"""Recursive-descent parser for TypeScript and JavaScript.

Nodes are plain objects with a type ``t``, a span ``s``..``e`` in characters, and the fields of the ESTree names.
The parser is strict where that is cheap: any syntax error rejects the whole text with ``ParseError``. JSX is
recognised and kept as one opaque node. Type annotations are parsed into nodes of their own (``T...``).
"""

from __future__ import annotations

import re
from typing import Any


class ParseError(ValueError):
    """The text is no valid program."""


class Node:
    """One syntax node."""

    def __init__(self, t: str, s: int, e: int, **fields: Any):
        fields["t"], fields["s"], fields["e"] = t, s, e
        self.__dict__ = fields

    def __getattr__(self, name: str) -> None:  # an absent field is empty
        return None

    def __repr__(self) -> str:
        return f"{self.t}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k not in 'tse')})"


class Token:
    __slots__ = ("k", "v", "s", "e", "nl")

    def __init__(self, k: str, v: Any, s: int, e: int, nl: bool):
        self.k, self.v, self.s, self.e, self.nl = k, v, s, e, nl


_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*")
_BREAK = re.compile("[\n\r\u2028\u2029]")
_KINDS = ("name", "private", "num", "str", "`", "p")
_LEX = re.compile(
    r"""([A-Za-z_$\\ª-\U0010ffff](?:[\w$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)
   |(\#[A-Za-z_$ª-\U0010ffff][\w$]*)
   |(0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)
   |('(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*")
   |(`)
   |(\.\.\.|=>|\?\.(?!\d)|\?\?=|\?\?|&&=|&&|\|\|=|\|\||\*\*=|\*\*|===|!==|==|!=|<<=|<<|<=|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|/=|[-+*/%&|^!~?:;,.(){}\[\]<>=@])""",
    re.X,
)
_REGEX = re.compile(r"/((?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([A-Za-z]*)")
_CHUNK = re.compile(r"((?:[^`\\$]|\\[\s\S]|\$(?!\{))*)(`|\$\{)")
_ESCAPE = re.compile(r"\\(?:u\{([\da-fA-F]+)\}|u([\da-fA-F]{4})|x([\da-fA-F]{2})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}
_RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "get", "set"}


def cooked(raw: str) -> str:
    """The value of string or template text with escapes."""
    if "\\" not in raw:
        return raw

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code else _SIMPLE.get(m[4], m[4])

    return _ESCAPE.sub(one, raw)


class Parser:
    def __init__(self, text: str, jsx: bool = False, typed: bool = True):
        self.text, self.jsx, self.typed = text, jsx, typed
        self.no_in = False
        self.failed: set[tuple[str, int]] = set()  # speculation known to fail
        self.read: dict[int, Token] = {}  # tokens by where reading began: looking ahead and speculation read a place again
        self.prev_end = 0
        start = 1 if text[:1] == "\ufeff" else 0
        if text.startswith("#!", start):
            start = len(text) if (nl := text.find("\n", start)) < 0 else nl
        self.tok = self._lex(start)

    # tokens
    def _lex(self, pos: int) -> Token:
        t = self.read.get(pos)
        if t is None:
            t = self.read[pos] = self._read(pos)
        return t

    def _read(self, pos: int) -> Token:
        at = _SPACE.match(self.text, pos).end()
        nl = pos == 0 or at > pos and _BREAK.search(self.text, pos, at) is not None
        if at >= len(self.text):
            return Token("eof", "", at, at, nl)
        m = _LEX.match(self.text, at)
        if m is None or (m[6] == "/" and self.text.startswith("/*", at)):
            raise ParseError(f"unexpected character at {at}")
        k = _KINDS[m.lastindex - 1]
        v: Any = m[0]
        if k == "num":
            after = self.text[m.end() : m.end() + 1]
            if after.isidentifier() or after == "$" or after.isdigit():
                raise ParseError(f"bad number at {at}")
        elif k == "name" and not v.isascii() and "\\" not in v and not v.replace("$", "_").isidentifier():
            raise ParseError(f"unexpected character at {at}")
        elif k == "str" and "\\" in v and re.search(r"(?<!\\)(?:\\\\)*\\(?:u(?![\da-fA-F]{4}|\{[\da-fA-F]{1,6}\})|x(?![\da-fA-F]{2}))", v):
            raise ParseError(f"bad escape at {at}")
        return Token(k, v, at, m.end(), nl)

    def next(self) -> Token:
        t = self.tok
        self.prev_end = t.e
        self.tok = self._lex(t.e)
        return t

    def peek(self) -> Token:
        return self._lex(self.tok.e)

    def at(self, *values: str) -> bool:
        return self.tok.v in values and self.tok.k in ("p", "name")

    def eat(self, v: str) -> bool:
        if self.tok.v == v and self.tok.k in ("p", "name"):
            self.next()
            return True
        return False

    def need(self, v: str) -> Token:
        if self.tok.v != v or self.tok.k not in ("p", "name"):
            raise ParseError(f"expected {v!r} at {self.tok.s}")
        return self.next()

    def fail(self) -> ParseError:
        return ParseError(f"unexpected {self.tok.v!r} at {self.tok.s}")

    def save(self) -> tuple:
        return self.tok, self.prev_end, self.no_in

    def restore(self, state: tuple) -> None:
        self.tok, self.prev_end, self.no_in = state

    def attempt(self, what: str, parse) -> Any:
        """The result of a speculative parse, or None with the position restored."""
        key, state = (what, self.tok.s), self.save()
        if key in self.failed:
            return None
        try:
            return parse()
        except ParseError:
            self.restore(state)
            self.failed.add(key)
            return None

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.tok.k == "eof" or self.tok.nl):
            raise self.fail()

    def word(self, *values: str) -> bool:
        return self.tok.k == "name" and self.tok.v in values

    def word_then(self, *values: str, line: bool = True) -> bool:
        """A contextual word followed by another word on its line."""
        if not self.word(*values):
            return False
        p = self.peek()
        return p.k == "name" and not (line and p.nl)

    def ident(self) -> Node:
        if self.tok.k != "name" or self.tok.v in _RESERVED:
            raise self.fail()
        t = self.next()
        return Node("Identifier", t.s, t.e, name=t.v)

    # program and statements
    def program(self) -> Node:
        body = []
        while self.tok.k != "eof":
            body.append(self.statement(True))
        return Node("Program", 0, len(self.text), body=body)

    def block(self) -> Node:
        s = self.need("{").s
        body = []
        while not self.at("}"):
            body.append(self.statement())
        self.next()
        return Node("BlockStatement", s, self.prev_end, body=body)

    def statement(self, top: bool = False) -> Node:
        n = self._statement(top)
        if n.e is None or n.e < self.prev_end:
            n.e = self.prev_end
        return n

    def _statement(self, top: bool) -> Node:
        t = self.tok
        s, v = t.s, t.v
        if t.k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                self.next()
                return Node("EmptyStatement", s, t.e)
            if v == "@":
                self.decorators()
                return self.statement(top)
        if t.k == "name":
            handler = getattr(self, "s_" + v, None) if v in _STATEMENTS else None
            if handler:
                n = handler(s)
                if n is not None:
                    return n
            if self.peek().v == ":" and v not in _RESERVED:
                label = self.ident()
                self.next()
                return Node("LabeledStatement", s, 0, label=label.name, body=self.statement())
        e = self.expression()
        self.semicolon()
        return Node("ExpressionStatement", s, self.prev_end, expression=e)

    def decorators(self) -> None:
        while self.at("@"):
            self.next()
            self.unary_base()

    def s_var(self, s: int) -> Node:
        n = self.variables(s)
        self.semicolon()
        return n

    def s_const(self, s: int) -> Node | None:
        if self.peek().v == "enum":
            self.next()
            return self.s_enum(s)
        return self.s_var(s)

    def s_let(self, s: int) -> Node | None:
        p = self.peek()
        if p.v in ("[", "{") or p.k == "name" and p.v not in ("in", "instanceof", "of"):
            return self.s_var(s)
        return None

    def variables(self, s: int, loop: bool = False) -> Node:
        kind = self.next().v
        out = []
        while True:
            a = self.tok.s
            target = self.binding()
            if self.typed and self.at("!"):
                self.next()
            kind_of = self.annotation()
            init = None
            if self.eat("="):
                init = self.assignment()
            elif not loop and (kind == "const" or target.t != "Identifier") and not self.ambient:
                raise self.fail()
            out.append(Node("VariableDeclarator", a, self.prev_end, id=target, type=kind_of, init=init))
            if not self.eat(","):
                break
        return Node("VariableDeclaration", s, self.prev_end, kind=kind, declarations=out)

    ambient = False

    def annotation(self) -> Node | None:
        if self.typed and self.at(":"):
            self.next()
            return self.type()
        return None

    def binding(self) -> Node:
        s = self.tok.s
        if self.eat("["):
            items: list[Node | None] = []
            rest = None
            while not self.at("]"):
                if self.at(","):
                    self.next()
                    items.append(None)
                    continue
                if self.eat("..."):
                    rest = self.binding()
                else:
                    items.append(self.binding_default())
                if not self.at("]"):
                    self.need(",")
            self.next()
            return Node("ArrayPattern", s, self.prev_end, elements=items, rest=rest)
        if self.eat("{"):
            props, rest = [], None
            while not self.at("}"):
                a = self.tok.s
                if self.eat("..."):
                    rest = self.binding()
                else:
                    key, computed = self.property_key()
                    if self.eat(":"):
                        value = self.binding_default()
                        props.append(Node("BindingProperty", a, self.prev_end, key=key, value=value, computed=computed))
                    else:
                        if key.t != "Identifier" or key.name in _RESERVED:
                            raise self.fail()
                        value = Node("Identifier", key.s, key.e, name=key.name)
                        if self.eat("="):
                            value = Node("AssignmentPattern", a, 0, left=value, right=self.assignment())
                        props.append(Node("BindingProperty", a, self.prev_end, key=key, value=value, shorthand=True))
                if not self.at("}"):
                    self.need(",")
            self.next()
            return Node("ObjectPattern", s, self.prev_end, properties=props, rest=rest)
        return self.ident()

    def binding_default(self) -> Node:
        s = self.tok.s
        target = self.binding()
        if self.eat("="):
            return Node("AssignmentPattern", s, self.prev_end, left=target, right=self.assignment())
        return target

    def s_function(self, s: int) -> Node:
        return self.function(s, "FunctionDeclaration")

    def s_async(self, s: int) -> Node | None:
        p = self.peek()
        if p.v == "function" and not p.nl:
            self.next()
            return self.function(s, "FunctionDeclaration", is_async=True)
        return None

    def function(self, s: int, t: str, is_async: bool = False, default: bool = False) -> Node:
        self.need("function")
        generator = self.eat("*")
        name = self.ident() if self.tok.k == "name" and not self.at("(") else None
        if name is None and t == "FunctionDeclaration" and not default:
            raise self.fail()
        n = self.function_rest(s, t)
        n.id, n.is_async, n.generator = name, is_async, generator
        return n

    def function_rest(self, s: int, t: str) -> Node:
        """Type parameters, parameters, result and body; no body for overloads and ambient functions."""
        type_params = self.type_parameters()
        a = self.tok.s
        params, rest = self.parameters()
        b = self.prev_end
        result = self.return_type()
        body = None
        if self.at("{"):
            body = self.function_body()
        elif self.typed and t != "FunctionExpression":
            self.semicolon()
        else:
            raise self.fail()
        return Node(t, s, self.prev_end, params=params, rest=rest, params_span=(a, b), result=result, body=body, type_params=type_params)

    def function_body(self) -> Node:
        state, self.no_in = self.no_in, False
        ambient, self.ambient = self.ambient, False
        body = self.block()
        self.no_in, self.ambient = state, ambient
        return body

    def return_type(self) -> Node | None:
        if not (self.typed and self.at(":")):
            return None
        self.next()
        return self.predicate()

    def predicate(self) -> Node:
        s = self.tok.s
        if self.word_then("asserts") or self.word("asserts") and self.peek().v == "this":
            self.next()
            what = self.next()
            kind = self.type() if self.word("is") and self.next() else None
            return Node("TPredicate", s, self.prev_end, name=what.v, asserts=True, type=kind)
        if self.tok.k == "name" and self.peek().v == "is" and not self.peek().nl:
            what = self.next()
            self.next()
            return Node("TPredicate", s, 0, name=what.v, type=self.type())
        return self.type()

    def parameters(self) -> tuple[list[Node], Node | None]:
        self.need("(")
        state, self.no_in = self.no_in, False
        out, rest = [], None
        while not self.at(")"):
            self.decorators()
            s = self.tok.s
            access = None
            readonly = False
            while self.typed and self.word("public", "private", "protected", "readonly", "override") and (self.peek().k == "name" or self.peek().v in "{["):
                w = self.next().v
                access = w if w in ("public", "private", "protected") else access
                readonly |= w == "readonly"
            if self.eat("..."):
                target = self.binding()
                rest = Node("Parameter", s, 0, pattern=target, type=self.annotation())
                if self.at(","):
                    raise self.fail()
            elif self.typed and self.word("this") and self.peek().v in (":", ",", ")"):
                self.next()
                self.annotation()
            else:
                target = self.binding()
                optional = bool(self.typed and self.eat("?"))
                kind = self.annotation()
                if self.eat("="):
                    init = self.assignment()
                    out.append(Node("Parameter", s, self.prev_end, pattern=target, type=kind, init=init, access=access, readonly=readonly))
                else:
                    out.append(Node("Parameter", s, self.prev_end, pattern=target, type=kind, optional=optional, access=access, readonly=readonly))
            if not self.at(")"):
                self.need(",")
        self.next()
        self.no_in = state
        return out, rest

    def s_class(self, s: int) -> Node:
        n = self.class_(s, "ClassDeclaration")
        if n.id is None:
            raise ParseError(f"class without a name at {s}")
        return n

    def s_abstract(self, s: int) -> Node | None:
        if self.typed and self.peek().v == "class":
            self.next()
            n = self.class_(s, "ClassDeclaration")
            n.abstract = True
            return n
        return None

    def class_(self, s: int, t: str) -> Node:
        self.need("class")
        name = self.ident() if self.tok.k == "name" and not self.at("extends", "implements") else None
        type_params = self.type_parameters()
        base, implements = None, []
        if self.eat("extends"):
            base = self.unary_base()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.eat("implements"):
            while True:
                implements.append(self.type())
                if not self.eat(","):
                    break
        self.need("{")
        body = []
        while not self.at("}"):
            if self.eat(";"):
                continue
            body.append(self.member())
        self.next()
        return Node(t, s, self.prev_end, id=name, base=base, implements=implements, body=body, type_params=type_params)

    def member(self) -> Node:
        self.decorators()
        s = self.tok.s
        mods: set[str] = set()
        generator = False
        while self.tok.k == "name" and self.tok.v in _MODIFIERS and (self.typed or self.tok.v in ("static", "async", "get", "set", "accessor")):
            p = self.peek()
            if p.v in ("(", "=", ";", ":", "?", "!", "}", "<", ",") and p.k == "p" or p.k == "eof" or p.nl and self.tok.v not in ("public", "private", "protected", "static", "readonly", "abstract", "override"):
                break
            if self.tok.v == "static" and p.v == "{":
                self.next()
                return Node("StaticBlock", s, 0, body=self.function_body().body)
            mods.add(self.next().v)
        if self.at("*"):
            self.next()
            generator = True
        if self.typed and self.at("["):
            index = self.attempt("index", lambda: self.index_signature(s))
            if index is not None:
                index.static = "static" in mods
                return index
        key, computed = self.property_key(True)
        optional = bool(self.typed and self.eat("?"))
        if self.typed and self.at("!"):
            self.next()
        if self.at("(", "<"):
            n = self.function_rest(s, "Method")
            kind = "get" if "get" in mods else "set" if "set" in mods else "method"
            if kind == "method" and key.t in ("Identifier", "StringLiteral") and (key.name or key.value) == "constructor" and "static" not in mods and not computed:
                kind = "constructor"
            n.key, n.computed, n.kind, n.optional, n.generator, n.is_async = key, computed, kind, optional, generator, "async" in mods
        else:
            kind = self.annotation()
            value = self.assignment() if self.eat("=") else None
            self.semicolon()
            n = Node("Accessor" if "accessor" in mods else "Property", s, self.prev_end, key=key, computed=computed, type=kind, value=value, optional=optional)
        n.mods, n.static = mods, "static" in mods
        return n

    def index_signature(self, s: int) -> Node:
        self.need("[")
        name = self.ident()
        self.need(":")
        key = self.type()
        self.need("]")
        kind = self.annotation()
        if kind is None:
            raise self.fail()
        if not self.eat(",") and not self.at("}"):
            self.semicolon()
        return Node("IndexSignature", s, self.prev_end, name=name.name, key_type=key, type=kind)

    def property_key(self, private: bool = False) -> tuple[Node, bool]:
        t = self.tok
        if t.k == "name":
            self.next()
            return Node("Identifier", t.s, t.e, name=t.v), False
        if t.k == "str":
            self.next()
            return Node("StringLiteral", t.s, t.e, value=cooked(t.v[1:-1])), False
        if t.k == "num":
            self.next()
            return self.number(t), False
        if t.k == "private" and private:
            self.next()
            return Node("PrivateIdentifier", t.s, t.e, name=t.v[1:]), False
        if self.eat("["):
            state, self.no_in = self.no_in, False
            e = self.assignment()
            self.no_in = state
            self.need("]")
            return e, True
        raise self.fail()

    def s_if(self, s: int) -> Node:
        self.next()
        test = self.parens()
        then = self.statement()
        other = self.statement() if self.eat("else") else None
        return Node("IfStatement", s, self.prev_end, test=test, consequent=then, alternate=other)

    def parens(self) -> Node:
        self.need("(")
        state, self.no_in = self.no_in, False
        e = self.expression()
        self.no_in = state
        self.need(")")
        return e

    def s_for(self, s: int) -> Node:
        self.next()
        is_await = self.eat("await")
        self.need("(")
        init = None
        state = self.no_in
        if not self.at(";"):
            self.no_in = True
            a = self.tok.s
            if self.at("var", "const") or self.word("let") and (self.peek().k == "name" and self.peek().v not in ("in", "of") or self.peek().v in ("[", "{")):
                init = self.variables(a, loop=True)
            else:
                init = self.expression()
            self.no_in = False
            if self.word("of") or self.at("in"):
                kind = self.next().v
                right = self.assignment() if kind == "of" else self.expression()
                self.need(")")
                self.no_in = state
                return Node("ForOfStatement" if kind == "of" else "ForInStatement", s, 0, left=init, right=right, is_await=is_await, body=self.statement())
        self.no_in = False
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        self.no_in = state
        return Node("ForStatement", s, 0, init=init, test=test, update=update, body=self.statement())

    def s_while(self, s: int) -> Node:
        self.next()
        return Node("WhileStatement", s, 0, test=self.parens(), body=self.statement())

    def s_do(self, s: int) -> Node:
        self.next()
        body = self.statement()
        self.need("while")
        test = self.parens()
        self.eat(";")
        return Node("DoWhileStatement", s, self.prev_end, test=test, body=body)

    def s_switch(self, s: int) -> Node:
        self.next()
        subject = self.parens()
        self.need("{")
        cases = []
        while not self.at("}"):
            a = self.tok.s
            if self.eat("default"):
                test = None
            else:
                self.need("case")
                test = self.expression()
            self.need(":")
            body = []
            while not self.at("}", "case", "default"):
                body.append(self.statement())
            cases.append(Node("SwitchCase", a, self.prev_end, test=test, consequent=body))
        self.next()
        return Node("SwitchStatement", s, self.prev_end, discriminant=subject, cases=cases)

    def s_try(self, s: int) -> Node:
        self.next()
        body = self.block()
        handler = final = None
        if self.eat("catch"):
            param = None
            if self.eat("("):
                param = self.binding()
                self.annotation()
                self.need(")")
            handler = Node("CatchClause", s, 0, param=param, body=self.block())
        if self.eat("finally"):
            final = self.block()
        if handler is None and final is None:
            raise self.fail()
        return Node("TryStatement", s, self.prev_end, block=body, handler=handler, finalizer=final)

    def s_return(self, s: int) -> Node:
        self.next()
        arg = None if self.at(";", "}") or self.tok.nl or self.tok.k == "eof" else self.expression()
        self.semicolon()
        return Node("ReturnStatement", s, self.prev_end, argument=arg)

    def s_throw(self, s: int) -> Node:
        self.next()
        if self.tok.nl:
            raise self.fail()
        arg = self.expression()
        self.semicolon()
        return Node("ThrowStatement", s, self.prev_end, argument=arg)

    def s_break(self, s: int) -> Node:
        t = "BreakStatement" if self.next().v == "break" else "ContinueStatement"
        label = self.ident().name if self.tok.k == "name" and not self.tok.nl and self.tok.v not in _RESERVED else None
        self.semicolon()
        return Node(t, s, self.prev_end, label=label)

    s_continue = s_break

    def s_debugger(self, s: int) -> Node:
        self.next()
        self.semicolon()
        return Node("DebuggerStatement", s, self.prev_end)

    def s_with(self, s: int) -> Node:
        self.next()
        return Node("WithStatement", s, 0, object=self.parens(), body=self.statement())

    def s_import(self, s: int) -> Node | None:
        if self.peek().v in ("(", "."):
            return None
        self.next()
        if self.tok.k == "str":
            self.next()
        else:
            if self.typed and self.word("type") and self.peek().v not in (",", "from", "="):
                self.next()
            if self.tok.k == "name":
                self.ident()
                if self.typed and self.eat("="):
                    self.expression()
                    self.semicolon()
                    return Node("ImportDeclaration", s, self.prev_end)
                if not self.at("from"):
                    self.need(",")
            if self.eat("*"):
                self.need("as")
                self.ident()
            elif self.at("{"):
                self.names()
            self.need("from")
            self.string()
        self.attributes()
        self.semicolon()
        return Node("ImportDeclaration", s, self.prev_end)

    def attributes(self) -> None:
        if self.word("with", "assert") and self.peek().v == "{" and not self.tok.nl:
            self.next()
            self.primary()

    def names(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.k not in ("name", "str"):
                raise self.fail()
            if self.typed and self.word("type") and self.peek().v not in (",", "}", "as"):
                self.next()
            self.next()
            if self.eat("as"):
                if self.tok.k not in ("name", "str"):
                    raise self.fail()
                self.next()
            if not self.at("}"):
                self.need(",")
        self.next()

    def string(self) -> Node:
        if self.tok.k != "str":
            raise self.fail()
        t = self.next()
        return Node("StringLiteral", t.s, t.e, value=cooked(t.v[1:-1]))

    def s_export(self, s: int) -> Node:
        self.next()
        if self.eat("default"):
            a = self.tok.s
            if self.at("function"):
                d = self.function(a, "FunctionDeclaration", default=True)
            elif self.word("async") and self.peek().v == "function" and not self.peek().nl:
                self.next()
                d = self.function(a, "FunctionDeclaration", is_async=True, default=True)
            elif self.at("class", "@"):
                self.decorators()
                d = self.class_(a, "ClassDeclaration")
            elif self.typed and self.word("abstract") and self.peek().v == "class":
                self.next()
                d = self.class_(a, "ClassDeclaration")
                d.abstract = True
            elif self.typed and self.word("interface"):
                d = self.s_interface(a)
            else:
                d = self.assignment()
                self.semicolon()
            return Node("ExportDefaultDeclaration", s, self.prev_end, declaration=d)
        if self.eat("*"):
            if self.eat("as"):
                self.next()
            self.need("from")
            self.string()
            self.attributes()
            self.semicolon()
            return Node("ExportAllDeclaration", s, self.prev_end)
        if self.typed and self.eat("="):
            e = self.expression()
            self.semicolon()
            return Node("ExportAssignment", s, self.prev_end, expression=e)
        if self.typed and self.word("type") and self.peek().v in ("{", "*"):
            self.next()
            if self.eat("*"):
                if self.eat("as"):
                    self.next()
                self.need("from")
                self.string()
                self.semicolon()
                return Node("ExportAllDeclaration", s, self.prev_end)
        if self.at("{"):
            self.names()
            if self.eat("from"):
                self.string()
                self.attributes()
            self.semicolon()
            return Node("ExportNamedDeclaration", s, self.prev_end)
        self.decorators()
        if not (self.at("var", "const", "class", "function") or self.word("let", "async", "abstract", "interface", "type", "enum", "namespace", "module", "declare", "import", "global")):
            raise self.fail()
        d = self.statement()
        if d.t == "ExpressionStatement":
            raise self.fail()
        return Node("ExportNamedDeclaration", s, self.prev_end, declaration=d)

    def s_interface(self, s: int) -> Node | None:
        if not self.typed or not (self.peek().k == "name" and not self.peek().nl):
            return None
        self.next()
        name = self.ident()
        params = self.type_parameters()
        bases = []
        if self.eat("extends"):
            while True:
                bases.append(self.type())
                if not self.eat(","):
                    break
        members = self.type_members()
        return Node("InterfaceDeclaration", s, self.prev_end, id=name, type_params=params, bases=bases, members=members)

    def s_type(self, s: int) -> Node | None:
        if not self.typed or not self.word_then("type"):
            return None
        state = self.save()
        self.next()
        if self.tok.v in _RESERVED or self.peek().v not in ("=", "<"):
            self.restore(state)
            return None
        name = self.ident()
        params = self.type_parameters()
        self.need("=")
        kind = self.type()
        self.semicolon()
        return Node("TypeAlias", s, self.prev_end, id=name, type_params=params, type=kind)

    def s_enum(self, s: int) -> Node | None:
        if not self.typed:
            return None
        self.need("enum")
        name = self.ident()
        self.need("{")
        while not self.at("}"):
            self.property_key()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")
        self.next()
        return Node("EnumDeclaration", s, self.prev_end, id=name)

    def s_namespace(self, s: int) -> Node | None:
        p = self.peek()
        if not self.typed or p.nl or not (p.k == "name" or p.k == "str" and self.word("module")):
            return None
        self.next()
        if self.tok.k == "str":
            self.next()
        else:
            self.ident()
            while self.eat("."):
                self.ident()
        if self.at("{"):
            self.block()
        else:
            self.semicolon()
        return Node("ModuleDeclaration", s, self.prev_end)

    s_module = s_namespace

    def s_global(self, s: int) -> Node | None:
        if not self.typed or self.peek().v != "{":
            return None
        self.next()
        self.block()
        return Node("ModuleDeclaration", s, self.prev_end)

    def s_declare(self, s: int) -> Node | None:
        if not self.typed or not self.word_then("declare"):
            return None
        self.next()
        state, self.ambient = self.ambient, True
        d = self.statement()
        self.ambient = state
        return Node("DeclareStatement", s, self.prev_end, declaration=d)

    # expressions
    def expression(self) -> Node:
        e = self.assignment()
        if self.at(","):
            items = [e]
            while self.eat(","):
                items.append(self.assignment())
            return Node("SequenceExpression", e.s, self.prev_end, expressions=items)
        return e

    def arrow_ahead(self) -> Node | None:
        t = self.tok
        if t.k == "name":
            p = self.peek()
            if p.v == "=>" and p.k == "p" and not p.nl and t.v not in _RESERVED:
                name = self.ident()
                return self.arrow(t.s, [Node("Parameter", name.s, name.e, pattern=name)], None, (name.s, name.e), None, False)
            if t.v == "async" and not p.nl:
                if p.k == "name" and p.v not in _RESERVED:
                    def simple() -> Node:
                        self.next()
                        name = self.ident()
                        if not self.at("=>"):
                            raise self.fail()
                        return self.arrow(t.s, [Node("Parameter", name.s, name.e, pattern=name)], None, (name.s, name.e), None, True)

                    return self.attempt("async", simple)
                if p.v in ("(", "<"):
                    return self.attempt("async", lambda: (self.next(), self.arrow_head(t.s, True))[1])
            return None
        if t.v == "(" or t.v == "<" and self.typed:
            if t.v == "(":
                p = self.peek()
                if p.k in ("str", "num", "`"):
                    return None
            return self.attempt("arrow", lambda: self.arrow_head(t.s, False))
        return None

    def arrow_head(self, s: int, is_async: bool) -> Node:
        if self.at("<"):
            if self.jsx and not re.match(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)", self.text[self.tok.s :]):
                raise self.fail()
            self.type_parameters()
        a = self.tok.s
        params, rest = self.parameters()
        b = self.prev_end
        result = self.return_type()
        if not self.at("=>") or self.tok.nl:
            raise self.fail()
        return self.arrow(s, params, rest, (a, b), result, is_async)

    def arrow(self, s: int, params: list, rest: Node | None, span: tuple, result: Node | None, is_async: bool) -> Node:
        self.need("=>")
        if self.at("{"):
            body, plain = self.function_body(), False
        else:
            body, plain = self.assignment(), True
        return Node("ArrowFunctionExpression", s, self.prev_end, params=params, rest=rest, params_span=span, result=result, body=body, plain=plain, is_async=is_async)

    def assignment(self) -> Node:
        t = self.tok
        if t.k == "name" and t.v == "yield" and self.peek().v not in ("=", ".", ":", "=>"):
            return self.yield_()
        arrow = self.arrow_ahead()
        if arrow is not None:
            return arrow
        left = self.conditional()
        if self.tok.k == "p":
            op = self.big_operator()
            if op in _ASSIGN:
                if left.t not in ("Identifier", "Member", "Index", "PrivateMember", "ArrayExpression", "ObjectExpression", "As", "NonNull", "Paren") or op != "=" and left.t in ("ArrayExpression", "ObjectExpression"):
                    raise self.fail()
                self.advance(op)
                return Node("AssignmentExpression", left.s, 0, operator=op, left=left, right=self.assignment())
        return left

    def yield_(self) -> Node:
        s = self.next().s
        if self.tok.nl or self.at(")", "]", "}", ",", ";", ":") or self.tok.k == "eof":
            return Node("YieldExpression", s, self.prev_end)
        star = self.eat("*")
        return Node("YieldExpression", s, 0, delegate=star, argument=self.assignment())

    def big_operator(self) -> str:
        """The operator at the cursor; ``>`` is lexed alone for the sake of types and joined here."""
        if self.tok.v != ">":
            return self.tok.v
        for op in (">>>=", ">>=", ">>>", ">>", ">="):
            if self.text.startswith(op, self.tok.s):
                return op
        return ">"

    def advance(self, op: str) -> None:
        if self.tok.v == ">" and len(op) > 1:
            self.tok = Token("p", op, self.tok.s, self.tok.s + len(op), self.tok.nl)
        self.next()

    def conditional(self) -> Node:
        test = self.binary(0)
        if self.at("?"):
            self.next()
            state, self.no_in = self.no_in, False
            then = self.assignment()
            self.no_in = state
            self.need(":")
            return Node("ConditionalExpression", test.s, 0, test=test, consequent=then, alternate=self.assignment())
        return test

    def binary(self, level: int) -> Node:
        left = self.unary()
        while True:
            t = self.tok
            if self.typed and t.k == "name" and t.v in ("as", "satisfies") and not t.nl and level < 8:
                self.next()
                if self.at("const"):
                    self.next()
                    kind = None
                else:
                    kind = self.type()
                left = Node("As", left.s, self.prev_end, expression=left, type=kind)
                continue
            op = self.big_operator() if t.k == "p" else t.v if t.k == "name" and t.v in ("in", "instanceof") else ""
            power = _BINARY.get(op, 0)
            if power <= level or op == "in" and self.no_in:
                return left
            self.advance(op)
            right = self.binary(power - 1 if op == "**" else power)
            kind = "LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression"
            left = Node(kind, left.s, self.prev_end, operator=op, left=left, right=right)

    def unary(self) -> Node:
        t = self.tok
        if t.k == "p":
            if t.v in ("!", "~", "+", "-"):
                self.next()
                return Node("UnaryExpression", t.s, 0, operator=t.v, argument=self.unary())
            if t.v in ("++", "--"):
                self.next()
                return Node("UpdateExpression", t.s, 0, operator=t.v, prefix=True, argument=self.unary())
            if t.v == "<" and self.typed and not self.jsx:
                self.next()
                if not self.eat("const"):
                    self.type()
                self.close_angle()
                return Node("As", t.s, 0, expression=self.unary())
        elif t.k == "name":
            if t.v in ("typeof", "void", "delete"):
                self.next()
                return Node("UnaryExpression", t.s, 0, operator=t.v, argument=self.unary())
            if t.v == "await":
                p = self.peek()
                if not (p.k == "p" and p.v in (")", "]", "}", ",", ";", ":", "=", ".", "=>", "?", "==", "===")) and p.k != "eof":
                    self.next()
                    return Node("AwaitExpression", t.s, 0, argument=self.unary())
        e = self.unary_base()
        if self.at("++", "--") and not self.tok.nl:
            if e.t not in ("Identifier", "Member", "Index", "PrivateMember", "NonNull", "As", "Paren"):
                raise self.fail()
            op = self.next().v
            return Node("UpdateExpression", e.s, self.prev_end, operator=op, prefix=False, argument=e)
        return e

    def unary_base(self) -> Node:
        s = self.tok.s
        if self.at("new"):
            e = self.new()
        else:
            e = self.primary()
        return self.suffixes(e, s, True)

    def suffixes(self, e: Node, s: int, calls: bool) -> Node:
        chained = False
        while True:
            t = self.tok
            if t.k == "`":
                e = Node("TaggedTemplate", s, 0, tag=e, quasi=self.template())
                continue
            if t.k != "p":
                break
            if t.v == ".":
                self.next()
                e = self.member_name(e, s, False)
            elif t.v == "?.":
                if not calls:
                    raise self.fail()
                self.next()
                chained = True
                if self.at("("):
                    e = Node("CallExpression", s, 0, callee=e, arguments=self.arguments(), optional=True)
                elif self.at("["):
                    e = self.index(e, s, True)
                elif self.typed and self.at("<"):
                    self.type_arguments()
                    e = Node("CallExpression", s, 0, callee=e, arguments=self.arguments(), optional=True)
                else:
                    e = self.member_name(e, s, True)
            elif t.v == "[":
                e = self.index(e, s, False)
            elif t.v == "(" and calls:
                e = Node("CallExpression", s, 0, callee=e, arguments=self.arguments())
            elif t.v == "!" and self.typed and not t.nl:
                self.next()
                e = Node("NonNull", s, self.prev_end, expression=e)
            elif t.v == "<" and self.typed:
                def instance() -> bool:
                    self.type_arguments()
                    if not (self.at("(", ")", "]", ";", ",", ".", "?.", ":", "}", "=", "===", "!==", "==", "&&", "||", "?", "??") or self.tok.k in ("`", "eof") or self.tok.nl):
                        raise self.fail()
                    return True

                if not self.attempt("instance", instance):
                    break
            else:
                break
            e.e = self.prev_end
        return Node("ChainExpression", s, self.prev_end, expression=e) if chained else e

    def member_name(self, e: Node, s: int, optional: bool) -> Node:
        t = self.tok
        if t.k not in ("name", "private"):
            raise self.fail()
        self.next()
        if t.k == "private":
            return Node("PrivateMember", s, t.e, object=e, property=t.v[1:], optional=optional)
        return Node("Member", s, t.e, object=e, property=t.v, optional=optional)

    def index(self, e: Node, s: int, optional: bool) -> Node:
        self.need("[")
        state, self.no_in = self.no_in, False
        i = self.expression()
        self.no_in = state
        self.need("]")
        return Node("Index", s, self.prev_end, object=e, index=i, optional=optional)

    def arguments(self) -> list[Node]:
        self.need("(")
        state, self.no_in = self.no_in, False
        out = []
        while not self.at(")"):
            out.append(self.spread() if self.at("...") else self.assignment())
            if not self.at(")"):
                self.need(",")
        self.next()
        self.no_in = state
        return out

    def spread(self) -> Node:
        s = self.need("...").s
        return Node("SpreadElement", s, 0, argument=self.assignment())

    def new(self) -> Node:
        s = self.need("new").s
        if self.eat("."):
            name = self.ident()
            return Node("MetaProperty", s, self.prev_end, name=f"new.{name.name}")
        a = self.tok.s
        callee = self.new() if self.at("new") else self.suffixes(self.primary(), a, False)
        args = self.arguments() if self.at("(") else []
        return Node("NewExpression", s, self.prev_end, callee=callee, arguments=args)

    def number(self, t: Token) -> Node:
        raw = t.v.replace("_", "")
        if raw.endswith("n"):
            return Node("BigIntLiteral", t.s, t.e, value=raw[:-1])
        low = raw.lower()
        value = float(int(low, 0)) if low[:2] in ("0x", "0b", "0o") else float(low)
        return Node("NumericLiteral", t.s, t.e, value=value)

    def primary(self) -> Node:
        t = self.tok
        if t.k == "name":
            v = t.v
            if v == "function":
                return self.function(t.s, "FunctionExpression")
            if v == "async" and self.peek().v == "function" and not self.peek().nl:
                self.next()
                return self.function(t.s, "FunctionExpression", is_async=True)
            if v == "class":
                return self.class_(t.s, "ClassExpression")
            if v == "this":
                self.next()
                return Node("ThisExpression", t.s, t.e)
            if v == "super":
                self.next()
                return Node("Super", t.s, t.e)
            if v == "null":
                self.next()
                return Node("NullLiteral", t.s, t.e)
            if v in ("true", "false"):
                self.next()
                return Node("BooleanLiteral", t.s, t.e, value=v == "true")
            if v == "import":
                self.next()
                if self.eat("."):
                    name = self.next()
                    return Node("MetaProperty", t.s, self.prev_end, name=f"import.{name.v}")
                args = self.arguments()
                if not args:
                    raise self.fail()
                return Node("ImportExpression", t.s, self.prev_end, source=args[0])
            return self.ident()
        if t.k == "num":
            self.next()
            return self.number(t)
        if t.k == "str":
            return self.string()
        if t.k == "`":
            return self.template()
        if t.k == "private" and self.peek().v == "in":
            self.next()
            return Node("PrivateIdentifier", t.s, t.e, name=t.v[1:])
        if t.k == "p":
            if t.v == "(":
                e = self.parens()
                return Node("Paren", t.s, self.prev_end, expression=e)
            if t.v == "[":
                return self.array()
            if t.v == "{":
                return self.object()
            if t.v in ("/", "/="):
                m = _REGEX.match(self.text, t.s)
                if m is None or len(set(m[2])) != len(m[2]) or not set(m[2]) <= set("dgimsuvy"):
                    raise self.fail()
                self.tok = Token("regex", m[0], t.s, m.end(), t.nl)
                self.next()
                return Node("RegExpLiteral", t.s, m.end(), pattern=m[1], flags=m[2])
            if t.v == "@":
                self.decorators()
                return self.primary()
            if t.v == "<" and self.jsx:
                end = self.jsx_element(t.s)
                self.tok = Token("jsx", "", t.s, end, t.nl)
                self.next()
                return Node("JSXElement", t.s, end)
        raise self.fail()

    def array(self) -> Node:
        s = self.need("[").s
        state, self.no_in = self.no_in, False
        out: list[Node | None] = []
        while not self.at("]"):
            if self.at(","):
                self.next()
                out.append(None)
                continue
            out.append(self.spread() if self.at("...") else self.assignment())
            if not self.at("]"):
                self.need(",")
        self.next()
        self.no_in = state
        return Node("ArrayExpression", s, self.prev_end, elements=out)

    def object(self) -> Node:
        s = self.need("{").s
        state, self.no_in = self.no_in, False
        props = []
        while not self.at("}"):
            a = self.tok.s
            if self.at("..."):
                props.append(self.spread())
            else:
                mods = set()
                while self.word("get", "set", "async") and self.peek().v not in (",", ":", "(", "}", "=", "<"):
                    mods.add(self.next().v)
                star = self.eat("*")
                key, computed = self.property_key()
                if self.at("(", "<"):
                    f = self.function_rest(a, "FunctionExpression")
                    f.is_async, f.generator = "async" in mods, star
                    props.append(Node("ObjectProperty", a, self.prev_end, key=key, value=f, computed=computed, method=True))
                elif mods or star:
                    raise self.fail()
                elif self.eat(":"):
                    props.append(Node("ObjectProperty", a, 0, key=key, value=self.assignment(), computed=computed))
                else:
                    if key.t != "Identifier" or computed or key.name in _RESERVED:
                        raise self.fail()
                    value = Node("Identifier", key.s, key.e, name=key.name)
                    if self.eat("="):  # only valid if the object turns out to be a pattern
                        value = Node("AssignmentPattern", a, 0, left=value, right=self.assignment())
                    props.append(Node("ObjectProperty", a, self.prev_end, key=key, value=value, shorthand=True))
            if not self.at("}"):
                self.need(",")
        self.next()
        self.no_in = state
        return Node("ObjectExpression", s, self.prev_end, properties=props)

    def template(self) -> Node:
        s = self.tok.s
        quasis, exprs, at = [], [], self.tok.e
        while True:
            m = _CHUNK.match(self.text, at)
            if m is None:
                raise ParseError(f"unterminated template at {s}")
            quasis.append(cooked(m[1].replace("\r\n", "\n")))
            if m[2] == "`":
                self.tok = Token("tmpl", "", s, m.end(), self.tok.nl)
                self.next()
                return Node("TemplateLiteral", s, m.end(), quasis=quasis, expressions=exprs)
            self.tok = self._lex(m.end())
            state, self.no_in = self.no_in, False
            exprs.append(self.expression())
            self.no_in = state
            if not self.at("}"):
                raise self.fail()
            at = self.tok.e

    def jsx_element(self, pos: int) -> int:
        """End of the element that begins at ``pos``."""
        m = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?\s*").match(self.text, pos)
        name, at = m[1] or "", m.end()
        if self.text.startswith("<", at) and self.typed:
            self.tok = self._lex(at)
            self.type_arguments()
            at = self.prev_end
        while True:
            m = re.compile(r"\s*").match(self.text, at)
            at = m.end()
            if self.text.startswith("/>", at):
                return at + 2
            if self.text.startswith(">", at):
                at += 1
                break
            if self.text.startswith("{", at):
                at = self.jsx_hole(at)
                continue
            m = re.compile(r"[A-Za-z_$][\w$:-]*\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{<])))?").match(self.text, at)
            if m is None:
                raise ParseError(f"bad markup at {at}")
            at = m.end()
            if m[0].rstrip().endswith("="):
                at = self.jsx_hole(at) if self.text.startswith("{", at) else self.jsx_element(at)
        while True:
            m = re.compile(r"[^<{>}]*").match(self.text, at)
            at = m.end()
            c = self.text[at : at + 1]
            if c == "{":
                at = self.jsx_hole(at)
            elif c == "<":
                m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(self.text, at)
                if m:
                    if (m[1] or "") != name:
                        raise ParseError(f"unbalanced markup at {at}")
                    return m.end()
                at = self.jsx_element(at)
            else:
                raise ParseError(f"bad markup at {at}")

    def jsx_hole(self, at: int) -> int:
        self.tok = self._lex(at)
        self.need("{")
        if self.at("..."):
            self.next()
        if not self.at("}"):
            self.expression()
        if not self.at("}"):
            raise self.fail()
        return self.tok.e

    # types
    def close_angle(self) -> None:
        if not self.at(">"):
            raise self.fail()
        self.next()

    def type_parameters(self) -> list[str]:
        if not (self.typed and self.at("<")):
            return []
        self.next()
        out = []
        while not self.at(">"):
            while self.word("const", "in", "out") and self.peek().k == "name" and self.peek().v != "extends":
                self.next()
            out.append(self.ident().name)
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.at(">"):
                self.need(",")
        if not out:
            raise self.fail()
        self.close_angle()
        return out

    def type_arguments(self) -> list[Node]:
        self.need("<")
        out = [self.type()]
        while self.eat(","):
            out.append(self.type())
        self.close_angle()
        return out

    def type(self) -> Node:
        s = self.tok.s
        if self.at("<"):
            return self.function_type(s)
        if self.at("(") and (f := self.attempt("fntype", lambda: self.function_type(s))) is not None:
            return f
        if self.at("new") or self.word("abstract") and self.peek().v == "new":
            self.eat("abstract")
            self.need("new")
            f = self.function_type(s)
            f.t = "TConstructor"
            return f
        t = self.union()
        if self.at("extends") and not self.tok.nl and not self.in_infer:
            self.next()
            state, self.in_infer = self.in_infer, True
            check = self.union()
            self.in_infer = state
            self.need("?")
            a = self.type()
            self.need(":")
            b = self.type()
            return Node("TConditional", s, self.prev_end, check=t, extends=check, yes=a, no=b)
        return t

    in_infer = False

    def function_type(self, s: int) -> Node:
        params = self.type_parameters()
        a = self.tok.s
        items, rest = self.parameters()
        b = self.prev_end
        if not self.at("=>"):
            raise self.fail()
        self.next()
        return Node("TFunction", s, 0, params=items, rest=rest, params_span=(a, b), result=self.predicate(), type_params=params)

    def union(self) -> Node:
        s = self.tok.s
        self.eat("|")
        items = [self.intersection()]
        while self.at("|"):
            self.next()
            items.append(self.intersection())
        return items[0] if len(items) == 1 else Node("TUnion", s, self.prev_end, types=items)

    def intersection(self) -> Node:
        s = self.tok.s
        self.eat("&")
        items = [self.type_operator()]
        while self.at("&"):
            self.next()
            items.append(self.type_operator())
        return items[0] if len(items) == 1 else Node("TIntersection", s, self.prev_end, types=items)

    def type_operator(self) -> Node:
        t = self.tok
        if t.k == "name" and t.v in ("keyof", "unique", "readonly") and self.peek().v not in (",", ")", ">", ";", "]", "|", "&", "=", "}", ".", "<"):
            self.next()
            return Node("TOperator", t.s, 0, operator=t.v, type=self.type_operator())
        if self.word_then("infer"):
            self.next()
            name = self.ident()
            if self.at("extends"):
                state = self.save()
                self.next()
                self.union()
                if self.at("?"):
                    self.restore(state)
            return Node("TInfer", t.s, self.prev_end, name=name.name)
        return self.postfix_type()

    def postfix_type(self) -> Node:
        s = self.tok.s
        t = self.primary_type()
        while self.at("[") and not self.tok.nl:
            self.next()
            if self.eat("]"):
                t = Node("TArray", s, self.prev_end, element=t)
            else:
                i = self.type()
                self.need("]")
                t = Node("TIndexed", s, self.prev_end, object=t, index=i)
        return t

    def primary_type(self) -> Node:
        t = self.tok
        s = t.s
        if t.k == "name":
            if t.v == "typeof":
                self.next()
                if self.at("import"):
                    return self.primary_type()
                name = self.dotted()
                args = self.type_arguments() if self.at("<") and not self.tok.nl else []
                return Node("TTypeof", s, self.prev_end, name=name, args=args)
            if t.v == "import":
                self.next()
                self.need("(")
                self.type()
                self.need(")")
                while self.eat("."):
                    self.next()
                if self.at("<"):
                    self.type_arguments()
                return Node("TImport", s, self.prev_end)
            if t.v in ("true", "false", "null", "this", "void"):
                self.next()
                return Node("TKeyword", s, t.e, name=t.v)
            name = self.dotted()
            args = self.type_arguments() if self.at("<") and not self.tok.nl else []
            return Node("TReference", s, self.prev_end, name=name, args=args)
        if t.k in ("str", "num"):
            self.next()
            return Node("TLiteral", s, t.e, raw=t.v, value=cooked(t.v[1:-1]) if t.k == "str" else t.v, string=t.k == "str")
        if t.k == "`":
            return self.template_type()
        if t.v == "-" and self.peek().k == "num":
            self.next()
            n = self.next()
            return Node("TLiteral", s, n.e, raw="-" + n.v, value="-" + n.v)
        if t.v == "{":
            mapped = self.attempt("mapped", self.mapped_type)
            return mapped if mapped is not None else Node("TObject", s, 0, members=self.type_members())
        if self.eat("["):
            items = []
            while not self.at("]"):
                rest = self.eat("...")
                name = None
                if self.tok.k == "name" and (self.peek().v == ":" or self.peek().v == "?" and self.text[self.peek().e : self.peek().e + 1] == ":"):
                    name = self.next().v
                    self.eat("?")
                    self.need(":")
                kind = self.type()
                optional = self.eat("?")
                items.append(Node("TElement", kind.s, self.prev_end, type=kind, rest=rest, name=name, optional=optional))
                if not self.at("]"):
                    self.need(",")
            self.next()
            return Node("TTuple", s, self.prev_end, elements=items)
        if self.eat("("):
            state, self.in_infer = self.in_infer, False
            inner = self.type()
            self.in_infer = state
            self.need(")")
            return Node("TParen", s, self.prev_end, type=inner)
        if t.v == "<":
            return self.function_type(s)
        raise self.fail()

    def dotted(self) -> str:
        parts = [self.next().v]
        while self.at("."):
            self.next()
            if self.tok.k not in ("name", "private"):
                raise self.fail()
            parts.append(self.next().v)
        return ".".join(parts)

    def template_type(self) -> Node:
        s, at = self.tok.s, self.tok.e
        while True:
            m = _CHUNK.match(self.text, at)
            if m is None:
                raise ParseError(f"unterminated template at {s}")
            if m[2] == "`":
                self.tok = Token("tmpl", "", s, m.end(), self.tok.nl)
                self.next()
                return Node("TTemplate", s, m.end())
            self.tok = self._lex(m.end())
            self.type()
            if not self.at("}"):
                raise self.fail()
            at = self.tok.e

    def mapped_type(self) -> Node:
        s = self.need("{").s
        if self.at("+", "-"):
            self.next()
        self.eat("readonly")
        self.need("[")
        self.ident()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.at("+", "-"):
            self.next()
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";") or self.eat(",")
        self.need("}")
        return Node("TMapped", s, self.prev_end)

    def type_members(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.at("}"):
            out.append(self.type_member())
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.tok.nl or self.text[self.prev_end - 1] in ";,"):
                raise self.fail()
        self.next()
        return out

    def type_member(self) -> Node:
        s = self.tok.s
        if self.at("(", "<"):
            return self.signature(s, "TCall")
        if self.at("new") and self.peek().v in ("(", "<"):
            self.next()
            return self.signature(s, "TConstruct")
        readonly = False
        if self.word("readonly") and (self.peek().k in ("name", "str", "num") or self.peek().v == "["):
            self.next()
            readonly = True
        accessor = ""
        if self.word("get", "set") and (self.peek().k in ("name", "str", "num") or self.peek().v == "["):
            accessor = self.next().v
        if self.at("["):
            index = self.attempt("index", lambda: self.index_signature(s))
            if index is not None:
                index.readonly = readonly
                return index
        key, computed = self.property_key(True)
        optional = self.eat("?")
        if self.at("(", "<"):
            n = self.signature(s, "TMethod")
            n.key, n.computed, n.optional, n.accessor = key, computed, optional, accessor
            return n
        return Node("TProperty", s, 0, key=key, computed=computed, optional=optional, readonly=readonly, type=self.annotation())

    def signature(self, s: int, t: str) -> Node:
        params = self.type_parameters()
        a = self.tok.s
        items, rest = self.parameters()
        b = self.prev_end
        return Node(t, s, self.prev_end, params=items, rest=rest, params_span=(a, b), result=self.return_type(), type_params=params)


_STATEMENTS = {n[2:] for n in dir(Parser) if n.startswith("s_")}


def parse(text: str, path: str = "x.ts") -> Node:
    """The program of a text; the path's extension decides about types and JSX."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else "ts"
    p = Parser(text, jsx=ext in ("tsx", "jsx", "js"), typed=ext not in ("js", "jsx", "mjs", "cjs"))
    try:
        return p.program()
    except RecursionError as e:
        raise ParseError("too deeply nested") from e
