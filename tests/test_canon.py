"""Canonical forms: what must become one tree and what must not."""

import pytest

from twinscan.ts.canon import canonical_tree
from twinscan.ts.parse import ParseError, parse


def canon(body: str, params: str = "xs, a, b"):
    return canonical_tree(parse(f"async function f({params}) {{ {body} }}"))


SAME = {
    "names": ("const total = a + b; return use(total, a);", "const sum = a + b; return use(sum, a);"),
    "await in return": ("return await a.load();", "return a.load();"),
    "then to await": ("return a.load().then((r) => r.id);", "const r = await a.load(); return r.id;"),
    "then statement": ("a.load().then((r) => { use(r); });", "const r = await a.load(); use(r);"),
    "return ternary": ("return a ? b : xs;", "if (a) { return b; } return xs;"),
    "negated ternary": ("return !a ? b : xs;", "if (a) { return xs; } return b;"),
    "assign ternary": ("a.x = b ? 1 : 2;", "if (b) { a.x = 1; } else { a.x = 2; }"),
    "declare ternary": ("const v = a ? 1 : 2; use(v, v);", "let v; if (a) { v = 1; } else { v = 2; } use(v, v);"),
    "destructuring": ("const { p, q: r } = a; use(p, r, p, r);", "const p = a.p; const r = a.q; use(p, r, p, r);"),
    "switch returns": ("switch (a) { case 1: return b; case 2: return xs; default: return 0; }", "if (a === 1) { return b; } if (a === 2) { return xs; } return 0;"),
    "switch breaks": ("switch (a) { case 1: use(1); break; default: use(2); }", "if (a === 1) { use(1); } else { use(2); }"),
    "forEach": ("xs.forEach((x) => { use(x); });", "for (const x of xs) { use(x); }"),
    "increment": ("let n = 0; n++; return g(n, n);", "let n = 0; n += 1; return g(n, n);"),
    "compound": ("a = a + b; return a;", "a += b; return a;"),
    "braces": ("if (a) use(b);", "if (a) { use(b); }"),
    "for as while": ("for (; a; ) { use(b); }", "while (a) { use(b); }"),
    "endless": ("for (;;) { use(b); }", "while (true) { use(b); }"),
    "if negation": ("if (!a) { use(1); } else { use(2); }", "if (a) { use(2); } else { use(1); }"),
    "if inequality": ("if (a !== b) { use(1); } else { use(2); }", "if (a === b) { use(2); } else { use(1); }"),
    "else after jump": ("if (a) { return 1; } else { return 2; }", "if (a) { return 1; } return 2;"),
    "else block if": ("if (a) { use(1); } else { if (b) { use(2); } }", "if (a) { use(1); } else if (b) { use(2); }"),
    "template": ("return `x${a}y`;", "return 'x' + a + 'y';"),
    "template head": ("return `${a}${b}`;", "return '' + a + b;"),
    "yoda": ("return 1 === a;", "return a === 1;"),
    "nullish pair": ("return a === null || a === undefined;", "return a == null;"),
    "not nullish pair": ("return a !== undefined && a !== null;", "return a != null;"),
    "not equal": ("return !(a === b);", "return a !== b;"),
    "de morgan": ("return !(a && b);", "return !a || !b;"),
    "void": ("return void 0;", "return undefined;"),
    "boolean test": ("if (Boolean(a)) { use(b); }", "if (!!a) { use(b); }"),
    "boolean value": ("return Boolean(a);", "return !!a;"),
    "nullish ternary": ("return use(a == null ? b : a);", "return use(a ?? b);"),
    "or ternary": ("return use(a ? a : b);", "return use(a || b);"),
    "and ternary": ("return use(a ? b : a);", "return use(a && b);"),
    "last item": ("return xs[xs.length - 1];", "return xs.at(-1);"),
    "assign spread": ("return Object.assign({}, a, { k: 1 });", "return { ...a, k: 1 };"),
    "arrow body": ("return xs.map((x) => x.id);", "return xs.map((x) => { return x.id; });"),
    "index loop": ("for (let i = 0; i < xs.length; i++) { const x = xs[i]; use(x); }", "for (const x of xs) { use(x); }"),
    "inline": ("const k = a.id; return use(k);", "return use(a.id);"),
    "push map": ("const out = []; for (const x of xs) { out.push(x.id); } return use(out, out);", "const out = xs.map((x) => x.id); return use(out, out);"),
    "push filter": ("const out = []; for (const x of xs) { if (x.ok) { out.push(x); } } return use(out, out);", "const out = xs.filter((x) => x.ok); return use(out, out);"),
    "constant order": ("const p = a + 1; const q = b * 2; return use(p, q, p, q);", "const q = b * 2; const p = a + 1; return use(p, q, p, q);"),
    "temp return": ("const r = use(a); return r;", "return use(a);"),
    "negative guard": ("if (a !== b) { return 1; } use(a); return 2;", "if (a === b) { use(a); return 2; } return 1;"),
    "parentheses and types": ("return (a as number)! + (b);", "return a + b;"),
}
DIFFERENT = {
    "free callee": ("return load(a);", "return save(a);"),
    "destructuring default": ("const { p = 1 } = a; use(p, p);", "const p = a.p; use(p, p);"),
    "fallthrough": ("switch (a) { case 1: use(1); case 2: use(2); }", "if (a === 1) { use(1); } else if (a === 2) { use(2); }"),
    "forEach index": ("xs.forEach((x, i) => { use(x, i); });", "for (const x of xs) { use(x); }"),
    "for in": ("for (const x in xs) { use(x); }", "for (const x of xs) { use(x); }"),
    "relation": ("if (!(a < b)) { use(1); } else { use(2); }", "if (a >= b) { use(1); } else { use(2); }"),
    "wrong de morgan": ("return !(a && b);", "return !a && !b;"),
    "coalesce and or": ("return a ?? b;", "return a || b;"),
    "strict null only": ("return a === null;", "return a == null;"),
    "at": ("return xs.at(0);", "return xs.at(-1);"),
    "local Boolean": ("const Boolean = b; return Boolean(a);", "return !!a;"),
    "concat order": ("a = a + b; return a;", "a = b + a; return a;"),
    "regex": ("return /a/.test(a);", "return /b/.test(a);"),
    "await is kept elsewhere": ("use(await a);", "use(a);"),
    "accumulator in loop": ("const out = []; for (const x of xs) { out.push(out.length); } return use(out, out);", "const out = xs.map((x) => out.length); return use(out, out);"),
    "index used": ("for (let i = 0; i < xs.length; i++) { const x = xs[i]; use(x, i); }", "for (const x of xs) { use(x); }"),
    "two uses": ("const k = a.id; return use(k, k);", "return use(a.id, b.id);"),
    "effect order": ("const p = use(a); const q = use(b); return g(p, q, p, q);", "const q = use(b); const p = use(a); return g(p, q, p, q);"),
    "unequal names": ("return use(a, b);", "return use(b, a, 1);"),
}


@pytest.mark.parametrize("name", SAME)
def test_one_form(name):
    x, y = SAME[name]
    assert canon(x).same(canon(y)), f"{canon(x)}\n{canon(y)}"


@pytest.mark.parametrize("name", DIFFERENT)
def test_kept_apart(name):
    x, y = DIFFERENT[name]
    assert not canon(x).same(canon(y))


def test_shadowing_and_shorthand():
    a = canonical_tree(parse("function f(x) { { const x = g(); use(x, x); } return { x }; }"))
    b = canonical_tree(parse("function h(y) { { const z = g(); use(z, z); } return { x: y }; }"))
    assert a.same(b)


@pytest.mark.parametrize("text", ["const a = ;", "function (", "let x = 'a\n'", "class { x }", "a b", "if (", "`${a", "for (;;", "const x;", "x = (1, );", "export foo;", "interface A {", "1 = 2"])
def test_errors_reject_the_text(text):
    with pytest.raises(ParseError):
        parse(text)
