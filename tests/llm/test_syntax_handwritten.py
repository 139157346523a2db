import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscan.llm.handwritten import classify, features, fit_classifier, fit_svm, sure_case, validation
from twinscan.llm.lexer import language_of, problem
from twinscan.llm.syntax import agreement, invalid_files, invalid_rates, parse_verdicts, reports

VALID = [
    ("ts", ""),
    ("ts", "// only a comment\n/* and another */"),
    ("ts", "﻿#!/usr/bin/env node\nconst a: Map<string, Array<number>> = new Map();\n"),
    ("ts", "const r = /^a[a-z{(]{2,}\\/(\\d+)$/gi.test(x) ? a / b / c : x[0] / 2;"),
    ("ts", "if (a) /re(/.test(b);\nconst f = <T,>(x: T) => <U>(y: U) => x;"),
    ("ts", "const s = `a ${b ? `c ${d}` : '}'} \\` <<<<<<< HEAD`;\n/*\n<<<<<<< ours\n*/"),
    ("ts", "abstract class A<T> extends B implements C { private readonly x?: string = 'a'; static get y(): number { return 1 } constructor(public z: T) { super() } [k: string]: any }"),
    ("ts", "type A = { [K in keyof T]?: T[K] } | ((a: string) => void);\nexport type { A };\nenum E { X = 1, Y }\ndeclare module 'x' { export const y: number; }"),
    ("ts", "for await (const x of y) { a++\n++b\n}\nlabel: for (;;) { break label }\ndo x--; while (x > 0)\nlet v = a as unknown as string[], w = v!;"),
    ("js", "const { a, b: c = 1, ...d } = require('x');\nexport default async function* g(a, { b } = {}, ...c) { yield* a; await b; return }\nx ??= y?.[0]?.(1) ?? 2 ** 3;"),
    ("js", "switch (a) { case 'x': { b(); break } default: c() }\nvar o = { get a() { return 1 }, async *b() {}, 'c': 1, [d]: 2, e, };\nexport { o as p };"),
    ("js", "const n = [0x1F, 0b11, 1_000, .5, 1e-9, 10n, 1..toString()];;;\nconst t = a ? b : c, u = (a, b);"),
    ("tsx", "const A = <T,>({ a }: P<T>) => (<div className=\"x\" {...a} on={() => { b < c }}>it's {a && <b>&amp;</b>} <></> <C.D e='f' /></div>);"),
]
INVALID = [
    ("ts", "function f() { return 1;", "premature end"),
    ("ts", "const a = [1, 2;", "unbalanced delimiter"),
    ("ts", "foo(1));", "unbalanced delimiter"),
    ("ts", "const s = 'abc\nlet x = 1;", "unterminated string"),
    ("ts", "const s = `abc ${x} def", "unterminated template"),
    ("ts", "const r = /abc\n", "unterminated regex"),
    ("ts", "a();\n/* never closed", "unterminated comment"),
    ("ts", "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> x\n", "conflict marker"),
    ("ts", "a(1, );b(, 2);", "operator without an operand"),
    ("ts", "const x = ;", "operator without an operand"),
    ("ts", "const x = 1 +", "premature end"),
    ("ts", "let a = b c;", "operands without an operator"),
    ("ts", "const x = “hi”;", "unknown character"),
    ("ts", '{\n  "name": "x",\n  "n": 1\n}\n', "data instead of a program"),
    ("ts", "<!DOCTYPE html>\n<html></html>", "operator without an operand"),
    ("ts", ".a {\n  width: 1px;\n}\n", "operator without an operand"),
    ("ts", "#!/bin/sh\nset -e\nif [ -z \"$A\" ]; then\n  echo x\nfi\n", "operands without an operator"),
    ("ts", "import os\n\ndef f(a, b=1):\n    return a\n", "operands without an operator"),
    ("ts", "const a = <div>text</div>;", "markup outside a tsx file"),
    ("ts", "const p = {{ a.b }};", "operands without an operator"),
    ("ts", "const s = '\\u12';", "bad escape"),
    ("ts", "const n = 12px;", "bad number"),
    ("js", "interface A { b: string }", "typescript in javascript"),
    ("js", "function f(a: string) { return a }", "typescript in javascript"),
    ("js", "import type { A } from './a';", "typescript in javascript"),
    ("js", "const a = <b/>;", "markup in javascript"),
    ("tsx", "const a = <b><c></b></c>;", "unbalanced markup"),
    ("tsx", "const a = <b>text", "premature end"),
]


@pytest.mark.parametrize("ext,text", VALID)
def test_valid_programs_pass(ext, text):
    assert problem(text, language_of("x." + ext)) is None


@pytest.mark.parametrize("ext,text,reason", INVALID)
def test_invalid_programs_are_named(ext, text, reason):
    assert problem(text, language_of("x." + ext)) == reason


def test_every_cut_of_a_program_inside_a_bracket_is_invalid():
    text = "const f = (a, b) => {\n  if (a) { return `x${b}`; }\n  return [a, 'b', /c/];\n};\n"
    for i in range(text.index("{") + 1, text.rindex("}")):
        assert problem(text[:i], "typescript"), text[:i]


FILES = "file_id long, file_path string, content string, reason string, repo int, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FILES)


COLUMNS = "file_id", "file_path", "content"


def columns():
    return [F.col(c) for c in COLUMNS]


def test_verdicts_and_rates(spark):
    rows = [(1, "r/a.ts", "a("), (1, "r/a.ts", "a("), (2, "r/b.ts", ""), (3, "./r/c.js", None), (4, "r/d.md", "a("), (5, None, "a("), (None, "r/e.ts", "a("), (6, "q\\f.ts", "x = (1);" * 50000)]
    v = parse_verdicts(frame(spark, rows), *columns())
    assert [r[0] for r in invalid_files(v).collect()] == [1]
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"], r["rate"]) for r in invalid_rates(v).collect()}
    assert rates == {("r", "typescript"): (2, 1, 0.5), ("r", "javascript"): (1, 0, 0.0), ("r", None): (1, None, None), (None, None): (1, None, None), ("q", "typescript"): (1, 0, 0.0)}
    assert invalid_rates(parse_verdicts(frame(spark, []), *columns())).count() == 0


def hand(i):
    return f"import {{ a{i} }} from './b{i}';\n\nexport function run{i}(x: string): number {{\n  // keep it short\n  const y = a{i}(x);\n  return y.length + {i};\n}}\n" * 2


def tool(i, header):
    return ("// Code generated by toolc v1.2. DO NOT EDIT.\n" if header else "") + "".join(f"export const FIELD_{i}_{k} = {i * 7 + k};\n" for k in range(40))


def test_classifier_carries_marks_to_unmarked_files_of_other_repositories(spark):
    rows = [(i, f"repo{i % 6}/src/m{i}.ts", hand(i)) for i in range(120)] + [(200 + i, f"repo{i % 6}/src/g{i}.ts", tool(i, i % 3 > 0)) for i in range(60)]
    rows += [(200, "repo0/src/g0.ts", tool(0, False)), (900, "repo1/x.ts", ""), (901, None, None), (902, "repo1/y.ts", tool(1, True) + "export const = ;\n"), (None, "repo1/z.ts", hand(1))]
    df = frame(spark, rows)
    weights = fit_classifier(df, *columns())
    got = {r["file_id"]: r for r in classify(df, *columns(), weights).collect()}
    assert {i for i, r in got.items() if r["machine"]} == set(range(200, 260))
    assert got[900]["score"] is None and got[901]["score"] is None
    figures = {r["measure"]: r for r in validation(df, *columns()).collect()}
    assert figures["repositories"]["recall"] > 0.9 and figures["repositories"]["held_out"] > 0


def test_classifier_without_labels_or_rows(spark):
    for rows in ([], [(1, "r/a.ts", hand(1))]):
        df = frame(spark, rows)
        weights = fit_classifier(df, *columns())
        assert not classify(df, *columns(), weights).where("machine").count()


def test_tell_tale_lines_are_masked():
    a, b = features("r/a.ts", tool(1, True)), features("r/a.ts", "\n" + tool(1, False))
    assert np.allclose(a, b)
    assert sure_case("r/a.ts", tool(1, True)) and not sure_case("r/a.ts", "const B = '// Code generated by x. DO NOT EDIT.';\n" + hand(1))


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(200, 5)), np.ones(200)].astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] + 0.2 > 0, 1, -1)
    assert (np.sign(x @ fit_svm(x, y, c=10.0, epochs=30)) == y).mean() > 0.97


def test_reports_are_compared_with_verdicts(spark):
    files = spark.createDataFrame([(1, 7, "./a/x.ts", "const = 1"), (2, 7, "a/y.ts", "let a = 1;"), (2, 7, "a/y.ts", "let a = 1;"), (3, 8, "a/x.ts", "ok();"), (4, None, None, "f(")], "file_id long, run_id long, file_path string, content string")
    runs = spark.createDataFrame([(7, ["a\\x.ts", "gone.ts", None]), (8, None)], "run_id long, skipped_files array<string>")
    warnings = spark.createDataFrame([(7, " a/y.ts", "Parse errors: x"), (7, "a/x.ts", "too long"), (8, None, "parse")], "run_id long, file_path string, message string")
    named = reports(files, F.col("file_id"), F.col("file_path"), F.col("run_id"), runs, warnings)
    assert {tuple(r) for r in named.collect()} == {(1, True, False), (2, False, True), (3, False, False), (4, False, False)}
    verdicts = parse_verdicts(files, *columns_of("file_id", "file_path", "content"))
    assert {tuple(r) for r in agreement(verdicts, named).collect()} == {(True, True, False, 1), (False, False, True, 1), (False, False, False, 2)}
    assert reports(files.limit(0), F.col("file_id"), F.col("file_path"), F.col("run_id"), runs, warnings).count() == 0


def columns_of(*names):
    return tuple(map(F.col, names))


def test_a_parameter_type_is_seen_however_far_the_name_is():
    far = "/* " + "x" * 500 + " */"
    assert problem(f"function f(a, {far} b: number) {{}}", "javascript") == "typescript in javascript"
    assert problem(f"function f(a, {far} b: number) {{}}", "typescript") is None
    assert problem("const x = y ? (a, b) : c;", "javascript") is None
