import ast
import json
import random
from pathlib import Path

import pytest

from twinscan.llm.lexer import language_of, problem

ROOT = Path(__file__).resolve().parents[2]


def test_no_valid_python_file_is_flagged():
    files = [*ROOT.glob("twinscan/**/*.py"), *ROOT.glob("tests/*.py"), *list(Path(ast.__file__).parent.glob("*.py"))[:60]]
    for f in files:
        text = f.read_text("utf-8", errors="replace")
        try:
            ast.parse(text)
        except SyntaxError:
            continue
        assert problem(text, language_of(str(f))) is None, f


def test_cut_python_files_are_flagged_as_the_interpreter_does():
    rng = random.Random(2)
    wrong = 0
    for f in list(ROOT.glob("twinscan/**/*.py"))[:20]:
        text = f.read_text("utf-8") + "\n\n"
        for _ in range(10):
            part = text[: rng.randrange(1, len(text))]
            try:
                ast.parse(part)
            except SyntaxError:
                wrong += problem(part, "python") is None
            else:
                assert problem(part, "python") is None, part[-200:]
    assert wrong <= 30  # a lexer does not see every fault of grammar, such as a keyword cut short


@pytest.mark.parametrize(
    "text,reason",
    [("x = 'abc\ny = 1\n", "unterminated string"), ("def f(:\n  pass\n", "unbalanced delimiter"), ("f(]\n", "unbalanced delimiter"), ("if x:\ny = 1\n", "block without a body"), ("a = 1\n  b = 2\n", "unexpected indent"), ("if x:\n    a\n  b\n", "indent matches no block"), ("a = 1 +\n", "operator without an operand"), ("def f():\n", "premature end"), ("f(1,\n", "premature end"), ("<<<<<<< HEAD\na = 1\n=======\na = 2\n>>>>>>> b\n", "conflict marker"), ("a = 1$\n", "unknown character"), ("x = '''a\n", "unterminated string")],
)
def test_invalid_python_is_named(text, reason):
    assert problem(text, "python") in ((reason,) if reason != "unbalanced delimiter" else (reason, "premature end"))


def test_json_agrees_with_a_parser():
    rng = random.Random(5)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 5)
        if kind < 5:
            return [None, True, rng.random() * 1e6, rng.randrange(-9, 9), 'a"\\\u00e9\n'][kind]
        return [value(depth + 1) for _ in range(rng.randrange(3))] if kind == 5 else {str(rng.random()): value(depth + 1) for _ in range(rng.randrange(3))}

    for _ in range(600):
        text = json.dumps(value(), indent=rng.choice([None, 1]))
        if rng.random() < 0.7 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "]", "}", '"', ":", "x", "0"]) + text[at + rng.randrange(2) :]
        if not text.strip():
            continue
        try:
            json.loads(text, parse_constant=lambda c: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (problem(text, "json") is None) == ok, text
    assert problem("", "json") is None and problem("", "python") is None and problem("<<<<<<< a\n{}", "json") == "conflict marker"
    assert problem("[" * 100_000, "json") == "premature end"
