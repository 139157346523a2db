import pytest
from pyspark.sql import functions as F

from twinscan.llm.lexer import language_of, problem
from twinscan.llm.syntax import invalid_files, parse_verdicts

N = 10_000
WHOLE = {
    "closed": "const a = <ul>" + "<li>x</li>" * N + "</ul>;\n",
    "self-closed": "const a = <svg>" + "<path d='M0 0'/>\n" * N + "</svg>;\n",
    "fragments": "const a = <>" + "<></>" * N + "</>;\n",
    "nested": "const a = " + "<b>" * N + "</b>" * N + ";\n",
    "braces": "const a = <ul>" + "<li k={1}>{x}</li>" * N + "</ul>;\n",
}


@pytest.mark.parametrize("ext", ["tsx", "jsx"])
@pytest.mark.parametrize("kind", list(WHOLE))
def test_any_number_of_elements_is_read(ext, kind):
    text, language = WHOLE[kind], language_of("x." + ext)
    assert problem(text, language) is None
    assert problem(text[: text.rindex("</")], language) == "premature end"
    cut = text.rindex("</")
    assert problem(text[:cut] + "</wrong>;\n", language) == "unbalanced markup"


def test_a_file_of_many_elements_does_not_fail_the_query(spark):
    rows = [(1, "r/a.tsx", WHOLE["closed"]), (2, "r/b.tsx", WHOLE["closed"][:-6]), (3, "r/c.ts", "a(")]
    df = spark.createDataFrame(rows, "file_id long, file_path string, content string")
    found = invalid_files(parse_verdicts(df, F.col("file_id"), F.col("file_path"), F.col("content")))
    assert sorted(r[0] for r in found.collect()) == [2, 3]
