import pytest

from twinscan.llm.handwritten import sure_case

MARKS = ["// THIS FILE IS MACHINE WRITTEN - run `toolgen build` to refresh it", "//  Generiert von tool-codegen 1.11, nicht bearbeiten", "/**\n * @generated SignedSource<<0123456789abcdef0123456789abcdef>>\n */"]


@pytest.mark.parametrize("mark", MARKS)
@pytest.mark.parametrize("n", [5, 28, 29, 30, 31, 500])
def test_a_mark_labels_a_file_wherever_it_stands(mark, n):
    body = "".join(f"export const pick{i} = (row) => row.cells[{i}] ?? fallback({i});\n" for i in range(n))
    assert not sure_case("r/src/a.ts", body)
    assert sure_case("r/src/a.ts", mark + "\n" + body)
    assert sure_case("r/src/a.ts", body + mark)
    assert sure_case("r/src/a.ts", body + mark + "\n" + body)


def test_a_mark_in_a_late_string_is_no_comment():
    body = "".join(f"export const pick{i} = (row) => row.cells[{i}] ?? fallback({i});\n" for i in range(60))
    assert not sure_case("r/src/a.ts", body + "const text = '// Code generated by x. DO NOT EDIT.';\n" + body)
