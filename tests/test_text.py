import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as X

TRICKY = ["", " ", "\n", "a\n", "a\r\nb\rc", "\ta \x0b b\x0c", "A\x85B C  d", "İ Σ ß\n\n x ", "\x1ca\x1db\x1e c\x1f", "　wide\xa0"]


def collect(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(*columns).collect()]


def test_lines_strip_and_normal_form_are_pythons(spark):
    got = collect(spark, TRICKY, X.lines(F.col("t")), X.strip(F.col("t")), X.rstrip(F.col("t")), X.normalize_code(F.col("t")))
    for value, (lines, strip, rstrip, normal) in zip(TRICKY, got, strict=True):
        assert lines == value.splitlines()
        assert strip == value.strip() and rstrip == value.rstrip()
        assert normal == "\n".join(x.strip() for x in value.splitlines() if x.strip()).lower()


def test_same_but_for_trailing_blanks(spark):
    rows = spark.createDataFrame([("a \nb", "a\nb\t"), (" a", "a"), ("a", "a\n")], "a string, b string")
    assert [r[0] for r in rows.select(X.same_but_for_trailing_blanks(F.col("a"), F.col("b"))).collect()] == [True, False, True]


@pytest.mark.parametrize(
    ("body", "name"),
    [("static int foo(void) {", "foo"), ("if (x) {", "if (x) {"), ("char *bar (int a)\n{", "bar"), ("no call here" * 9, ("no call here" * 9)[:40]), ("unsigned long größe(int)", "größe")],
)
def test_function_name(spark, body, name):
    assert collect(spark, [body], X.function_name(F.col("t"))) == [(name,)]


def test_function_names_are_those_of_the_pattern(spark):
    """Against the pattern itself on short lines; on long ones, where a matcher that backtracks would run for ever or out of stack."""
    import random

    pattern = re.compile(r"(?:static\s+)?(?:inline\s+)?(?:const\s+)?(?:\w+[\s*]+)*?(\w+)\s*\(")
    r, pieces = random.Random(1), ["static ", "inline ", "const ", "int", " ", "*", "f", "(", ")", "\t", "größe", "if", "_x1", ",", "::", "\x1c", "\n", "\xa0"]
    bodies = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    want = []
    for body in bodies:
        line = body.split("\n")[0].strip()
        found = pattern.match(line)
        want.append(found[1] if found and found[1] not in X.KEYWORDS else line[:40])
    assert [x for (x,) in collect(spark, bodies, X.function_name(F.col("t")))] == want
    long = ["word " * 100_000 + "name(int a)", "w" * 500_000 + " * name (", "a" + " " * 300_000 + "(", "word " * 100_000, "* " * 100_000 + "x("]
    assert [x for (x,) in collect(spark, long, X.function_name(F.col("t")))] == ["name", "name", "a", long[3][:40], long[4][:40]]


def test_null_vocabularies(spark):
    got = collect(spark, [None, "", " None ", "NULL", "n/a", "x "], X.present(F.col("t")), X.has_description(F.col("t")))
    assert got == [(None, False), (None, False), (None, False), (None, False), ("n/a", False), ("x", True)]


def test_clean_list_and_line_numbers(spark):
    row = spark.sql("select array(' a', 'None', null, '') l, array(struct(3 line_no, 'x' text), struct(1 line_no, ' ' text), struct(3 line_no, 'y' text), struct(2 line_no, 'z' text)) c, cast(null as array<string>) n")
    assert tuple(row.select(X.clean_list(F.col("l")), X.line_numbers(F.col("c")), X.clean_list(F.col("n"))).first()) == (["a"], [2, 3], [])


def test_encoded_changes(spark):
    values = ['[[3, " x "], [4, ""]]', "None", "null", "[]", "[[1]]", "broken", None]
    got = [[(c["line_no"], c["text"]) for c in r[0]] for r in collect(spark, values, X.encoded_changes(F.col("t")))]
    assert got == [[(3, "x"), (4, "")], [], [], [], [], [], []]


def test_numbered_and_code_of_a_prompt(spark):
    got = collect(spark, ["a\n\nb"], X.numbered(F.col("t")), X.last_line_number(X.numbered(F.col("t"))), X.last_line_number(F.col("t")))
    assert got == [("1: a\n2: \n3: b", 3, 2)]
    assert collect(spark, ["x\n```c\n1: a\n```\ny"], X.code_in_prompt(F.col("t"))) == [("1: a\n",)]


def test_tokens(spark):
    got = collect(spark, [None, "", " a  b\tc "], X.token_count(F.col("t")), X.truncate_tokens(F.col("t"), 2), X.truncate_tokens(F.col("t"), 0))
    assert got == [(0, None, None), (0, None, None), (3, "a b...", None)]


def test_pair_id_writes_none(spark):
    assert spark.range(1).select(X.pair_id(F.lit("a"), F.lit(None), F.lit("c"), F.lit(""), F.lit("h"))).first()[0] == "a_None_c__h"


def test_first_filled(spark):
    assert collect(spark, [None, "", "x"], X.first_filled(F.col("t"), F.lit(""), F.lit("z"))) == [("z",), ("z",), ("x",)]


def test_python_whitespace_class_is_complete():
    ours = re.compile(X.BLANK)
    assert {chr(c) for c in range(0x3001) if chr(c).isspace()} == {chr(c) for c in range(0x3001) if ours.fullmatch(chr(c))}
