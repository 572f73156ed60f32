"""P1 and P2 against plain restatements; P3, P7, P8 and P19 on tables of expected output."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyref
from runlens.functions.letters import normalize_letter, parse_letter
from runlens.functions.logs import insights, log_metrics_struct
from runlens.functions.solution import extract_solution, open_equal, solution_from_json

NBSP = " "
LETTER_ROWS = ["", " b ", "AB", "BD", "THE ANSWER IS C", '{"answer": "B"}', None, f"{NBSP}c{NBSP}", "xyz",
               "answer: d", "{}", '{"answer": 1}', '{"answer": null} the end', "　A　", "false",
               '{"answer": " cd "}', '{"answer": "x"} ANSWER IS B', "no letters here", "dcba", "\n\t"]


def _col(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def test_normalize_letter(spark):
    df = _col(spark, LETTER_ROWS).select("i", "s", normalize_letter(F.col("s")).alias("got"))
    for r in df.collect():
        assert r.got == pyref.normalize_letter(r.s), r


def test_substring_trap():
    # "AB" passes the grader unchanged and is then simply wrong; "" is missing.
    assert pyref.normalize_letter("AB") == "AB"
    assert pyref.normalize_letter("THE ANSWER IS C") == "A"
    assert pyref.parse_letter("THE ANSWER IS C") == "C"


def test_parse_letter(spark):
    rows = [r for r in LETTER_ROWS if r is not None]
    df = _col(spark, rows).select("i", "s", parse_letter(F.col("s")).alias("got"))
    for r in df.collect():
        assert r.got == pyref.parse_letter(r.s), r


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters + " {}:\"'\n" + NBSP, max_size=12), min_size=1, max_size=20))
def test_letters_random(spark, values):
    df = _col(spark, values).select("s", normalize_letter(F.col("s")).alias("n"), parse_letter(F.col("s")).alias("p"))
    for r in df.collect():
        assert r.n == pyref.normalize_letter(r.s), r
        assert r.p == pyref.parse_letter(r.s), r


# Response -> kind, list, scalar
SOLUTIONS = [
    ("solution = ['a', 'b']", ("list", ["a", "b"], None)),
    ("solution = ['a', 'b'", ("list", ["a", "b"], None)),               # never closed
    ('solution = "218"', ("int", None, "218")),
    ("Solution=0218", ("int", None, "218")),
    ("x\nsolution = 5\r\nrest", ("int", None, "5")),
    ("no match", None),
    ("solution = 1_000", ("int", None, "1000")),
    ("SOLUTION = +7", ("int", None, "7")),
    ("solution =   ", ("str", None, "")),
    ("solution = [1, 2]", ("list", ["1", "2"], None)),
    ("solution = abc  ", ("str", None, "abc")),
    ("solution = '-0'", ("int", None, "0")),
    ("", None),
    (None, None),
    ('solution = ["e4", "d5"] x', ("list", ["e4", "d5", "x"], None)),   # words after the list count in
    ("text solution = Nf3\nsolution = 9", ("str", None, "Nf3")),        # the first one
]


def test_extract_solution(spark):
    df = _col(spark, [s for s, _ in SOLUTIONS]).select("i", extract_solution(F.col("s")).alias("got"))
    for r in df.collect():
        got = None if r.got is None else (r.got.kind, r.got.list, r.got.scalar)
        assert got == SOLUTIONS[r.i][1], SOLUTIONS[r.i][0]


def test_open_equality(spark):
    cases = [
        ('["a","a","b"]', "solution = ['a', 'b', 'b']", True),  # the same set and length
        ('["b","a"]', "solution = ['a', 'b']", True),
        ('["a","b"]', "solution = ['a']", False),
        ('["a","b"]', "solution = ['a', 'c']", False),
        ('"218"', "solution = 218", True),
        ('"218"', 'solution = "0218"', True),
        ('"True"', "solution = True", True),
        ('"1.5"', "solution = 1.5", True),
        ("7", "solution = 7", True),
        ('["a"]', "solution = a", False),
        ('"x"', "nothing", False),
    ]
    df = spark.createDataFrame(cases, "exp string, resp string, want boolean").select(
        "exp", "resp", "want", open_equal(extract_solution(F.col("resp")), solution_from_json(F.parse_json("exp"))).alias("ok"))
    for r in df.collect():
        assert r.ok == r.want, r


def test_log_metrics(spark):
    logs = [("Accuracy: 48.99%", {"accuracy": 48.99}), ("val=0.5\nvalidation: 0.7", {"validation": 0.7}),
            ("99/198 correct\n99/198 questions", {"correct": 99.0, "total": 198.0}), ("correct = 12", {"correct": 12.0}),
            ("Final accuracy = 75", {"accuracy": 75.0}), ("nothing", {}), ("ACCURACY\n=\n3.25", {"accuracy": 3.25}),
            ("total 5 / 10 samples", {"total": 10.0}), ("test accuracy 9\naccuracy 8", {"accuracy": 9.0})]
    df = _col(spark, [s for s, _ in logs]).select("i", log_metrics_struct(F.col("s")).alias("m"))
    for r in df.collect():
        assert {k: v for k, v in r.m.asDict().items() if v is not None} == logs[r.i][1], logs[r.i]


def test_insights(spark):
    notes = [
        ("- short\n- this is a long enough insight line\n* another long enough bullet item here\n"
         "1. numbered item that is quite long\n- ends with colon but long enough:\n",
         ["this is a long enough insight line", "another long enough bullet item here", "numbered item that is quite long"]),
        ("- \nfoo bar baz qux quux corge grault", ["foo bar baz qux quux corge grault"]),
        ("no bullets", []),
        ("- a\n" * 3 + "- " + "x" * 30, ["x" * 30]),
        ("\n".join(f"- insight number {i} with padding text" for i in range(9)), [f"insight number {i} with padding text" for i in range(5)]),
    ]
    df = _col(spark, [s for s, _ in notes]).select("i", insights(F.col("s")).alias("got"))
    for r in df.collect():
        assert list(r.got) == notes[r.i][1], notes[r.i]


_WORD = st.text("abcxyz", min_size=1, max_size=5)


@st.composite
def _answers(draw):
    """An answer, and a response that gives it."""
    lead = draw(st.sampled_from(["", "I think so.\n", "work: 3 + 4\n"])) + draw(st.sampled_from(["solution", "Solution", "SOLUTION"]))
    lead += draw(st.sampled_from(["=", " = ", "  =\t"]))
    tail = draw(st.sampled_from(["", " ", "\nmore text", "\r\n"]))
    kind = draw(st.sampled_from(["list", "int", "str"]))
    mark = draw(st.sampled_from(["'", '"']))
    if kind == "list":
        items = draw(st.lists(_WORD, min_size=1, max_size=4))
        return ("list", items, None), lead + "[" + draw(st.sampled_from([", ", ","])).join(mark + x + mark for x in items) + "]" + tail
    if kind == "int":
        n = draw(st.integers(-10**12, 10**12))
        return ("int", None, str(n)), lead + draw(st.sampled_from([str(n), mark + str(n) + mark, f"{n:_}", f"{n:+d}"])) + tail
    w = draw(_WORD)
    return ("str", None, w), lead + draw(st.sampled_from([w, mark + w + mark])) + tail


@settings(max_examples=12, deadline=None)
@given(st.lists(_answers(), min_size=8, max_size=40))
def test_answers_written_out_are_read_back(spark, cases):
    df = _col(spark, [s for _, s in cases]).select("i", extract_solution(F.col("s")).alias("got"))
    for r in df.collect():
        assert (r.got.kind, r.got.list, r.got.scalar) == cases[r.i][0], cases[r.i]
