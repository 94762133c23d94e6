import pytest
from hypothesis import given
from hypothesis import strategies as st

from residua.operators.line_grammar import file_records, loaded_toas, number, parse_line, parse_lines, parse_text, rejected_lines

OK = "a.ar 1400.5 50000.25 1.5 eff"


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("", None), ("   \t", None), ("C anything \" here", None), ("#\tcut \"here", None), ("MODE 1 2 3", None), ("JUMP", None),
        (OK, None), (f"50000.1 {OK}", None), (f"{OK} -be X -cut -padd -0.5", None), (f'{OK} -note "a ""b"" c"', None), ('"my file" 1,400.5 5.0D+04 1.5 8', None),
        ("TIME +1.0", None), ("time 1", None), ("INCLUDE x.tim", None), ('include "a b.tim"', None), (f'{OK} -note "-be x"', None), (f'{OK} -a "" -b', None),
        ("TIME", "columns"), ("TIME 1 2", "columns"), ("INCLUDE", "columns"), ("TIME x", "value"),
        ("a.ar 1400.5 50000.25 1.5", "columns"), (f"{OK} extra", "columns"), (f"{OK} -be X Y", "columns"), ("-x", "columns"), ("#comment", "columns"), ("1400.5 50000.25 1.5 eff", "columns"),
        ("a.ar 0 50000.25 1.5 eff", "value"), ("a.ar 100000.1 50000.25 1.5 eff", "value"), ("a.ar 1400 39999.9 1.5 eff", "value"), ("a.ar 1400 50000 0 eff", "value"),
        ("a.ar 1400 50000 10000.1 eff", "value"), ("a.ar inf 50000 1 eff", "value"), ("a.ar 1400 50000 1e999 eff", "value"), ("39000 a.ar 1400 50000 1 eff", "value"), ("a.ar 1,40 50000 1 eff", "value"),
        ('a"b.ar 1400 50000 1 eff', "quoting"), ('"a.ar 1400 50000 1 eff', "quoting"), (f'{OK} -note "a"b"', "quoting"), (f'{OK} "', "quoting"), ('a.ar x 1 "', "quoting"),
    ],
)
def test_reason(line, reason):
    assert parse_line(line).reason == reason


def test_first_reason_holds_and_all_errors_are_located():
    r = parse_line('a"b 0 1 x')
    assert r.reason == "quoting"
    assert ("quoting", 1) in r.errors and any(e[0] == "columns" for e in r.errors)


def test_values_and_flags():
    r = parse_line('50000.5 f.ar 1,400.25 5.000025d+04 2.5 8 -be X -be Y -cut -note "a ""q"" b" -p -0.5')
    assert r.values == {"sat": 50000.5, "filename": "f.ar", "freq": 1400.25, "mjd": 50000.25, "toaerr": 2.5, "tel": "8"}
    assert r.flags == {"be": "Y", "cut": "true", "note": 'a "q" b', "p": "-0.5"}


def test_text_resumes_after_a_broken_quote():
    got = list(parse_text(f'{OK}\n"broken {OK}\r\n{OK}\n'))
    assert [(n, r.kind) for n, r in got] == [(1, "toa"), (2, "error"), (3, "toa"), (4, "blank")]


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_reads_what_python_writes(x):
    assert number(repr(x)) == x


@given(st.text(max_size=60))
def test_any_line_parses(line):
    parse_line(line)


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\n\r"), min_size=1), min_size=1, max_size=4))
def test_quoted_values_round_trip(values):
    line = OK + "".join(f' -k{i} "{v.replace(chr(34), chr(34) * 2)}"' for i, v in enumerate(values))
    r = parse_line(line)
    assert r.reason is None and list(r.flags.values()) == values


def test_tables(spark):
    rows = [(1, OK, "x"), (2, None, "x"), (3, "TIME", "y"), (4, OK, "x"), (5, "", None), (6, "a " * 50_000, "z")]
    df = spark.createDataFrame(rows, "line_id long, line string, kind string")
    assert {(r["line_id"], r["reason"]) for r in rejected_lines(df, keep=["line_id"]).collect()} == {(3, "columns"), (6, "columns")}
    assert [r["line_id"] for r in loaded_toas(df).orderBy("line_id").collect()] == [1, 4]
    every = parse_lines(df)
    assert every.count() == 6 and "in_kind" in every.columns
    assert parse_lines(df.where("false")).count() == 0


def test_recovery_within_a_line_validates_the_anchor():
    r = parse_line(f'{OK} -a x"y z"w -b 5')
    assert [e for e in r.errors if e[0] == "quoting"] == [("quoting", len(OK) + 5)] and r.flags["b"] == "5"


def test_quoted_values_may_run_over_line_ends():
    note = f'{OK} -note "first\nsecond ""2""\nthird" -be X'
    got = list(parse_text(f"{OK}\n{note}\n{OK}"))
    assert [(no, r.kind) for no, r in got] == [(1, "toa"), (2, "toa"), (5, "toa")]
    assert got[1][1].flags == {"note": 'first\nsecond "2"\nthird', "be": "X"}
    # an open quote costs its own line only: the next record start is the anchor
    got = list(parse_text(f'{OK} -note "open\n{OK}\n{OK} -be "Y"\nrest" {OK}'))
    assert [(no, r.kind, r.reason) for no, r in got] == [(1, "error", "quoting"), (2, "toa", None), (3, "toa", None), (4, "error", "quoting")]


@pytest.mark.parametrize("block", [100, 20_000])
def test_files_in_blocks(spark, block):
    """Blocks give what the whole text gives, wherever their bounds fall in a value."""
    lines = []
    for i in range(120):
        lines += [f'{OK} -note "a{i}', "b", 'c" -be X'] if i % 3 == 0 else [f'"broken {OK}'] if i % 7 == 0 else [OK]
    rows = [("f", i, x, i) for i, x in enumerate(lines, 1)] + [("g", 1, OK, 0), ("g", 2, None, 0), (None, 3, OK, 0)]
    df = spark.createDataFrame(rows, "_timfile string, line_no int, line string, n_lines int")
    got = {(r["line_no"], r["kind"], r["reason"]) for r in file_records(df, block_lines=block).where("_timfile = 'f'").collect()}
    assert got == {(no, r.kind, r.reason) for no, r in parse_text("\n".join(lines))}
    assert sorted((r["line_no"], r["kind"]) for r in file_records(df).where("_timfile = 'g'").collect()) == [(1, "toa"), (2, "blank")]
    assert file_records(df.where("false")).count() == 0
