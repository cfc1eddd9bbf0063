"""Problem 3 against a literal reading of its rules."""

import random
import re

import pytest

from readloom.operators.parse_errors import cheapest_edits, parse_match_lines

GOOD = "a b 100 90 80 2 1"
CASES = {
    GOOD: None,
    "": "columns",
    None: "columns",
    "  \t\r ": "columns",
    f" \t{GOOD}\r": None,
    '"a b" "c ""d""" 100 90 80 2 1': None,
    '"a b c 100 90 80 2 1': "quoting",
    'a"b c 100 90 80 2 1': "quoting",
    '"a"b c 100 90 80 2 1': "quoting",
    "a b 100 90 80 2": "columns",
    "a b 100 90 80 2 1 9": "columns",
    '"" b 100 90 80 2 1': "value",
    '" \t" b 100 90 80 2 1': "value",
    "a b 100 90 80 2 2": "value",
    "a b 100 90 91 2 1": "value",
    "a b 0 0 0 2 1": "value",
    "a b 70000 90 80 2 1": "value",
    "a b 99999999999999999999 90 80 2 1": "value",
    "a b 0000000000100 090 80 2 1": None,
    "a b 100 90 80 16 1": "value",
    "a b +100 90 80 2 1": "value",
    "a b １００ 90 80 2 1": "value",
    'a b "100" 90 80 "2" 1': None,
    "a x b 100 90 80 2 1": None,
    "a b 100 90 80 2 1\n": "value",
    "x" * 300_000 + " b 100 90 80 2 1": None,
    '"' + "y " * 100_000 + '" b 100 90 80 2 1': None,
}


def reason(line):
    """The rules, read literally."""
    line, i, fields = line or "", 0, []
    while i < len(line):
        if line[i] in " \t\r":
            i += 1
            continue
        if line[i] == '"':
            i, out = i + 1, []
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                out.append(line[i])
                i += 1
            if i < len(line) and line[i] not in " \t\r":
                return "quoting"
            fields.append("".join(out))
        else:
            j = i
            while j < len(line) and line[j] not in " \t\r":
                if line[j] == '"':
                    return "quoting"
                j += 1
            fields.append(line[i:j])
            i = j
    if len(fields) != 7:
        return "columns"
    if any(not f.strip(" \t\r") for f in fields[:2]) or any(not re.fullmatch("[0-9]+", f) for f in fields[2:]):
        return "value"
    n, m, d, g, f = map(int, fields[2:])
    return None if 1 <= n <= 65535 and d <= m <= n and g <= 15 and f in (0, 1) else "value"


def run(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_line string").selectExpr("*", "1 as id", "'x' as reason", "2 as flag")
    rows, rejects = parse_match_lines(df)
    loaded, bad = {r.line_id: r for r in rows.collect()}, {r.line_id: r for r in rejects.collect()}
    assert not set(loaded) & set(bad) and set(loaded) | set(bad) == set(range(len(lines)))
    return loaded, bad


def test_cases(spark):
    lines = list(CASES)
    loaded, bad = run(spark, lines)
    for i, line in enumerate(lines):
        assert (bad[i].reason if i in bad else None) == CASES[line] == reason(line), (line or "")[:80]
    assert tuple(loaded[5])[1:3] == ("a b", 'c "d"')


def test_random_lines(spark):
    rnd = random.Random(5)
    bits = ['"', '""', " ", "\t", "\r", "a", "b c", "12", "7", "0", "300", " 100 90 80 2 1", "\n"]
    lines = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 16))) for _ in range(3000)]
    lines += ["".join(c if rnd.random() > 0.04 else rnd.choice('" \tx9') for c in '"a b" "c ""d""" 100 90 80 2 1') for _ in range(2000)]
    _, bad = run(spark, lines)
    for i, line in enumerate(lines):
        assert (bad[i].reason if i in bad else None) == reason(line), line


@pytest.mark.parametrize(("line", "edits"), [('"a b c 100 90 80 2 1', (1, 0)), ("a b 100", (0, 4)), (GOOD, (0, 0)), ('a""b c 1 1 1 1 1', (2, 0))])
def test_edits(line, edits):
    assert cheapest_edits(line, 7)[:2] == edits


def test_empty_table(spark):
    assert run(spark, []) == ({}, {})


@pytest.mark.parametrize(
    ("line", "cost", "edits"),
    [
        ("a b c 100 90 80 2 1", (0, 1), "d-@3"),  # a word too many: joined where the types fit
        ("a b 10090 80 2 1", (0, 1), "d+@11"),  # the last place that fits
        ("a b", (0, 5), " ".join(["d+@3"] * 5)),
        ('"a b" c "100 90 80 2 1', (1, 0), "q-@8"),
        (" ".join(["x"] * 207), (0, 200), None),
        ('"a" ' * 9, (0, 2), None),
    ],
)
def test_edits_have_positions(line, cost, edits):
    got = cheapest_edits(line, 7)
    assert got[:2] == cost and (edits is None or got[2] == edits) and len(got[2].split()) == sum(cost)


def applied(line, edits):
    """The line after its quote edits and the insertions and deletions of delimiters."""
    out = list(line) + [""]
    for e in edits.split():
        kind, at = e[:2], int(e[3:])
        if kind == "q-":
            out[at] = ""
        elif kind == "q+":
            out[at] = '"' + out[at]
        elif kind == "d+":
            out[at] = (" " if at < len(line) else " 0") + out[at]
        else:
            while at < len(line) and line[at] in " \t\r":
                out[at] = ""
                at += 1
    return "".join(out)


def test_edits_mend_the_line():
    """Applied to the line, the edits of unquoted lines leave seven fields and those of quote faults no such fault."""
    rnd = random.Random(8)
    for _ in range(3000):
        line = " ".join(rnd.choice(["a", "12", "b_7", "300"]) for _ in range(rnd.randrange(1, 14)))
        assert len(applied(line, cheapest_edits(line, 7)[2]).split()) == 7, line
        broken = "".join(c if rnd.random() > 0.05 else '"' for c in line)
        q, d, edits = cheapest_edits(broken, 7)
        if q and not d:
            assert reason(applied(broken, edits)) in ("value", None), (broken, edits)
