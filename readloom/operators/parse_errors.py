"""Problem 3: rows that fail to parse, by minimum-cost error parse.

A line is parsed at zero cost if it is exactly the wanted number of well-formed fields; that path is one regular
expression, evaluated in the JVM, and its fields are then type-checked there. Only lines without a zero-cost path go
through the dynamic programme, which finds the cheapest edits (insert or delete a quote, insert or
delete a delimiter), each with its position, that make the line parse; the kinds of edit state the reason.

The programme runs over the line's pieces (blanks, quotes, plain text), so a line costs its number of pieces, however long they are. Its state is
(lexer state, fields begun); costs compare quote edits first, then delimiter edits, then fields of the wrong type, so a
line is blamed on quoting exactly if no parse exists without a quote edit, and delimiters are edited where the types fit best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r"
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^ \t\r"]++)'
GAP, BARE, QUOTED, CLOSED = range(4)  # between fields, in an unquoted field, in quotes, just after a closing quote
_PIECE = re.compile(r'[ \t\r]+|"|[^ \t\r"]+')
_DIGITS = re.compile(r"[0-9]+\Z")
TEXTS = 2  # the first fields are names, the others numbers


def cheapest_edits(line: str | None, fields: int) -> tuple[int, int, str]:
    """(quote edits, delimiter edits, the edits in order) of a cheapest parse of line into exactly `fields` fields.

    Edits, each with its 0-based position in the line: q+ / q- insert / delete a quote, d+ / d- insert / delete a delimiter. A delimiter is inserted inside
    plain text or at the end of the line (for a field that is not there); deleting one makes the fields beside it one. Null is an empty line.
    """
    line = line or ""
    # cost: (quote edits, delimiter edits, wrong types); value: cost and the edits so far as a linked list
    best: dict[tuple[int, int], tuple[tuple[int, int, int], tuple]] = {(GAP, 0): ((0, 0, 0), ())}
    blank = 0  # where the last blanks began
    # without quotes the cheapest parse only deletes delimiters or only inserts them, no more than fields are spare or missing
    quoted = '"' in line
    n = 0 if quoted else sum(m[0][0] not in BLANK for m in _PIECE.finditer(line))
    may_cut, may_join, most_d = quoted or n < fields, quoted or n > fields, len(line) if quoted else abs(n - fields)
    for m in _PIECE.finditer(line):
        piece, at = m[0], m.start()
        after: dict[tuple[int, int], tuple[tuple[int, int, int], tuple]] = {}

        def go(state: int, begun: int, cost: tuple[int, int, int], edits: tuple, q: int = 0, d: int = 0, t: int = 0) -> None:
            new = (cost[0] + q, cost[1] + d, cost[2] + t)
            if (state, begun) not in after or new < after[state, begun][0]:  # noqa: B023
                after[state, begun] = (new, edits)  # noqa: B023

        if piece[0] in BLANK:
            blank = at
            for (state, begun), (cost, edits) in best.items():
                if state == QUOTED:
                    go(QUOTED, begun, cost, edits)
                    go(GAP, begun, cost, (edits, "q+", at), q=1)
                else:
                    go(GAP, begun, cost, edits)
        elif piece == '"':
            for (state, begun), (cost, edits) in best.items():
                if state == QUOTED:
                    go(CLOSED, begun, cost, edits)
                else:
                    go(state, begun, cost, (edits, "q-", at), q=1)
                    if state == CLOSED:
                        go(QUOTED, begun, cost, edits)
                    elif state == GAP:
                        if begun < fields:
                            go(QUOTED, begun + 1, cost, edits)
                        if begun and may_join:
                            go(QUOTED, begun, cost, (edits, "d-", blank), d=1)
        else:
            number = _DIGITS.match(piece) is not None
            wrong = lambda begun: int(begun > TEXTS and not number)  # noqa: B023, E731
            for (state, begun), (cost, edits) in best.items():
                if state == QUOTED:
                    go(QUOTED, begun, cost, edits)
                elif state == CLOSED:  # text after a closing quote: that quote goes
                    go(QUOTED, begun, cost, (edits, "q-", at - 1), q=1)
                else:
                    first = []
                    if state == BARE:
                        first.append((begun, cost, edits, 0))
                    if state == GAP and begun < fields:
                        first.append((begun + 1, cost, edits, 0))
                    if state == GAP and begun and may_join and cost[1] < most_d:
                        first.append((begun, cost, (edits, "d-", blank), 1))
                    for start, c, e, d in first:
                        go(BARE, start, c, e, d=d, t=wrong(start))
                        for more in range(1, min(len(piece), fields - start + 1, most_d - c[1] + 1) if may_cut else 1):  # cut into more fields
                            e = (e, "d+", at + more)
                            go(BARE, start + more, c, e, d=d + more, t=sum(wrong(start + i) for i in range(more + 1)))
        best = after
    ends = []
    for (state, begun), ((q, d, t), edits) in best.items():
        if state == QUOTED:
            q, edits = q + 1, (edits, "q+", len(line))
        for _ in range(fields - begun):
            edits = (edits, "d+", len(line))
        missing = fields - begun
        ends.append(((q, d + missing, t + missing), -begun, state, edits))
    (quotes, delimiters, _), *_, edits = min(ends, key=lambda x: x[:3])
    text = []
    while edits:
        edits, kind, at = edits
        text.append(f"{kind}@{at}")
    return quotes, delimiters, " ".join(text[::-1])


def _edit_batches(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [cheapest_edits(x, fields) for x in b.column(1).to_pylist()]
        reason = ["quoting" if q else "columns" for q, _, _ in found]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reason, pa.string()), pa.array([e for _, _, e in found], pa.string()), b.column(1)], names=["id", "reason", "edits", "raw"])


# typed checks of the seven fields of a match line, in order of the columns
MATCH_FIELDS = ("read1", "read2", "read_length", "match_length", "identity", "gap", "flag")


def parse_match_lines(lines: DataFrame, line_id: str = "line_id", raw: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delivered match text.

    rows: line_id, read1, read2 string, read_length, match_length, identity, gap, flag int, for lines that give a proper match;
    rejects: line_id, reason ('quoting', 'columns' or 'value'), edits (the cheapest repair; empty for 'value'), raw_line.
    Each line is in exactly one of the two. Null and empty lines are rejected for their columns; repeated lines are kept; other columns of
    the input are ignored.
    """
    pattern = rf"^[ \t\r]*+({_FIELD})" + rf"[ \t\r]++({_FIELD})" * 6 + r"[ \t\r]*+\z"
    base = lines.select(F.col(line_id).alias("id"), F.col(raw).alias("raw")).withColumn("fits", F.coalesce(F.col("raw").rlike(pattern), F.lit(False)))
    unquote = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    small = lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) <= 9, F.try_to_number(F.concat(F.lit("0"), F.right(x, F.lit(9))), F.lit("9999999999")).cast("int")).otherwise(999_999_999)
    number = lambda x: F.when(x.rlike(r"^[0-9]+\z"), small(x))
    # a one-element explode keeps each step computed once: filters are not pushed through it
    fields = base.where("fits").select("id", "raw", F.explode(F.array(F.transform(F.regexp_extract_all("raw", F.lit(_FIELD), F.lit(0)), unquote))).alias("p"))
    numbers = fields.select("id", "raw", "p", F.explode(F.array(F.transform(F.slice("p", 3, 5), number))).alias("v"))
    named = (F.trim(F.translate(F.col("p")[0], "\t\r", "  ")) != "") & (F.trim(F.translate(F.col("p")[1], "\t\r", "  ")) != "")
    good = named & F.expr("v[0] between 1 and 65535 and v[1] <= v[0] and v[2] <= v[1] and v[3] <= 15 and v[4] in (0, 1)")
    flat = [F.col("p")[i].alias(n) for i, n in enumerate(MATCH_FIELDS[:2])] + [F.col("v")[i].alias(n) for i, n in enumerate(MATCH_FIELDS[2:])]
    checked = numbers.select("id", "raw", *flat, F.explode(F.array(F.coalesce(good, F.lit(False)))).alias("good"))
    rows = checked.where("good").select(F.col("id").alias(line_id), *MATCH_FIELDS)
    values = checked.where("not good").select("id", F.lit("value").alias("reason"), F.lit("").alias("edits"), "raw")
    broken = base.where("not fits")
    edits = broken.select("id", "raw").mapInArrow(lambda it: _edit_batches(it, 7), "id bigint, reason string, edits string, raw string")
    rejects = values.unionByName(edits).select(F.col("id").alias(line_id), "reason", "edits", F.col("raw").alias(raw))
    return rows, rejects

