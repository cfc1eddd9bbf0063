"""Ordered name patterns over all read names, and over names made to fit each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import name_forms as N
from readloom.plans.sqlkit import READS, reads

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# every read's name in seven forms: its own, and made-up traces of each center's style
FORMS = ("{n}", "'AB' || {i} || 'x' || {d} || '.x' || {i} || '-F' || {d}", "'ABC' || {i} || '.y' || {d}", "'Q_' || {i} || '.x' || {d}", "'L' || {i} || 'P6' || {i} || 'g' || CASE WHEN {d} % 2 = 0 THEN 'F' ELSE 'R' END || '.T0.scf'", "'k' || {i} || '.TR.' || CASE WHEN {d} % 2 = 0 THEN 'F' ELSE 'R' END", "'ABCDEFGHIJK' || {i} || CASE WHEN {d} % 3 = 0 THEN '.R' WHEN {d} % 3 = 1 THEN '.F' ELSE 'R' END", "'lane_' || {i} || '_' || {d} || '-R' || ({d} % 2 + 1)", "'mol-' || {i}")


def _union(source: str, name: str, i: str, d: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT file, read_idx, {k} AS form_no, {f.format(n=name, i=f'CAST({i} AS {text})', d=f'CAST({d} AS {text})').replace(f'CAST({d} AS {text}) %', f'{d} %')} AS name FROM {source}" for k, f in enumerate(FORMS))


NAMES = f"WITH {READS}, nm AS ({_union('reads', 'name', 'read_id', '(read_id % 10)', 'VARCHAR')})"


def names(spark, d):
    reads(spark, d).createOrReplaceTempView("__names_of_reads")
    return spark.sql(_union("__names_of_reads", "name", "read_id", "(read_id % 10)", "STRING"))


def _key(p, groups, at, forward, f, r):
    return " || ".join(f"regexp_extract(name, '{p}', {i})" if i != at else f"CASE WHEN lower(regexp_extract(name, '{p}', {i})) = '{forward}' THEN '{f}' ELSE '{r}' END" for i in range(1, groups + 1))


def _case(value) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(name, '{x[1]}') THEN {value(*x)}" for x in N.READ_PATTERNS)


HINT = _case(lambda hint, *_: hint) + " END"
DIRECTION = _case(lambda _h, p, _g, at, f, r: f"CASE lower(regexp_extract(name, '{p}', {at})) WHEN '{f}' THEN 'F' WHEN '{r}' THEN 'R' ELSE '' END") + " ELSE '' END"
OWN = _case(lambda _h, p, g, at, f, _r: _key(p, g, at, f, "f", "r")) + " END"
PAIR = _case(lambda _h, p, g, at, f, _r: _key(p, g, at, f, "r", "f")) + " END"
LIBRARY = "CASE " + " ".join(f"WHEN coalesce(hint, 0) = {h} AND regexp_matches(name, '{p}') THEN {repr(t) if t is not None else f'''regexp_extract(name, '{p}', 1)'''}" for h, p, t in N.LIBRARY_PATTERNS) + " END"


@query("f12_read_directions", f"{NAMES} SELECT file, read_idx, form_no, {HINT} AS library_hint, {DIRECTION} AS direction, {OWN} AS own_key, {PAIR} AS pair_key FROM nm")
def f12(spark, d):
    return N.with_direction(names(spark, d), out="p").select("file", "read_idx", "form_no", "p.library_hint", "p.direction", "p.own_key", "p.pair_key")


@query("f13_library_names", f"{NAMES}, h AS (SELECT *, {HINT} AS hint FROM nm) SELECT form_no, {LIBRARY} AS library, count(*) AS n FROM h GROUP BY ALL")
def f13(spark, d):
    n = N.with_direction(names(spark, d), out="p")
    return n.groupBy("form_no", N.library_of(F.col("name"), F.col("p.library_hint")).alias("library")).agg(F.count("*").alias("n"))


def _header(value) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN {value(form, p, own, well)}" for form, p, own, well in N.HEADER_FORMS) + " END"


def _g(p, i):
    return f"regexp_extract(w, '{p}', {i})"


HEAD = {
    "form": _header(lambda f, *_: f"'{f}'"),
    "template": _header(lambda _f, p, own, _w: f"pre || {_g(p, own)}"),
    "trace": _header(lambda f, p, own, _w: f"pre || {_g(p, own)}" + (f" || '.' || {_g(p, 4)}" if f == "454FR" else f" || '-R' || {_g(p, 4)}" if f == "illumina" else "")),
    "well": _header(lambda _f, p, _o, well: _g(p, well)),
    "direction": _header(lambda f, p, own, _w: _g(p, 4) if f == "454FR" else f"CASE WHEN {_g(p, own)} LIKE '%R' THEN 'R' ELSE 'F' END" if f == "454" else f"CASE WHEN {_g(p, 4)} = '1' THEN 'F' ELSE 'R' END" if f == "illumina" else "'F'"),
}


@query("f11_headers", f"{NAMES}, h AS (SELECT file, read_idx, form_no, split_part(name, ' ', 1) AS w, CASE WHEN regexp_extract(regexp_extract(file, '([^/]*)$', 1), '^([^_.]*)', 1) = '' THEN '' ELSE regexp_extract(regexp_extract(file, '([^/]*)$', 1), '^([^_.]*)', 1) || '_' END AS pre FROM nm) SELECT file, read_idx, form_no, {', '.join(f'{v} AS {k}' for k, v in HEAD.items())} FROM h")
def f11(spark, d):
    h = names(spark, d).select("file", "read_idx", "form_no", F.explode(F.array(N.header(F.col("name"), N.file_prefix(F.col("file"))))).alias("p"))
    return h.select("file", "read_idx", "form_no", *[F.col("p")[k].alias(k) for k in HEAD])
