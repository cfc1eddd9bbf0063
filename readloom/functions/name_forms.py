"""Ordered name patterns: read direction, pair keys, libraries, and header forms of several instruments.

The first pattern that fits decides. Expressions are built from the tables below, so Spark evaluates one ordered CASE per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: library hint, pattern, number of groups, the group that tells the direction, its text for forward and for reverse
READ_PATTERNS = (
    (0, r"^(.+\.TR\.)([FR])$", 2, 2, "f", "r"),
    (0, r"^(.+\.)[xy].(.*-)([FfRr])(.*)$", 4, 3, "f", "r"),
    (0, r"^(.+\.)[xy].(.*-)([SsTt])(.*)$", 4, 3, "s", "t"),
    (1, r"^([A-Za-z0-9]{2,3}[A-Za-z]+[0-9]+\.)([xy])", 2, 2, "x", "y"),
    (1, r"^([A-Za-z]{3,}[0-9]+\.)([xy])", 2, 2, "x", "y"),
    (1, r"^([A-Za-z0-9]{2,3}[A-Za-z]+[0-9]+\.)([bg])", 2, 2, "b", "g"),
    (1, r"^([A-Za-z]{3,}[0-9]+\.)([bg])", 2, 2, "b", "g"),
    (2, r"^(.+_.+\.)([xy])([0-9]{1,2})$", 3, 2, "x", "y"),
    (3, r"^(.+\.)([xy])\.stg\.pld", 2, 2, "x", "y"),
    (3, r"^(.+\.)([pq])", 2, 2, "p", "q"),
    (4, r"^([LG][0-9]+P[0-9]+)(.*g)([FR])(\.T[0-9]+\.scf)$", 4, 3, "f", "r"),
    (4, r"^([LG][0-9]+P[0-9]+)([FR])(.*\.T[0-9]+\.scf)$", 3, 2, "f", "r"),
    (0, r"^(.+\.)([fr])$", 2, 2, "f", "r"),
    (0, r"^(.+\.)(s)$", 2, 2, "s", "t"),
)
# fixed values: library hint, pattern, library name (None: the pattern's first group)
LIBRARY_PATTERNS = (
    (0, r"^([A-Za-z]{3,4})", None),
    (0, r"^([A-Za-z0-9]{2,3}[A-Za-z])", None),
    (0, r"", "Other"),
    (1, r"^([A-Za-z]{3,4})", None),
    (1, r"", "JGI"),
    (2, r"", "Los Alamos"),
    (3, r"", "stg.pld"),
    (4, r"^.[0-9]+[^0-9][0-9]{1,2}[^0-9]", "WIBR m13"),
    (4, r"^.[0-9]+[^0-9]6[0-9]{2,4}[^0-9]", "WIBR 4k"),
    (4, r"^.[0-9]+[^0-9]9[0-9]{2}[^0-9]", "WIBR shatter"),
    (4, r"^.[0-9]+[^0-9]5[0-9]{3}[^0-9]", "WIBR 10k"),
    (4, r"^.[0-9]+[^0-9]8[0-9]{3}[^0-9]", "WIBR fosmid"),
    (4, r"", "WIBR"),
)
# fixed values: form, pattern of the header's first word, groups of the id and of the well
HEADER_FORMS = (
    ("454FR", r"^(([A-Za-z0-9]{11})([A-Za-z0-9]+))\.([RF])", 1, 3),
    ("454", r"^(([A-Za-z0-9]{11})([A-Za-z0-9]+))", 1, 3),
    ("illumina", r"^(.*_([^_]*)_[^_]*)(-R|/)([12])", 1, 2),
    ("generic", r"^(.*-([^-]+))$", 1, 2),
)


def _first(name: Column, choices: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(choices), otherwise)


def read_direction(name: Column) -> Column:
    """struct<library_hint, direction, own_key, pair_key> of a name by the first pattern that fits; direction is 'F', 'R' or ''.

    The keys are the pattern's groups with the direction written as f or r (r unless it is forward), and the other way round for the mate:
    own_key of a read is pair_key of its mate. A name without pattern has hint null, no direction and no keys.
    """
    choices = []
    for hint, pattern, groups, at, forward, reverse in READ_PATTERNS:
        group = lambda i, p=pattern: F.regexp_extract(name, p, i)
        said = F.lower(group(at))
        key = lambda f, r, group=group, groups=groups, at=at, said=said, forward=forward: F.concat(*[group(i) if i != at else F.when(said == forward, f).otherwise(r) for i in range(1, groups + 1)])
        direction = F.when(said == forward, "F").when(said == reverse, "R").otherwise("")
        choices.append((name.rlike(pattern), F.struct(F.lit(hint).alias("library_hint"), direction.alias("direction"), key("f", "r").alias("own_key"), key("r", "f").alias("pair_key"))))
    none = F.lit(None).cast("string")
    return _first(name, choices, F.struct(F.lit(None).cast("int").alias("library_hint"), F.lit("").alias("direction"), none.alias("own_key"), none.alias("pair_key")))


def with_direction(df: DataFrame, name: str = "name", out: str = "direction_of") -> DataFrame:
    """df with read_direction of a column as a struct. It goes through a one-element explode, so that the patterns run once a name, however many fields are used."""
    return df.select("*", F.explode(F.array(read_direction(F.col(name)))).alias(out))


def library_of(name: Column, hint: Column) -> Column:
    """The library of a name whose direction pattern gave the hint (a name without pattern counts as hint 0)."""
    h = F.coalesce(hint, F.lit(0))
    choices = [((h == n) & name.rlike(p), F.lit(text) if text is not None else F.regexp_extract(name, p, 1)) for n, p, text in LIBRARY_PATTERNS]
    return _first(name, choices, F.lit(None).cast("string"))


def file_prefix(file: Column) -> Column:
    """Prefix of names from a file: its base name up to the first '_' or '.', and '_'; empty if that is empty."""
    base = F.regexp_extract(file, r"([^/]*)$", 1)
    head = F.regexp_extract(base, r"^([^_.]*)", 1)
    return F.when(head == "", "").otherwise(F.concat(head, F.lit("_")))


def header(name: Column, prefix: Column | None = None, base36: bool = False) -> Column:
    """struct<form, trace, template, well, direction> of a header's first word by the first form that fits (454FR, 454, illumina, generic); null if none does.

    trace and template begin with the prefix; base36: wells of the 454 forms as decimal numbers.
    """
    word, pre = F.substring_index(name, " ", 1), F.lit("") if prefix is None else prefix
    choices = []
    for form, pattern, own, well in HEADER_FORMS:
        g = lambda i, p=pattern: F.regexp_extract(word, p, i)
        template = F.concat(pre, g(own))
        trace, direction, w = template, F.lit("F"), g(well)
        if form == "454FR":
            trace, direction = F.concat(pre, g(own), F.lit("."), g(4)), g(4)
        elif form == "454":
            direction = F.when(g(own).endswith("R"), "R").otherwise("F")
        elif form == "illumina":
            trace, direction = F.concat(pre, g(own), F.lit("-R"), g(4)), F.when(g(4) == "1", "F").otherwise("R")
        if base36 and form.startswith("454"):
            w = F.conv(F.upper(w), 36, 10)
        choices.append((word.rlike(pattern), F.struct(F.lit(form).alias("form"), trace.alias("trace"), template.alias("template"), w.alias("well"), direction.alias("direction"))))
    return _first(word, choices, F.lit(None).cast("struct<form:string,trace:string,template:string,well:string,direction:string>"))
