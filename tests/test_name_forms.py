from pyspark.sql import functions as F

from readloom.functions import name_forms as N


def test_directions(spark):
    names = ["k.TR.F", "a.xz-f9", "ABC12.x1", "ABC12.y1", "a_b.y22", "L12P34abgF.T0.scf", "G1P2RX.T9.scf", "k.f", "k.s", "nothing", "", None]
    df = spark.createDataFrame([(n, 1) for n in names], "name string, library_hint int").withColumn("p", N.read_direction(F.col("name")))
    got = {r.name: tuple(r.p) for r in df.collect()}
    assert got["k.TR.F"] == (0, "F", "k.TR.f", "k.TR.r") and got["a.xz-f9"] == (0, "F", "a.-f9", "a.-r9")
    assert got["ABC12.x1"] == (1, "F", "ABC12.f", "ABC12.r") and got["ABC12.y1"] == (1, "R", "ABC12.r", "ABC12.f")
    assert got["ABC12.x1"][2] == got["ABC12.y1"][3] and got["ABC12.x1"][3] == got["ABC12.y1"][2]
    assert got["L12P34abgF.T0.scf"][:2] == (4, "F") and got["G1P2RX.T9.scf"][:2] == (4, "R") and got["k.s"][:2] == (0, "F")
    assert got["nothing"] == (None, "", None, None) == got[""] == got[None]


def test_headers(spark):
    names = ["ABCDEFGHIJK0Z.R", "ABCDEFGHIJK0Z.F x", "ABCDEFGHIJK12R", "l_12_7-R2", "l_12_7/1 c", "m-44", "ABC", None]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("p", N.header(F.col("name"), N.file_prefix(F.lit("/d/run7_x.fasta")), base36=True))
    got = {r.name: r.p and tuple(r.p) for r in df.collect()}
    assert got["ABCDEFGHIJK0Z.R"] == ("454FR", "run7_ABCDEFGHIJK0Z.R", "run7_ABCDEFGHIJK0Z", "35", "R")
    assert got["ABCDEFGHIJK0Z.F x"][4] == "F" and got["ABCDEFGHIJK12R"] == ("454", "run7_ABCDEFGHIJK12R", "run7_ABCDEFGHIJK12R", str((36 + 2) * 36 + 27), "R")
    assert got["l_12_7-R2"] == ("illumina", "run7_l_12_7-R2", "run7_l_12_7", "12", "R") and got["l_12_7/1 c"] == ("illumina", "run7_l_12_7-R1", "run7_l_12_7", "12", "F")
    assert got["m-44"] == ("generic", "run7_m-44", "run7_m-44", "44", "F") and got["ABC"] is None and got[None] is None
