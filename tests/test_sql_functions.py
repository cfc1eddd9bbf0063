from readloom.functions.sql import register_functions


def test_sql_functions(spark):
    assert "gc_count" in register_functions(spark)
    row = spark.sql("SELECT base_code('g') a, base_code('N') b, reverse_complement('AcgN') c, canonical_kmer('TTG') d, gc_count('GGCA') e, bare_name('>x/1 y') f, phred('!I') g, bare_name(NULL) h").first()
    assert tuple(row) == (2, -1, "NcgT", "CAA", 3, "x/1", [0, 40], None)
