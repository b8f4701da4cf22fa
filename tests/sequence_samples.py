"""Small tables of sequences for the tests; a module of its own name, as every folder of tests has a conftest."""


def sources(spark, *seqs):
    """(src_id, name, seq) of the sequences given."""
    return spark.createDataFrame([(i, f"n{i}", s) for i, s in enumerate(seqs)], "src_id long, name string, seq string")


def asked(spark, **seqs):
    return spark.createDataFrame(list(seqs.items()), "name string, seq string")
