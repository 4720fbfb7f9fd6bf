import pytest

PROSE = "the river runs past the old mill and the miller counts his sacks before the first frost of the year"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} and {i % 31}" for i in range(6000))
    texts = {
        1: PROSE + " under the MIT License.",
        2: PROSE + " under the MIT License.",
        3: "",
        4: None,
        5: long,
        6: long + " tail",
        7: "x",
        8: "Licensed under the Apache License, Version 2.0, or CC BY-NC 4.0; under the MIT license",
        9: "naïve café — déjà vu, élève: " + PROSE.upper(),
        10: "\x00 \x0b\x0c\t\n\r  ",
        11: "a" * 300,
        12: "a" * 120,
    }
    rows = [(i, t, "en", None, None) for i, t in texts.items()]
    rows += [(2, texts[2], None, "s", 3), (2, texts[2], None, "s", 3), (None, texts[1], "en", "s", 1), (None, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = "batch fp component_id key k t y id row part slot shard length start number n_words n_bytes score labels places c0 l".split()
    for c in clash:
        df = df.withColumn(c, df.doc_id.cast("string"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
