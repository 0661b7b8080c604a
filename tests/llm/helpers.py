"""Small tables with awkward rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside or give out.
CLASH = "size long, text_hash long, fingerprint string, start long, labels string, rank int, shard int, key string, target double, toxic int, bucket int"


def documents(spark, rows):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ") if c.split()[0] not in df.columns})


def rows(df, *names):
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
