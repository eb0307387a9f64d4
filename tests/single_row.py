"""Column expressions worked out on one row."""


def one(spark, **columns):
    """Values of column expressions on a single row."""
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()
