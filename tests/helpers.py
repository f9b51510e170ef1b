"""Small wide tables as long frames and back."""


def cells(spark, table: dict[str, list[float]], ids=None, keep_zeros=False):
    n = len(next(iter(table.values())))
    ids = ids or [f"s{i + 1}" for i in range(n)]
    rows = [(ids[i], f, float(v[i])) for f, v in table.items() for i in range(n) if keep_zeros or v[i] != 0]
    return spark.createDataFrame(rows, "sample_id string, feature_id string, value double")


def wide(df, value="value"):
    """{feature: {sample: value}}"""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["feature_id"], {})[r["sample_id"]] = r[value]
    return out


def column(df, name, key="sample_id"):
    return {r[key]: r[name] for r in df.collect()}
