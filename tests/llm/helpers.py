import duckdb

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def duck(sql, spark_dir=DIR):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{spark_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    return sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())


def plain(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
