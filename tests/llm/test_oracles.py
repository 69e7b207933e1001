"""The queries of the subpackage that have SQL against it, over the driver's tables and over odd ones."""

import duckdb
import pytest

from spanloom.llm import oracles, registry

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"Wört{k}" for k in range(70))
DOCS = [
    (1, PASSAGE + " Ende"),
    (2, "x" * 49 + " " + PASSAGE),
    (3, PASSAGE.replace("Wört5 ", "wort5 ") + "\n" + PASSAGE),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "Two WORDS"),
    (8, "two words"),
    (9, "y" * 500),
    (10, PASSAGE.upper()),
    (11, "z" + " ".join(f"{k}" for k in range(3000)) + "\x0b" + PASSAGE),
    (12, " ".join(f"{k}" for k in range(3000))),
]
PAGES = [(3, "a", "<p>é</p>"), (1, "b", "<p>é</p>"), (2, "c", None), (5, None, ""), (4, "d", "<p>e</p>")]


def same(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        files = f"{sf_dir}/{t}.parquet" + ("" if sf_dir == SF else "/*.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = registry.QUERIES[name](spark, str(sf_dir))
    assert sorted(df.columns) == sorted(columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    got, want = same(spark, name, SF)
    assert got == want and got


@pytest.mark.parametrize("name", ["op1_suffix_array", "op2_warc", "op4_simhash", "op10_suffix_tree"])
def test_odd_tables_match_too(spark, name, tmp_path):
    spark.createDataFrame(DOCS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, [0.5])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = same(spark, name, tmp_path)
    assert got == want and len(got) == (len(PAGES) if name == "op2_warc" else len(DOCS))


def test_the_hash_in_sql_is_xxh64():
    from xxhash import xxh64_intdigest

    texts = ["", "a", "é" * 2, "four", "eight by", "x" * 31, "y" * 32, "ß" * 33, "q" * 71, "0123456789" * 13]
    sql = f"SELECT h FROM (SELECT {oracles._xxh64(42)} FROM (SELECT hex(encode(t)) AS x, CAST(octet_length(encode(t)) AS BIGINT) AS n FROM (SELECT CAST(? AS VARCHAR) AS t)))"
    assert [duckdb.execute(sql, [t]).fetchone()[0] for t in texts] == [xxh64_intdigest(t.encode(), 42) for t in texts]
