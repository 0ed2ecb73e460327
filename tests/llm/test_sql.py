"""The queries that SQL can say return the rows that DuckDB does."""

import random

import pytest

from coursemill.llm import queries
from tests import twins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_and_sql_agree(spark, name):
    assert twins.difference(spark, twins.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_sql_on_copies(spark, tmp_path):
    r = random.Random(6)
    pages = [(i, f"http://x/{i}", r.choice([None, "", "<p>a</p>", f"<p>é{i % 7}</p>"])) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in"))
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(8)]
    vecs = [(i, r.choice([None, [0.0] * 16, [float("nan")] * 16] + [[x + r.gauss(0, 0.02) for x in base[i % 8]]] * 12)) for i in range(80)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "vec"))
    docs = [(i % 50, r.choice([None, "", "  ", "<P>", "a <M> b", *("".join(r.choice("ab é日\n\t.😀") for _ in range(r.randint(1, 60))) for _ in range(20))])) for i in range(120)]
    spark.createDataFrame([*docs, (None, "no id here")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "doc"))
    for folder, name in (("in", "pages"), ("vec", "embeddings"), ("doc", "documents")):
        next((tmp_path / folder).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    con = twins.connect(str(tmp_path))
    for name, sql in queries.oracle_sql().items():
        assert twins.difference(spark, con, queries.queries()[name], sql, str(tmp_path)) == ""
