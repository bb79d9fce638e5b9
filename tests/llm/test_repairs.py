"""Rows that differ only in where a null stands, nested columns in mixing, comments in article elements."""

import math

from pyspark.sql import functions as F

from ledgerloom.llm.html_text import Page
from ledgerloom.llm.mixing import mixed_documents, row_key


def test_mixing_loses_no_row_that_differs_in_nulls(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(7, "a b c", "x", None, 5), (7, "a b c", None, "x", 5), (7, "a b c", None, None, 5), (8, "d e f", "x", "y", None), (8, "d e f", "x", "y", 5)]
    out = mixed_documents(spark.createDataFrame(rows, kind)).collect()
    assert {tuple(r)[2:4] + (r["doc_id"],) for r in out} == {(r[2], r[3], r[0]) for r in rows}
    key, check = row_key(spark.createDataFrame(rows, kind))
    assert spark.createDataFrame(rows, kind).select(key.alias("k"), check.alias("c")).distinct().count() == len(rows)


def test_row_key_tells_nested_nulls_and_takes_maps(spark):
    df = spark.sql("""select * from values
        (1, named_struct('a', 1, 'b', cast(null as int)), map('k', 'v')), (1, named_struct('a', cast(null as int), 'b', 1), map('k', 'v')),
        (1, named_struct('a', 1, 'b', cast(null as int)), map('k', cast(null as string))), (1, cast(null as struct<a:int,b:int>), map('k', 'v')) as t(id, s, m)""")
    key, check = row_key(df)
    assert df.select(key.alias("k"), check.alias("c")).distinct().count() == 4


def test_mixing_takes_map_columns(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 5, "en", "s", 10) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"tags": F.create_map(F.lit("k"), F.col("doc_id")), "mix_size": F.array(F.lit(None).cast("int"))})
    out = mixed_documents(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(range(6))


def text_of(source):
    return Page(source).text(lambda h: False)


def test_comments_in_article_elements_go():
    assert text_of('<article><p>real</p></article><article class="comment"><p>reader says</p></article>') == "real"
    assert text_of('<article><p>real</p><article class="comment">one</article><article role="comment">two</article></article>') == "real"
    assert text_of('<article id="comments-12"><p>x</p></article><article><h1>T</h1></article>') == "T"
    assert text_of('<article class="post commentary"><p>kept</p></article>') == "kept"


def test_nothing_else_in_an_article_goes_by_name():
    inside = '<p class="related">a</p><p class="share">b</p><div class="search">c</div><section class="recommended"><p>d</p></section>'
    assert text_of(f"<article>{inside}</article>") == "a b c d"
    assert text_of('<article><p>x</p><div class="ad">buy</div><div class="comments"><p>me too</p></div><p class="advert">now</p><div class="sidebar">s</div></article>') == "x"
    assert text_of('<body><p>x</p><div class="search">go</div><div class="related">more</div></body>') == "x"


def test_cells_are_used_on_the_given_vectors(spark):
    """Every label comes apart, every vector lives in one cell and visits few of the others."""
    from ledgerloom.llm import near_vectors as V

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    nodes = V.stored(V.distinct_vectors(rows.where(V.usable("v") & F.col("label").isNotNull()).withColumn("dim", F.size("v"))), "vectors")
    placed = V._cells(nodes, math.sqrt(2 - 2 * 0.98)).join(nodes.select("id", "label"), "id")
    by_label = placed.groupBy("label").agg(F.count_distinct("cell").alias("cells"), F.count_if("home").alias("homes"), F.count("*").alias("seen"), F.count_distinct("id").alias("n")).collect()
    assert all(r["cells"] >= 5 and r["homes"] == r["n"] for r in by_label)
    assert sum(r["seen"] for r in by_label) < 0.8 * sum(r["n"] * r["cells"] for r in by_label)
    print([(r["cells"], r["n"], round(r["seen"] / r["n"], 2)) for r in by_label])


def test_a_vector_with_a_third_of_the_rows(spark):
    from ledgerloom.llm.near_vectors import near_vectors

    rows = [(k, [1.0, 0.0] if k % 3 == 0 else [math.cos(0.37 * k), math.sin(0.37 * k)], 1) for k in range(150)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    for a, v, _ in rows:
        links = sum(1 for b, w, _ in rows if a != b and v[0] * w[0] + v[1] * w[1] >= 0.98)
        assert got[a]["n_links"] == links
    assert got[3]["component_id"] == 0 and not got[3]["kept"]
