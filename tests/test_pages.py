"""Pages are read whole, in the four readings of the collectors."""

from pyspark.sql import functions as F

from lamplight.plans import policy_queries

PAGE = (
    "<html><head><title>The &amp;amp; old harbour</title><style>p{}</style></head><body><nav><a href='/home'>Home  page</a></nav>"
    "<p>one &amp;lt; two</p><noscript>unseen</noscript><p>see <a href='/l' title='t'>the <i>list</i></a></p><a href='/open'>open<form><p>field</p></form></body></html>"
)


def test_page_query_gives_texts_and_links_of_all_readings(spark, tmp_path):
    rows = [(1, PAGE), (2, None), (3, "<main><p>" + "</p><p>".join(f"line {i}" for i in range(3000)) + "</p></main>"), (4, "".join(f"<a href='/{i}'>n{i}</a>" for i in range(500)))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in policy_queries.page_visible_text(spark, str(tmp_path)).collect()}
    first = found[1]
    assert (first.title, first.text) == ("The &amp; old harbour", "The &amp; old harbour\none &lt; two\nunseen\nsee the list\nopen")
    assert [tuple(x) for x in first.links] == [("/home", ""), ("/l", "t"), ("/open", "")]
    assert (first.collected.title, first.collected.text) == ("The & old harbour", "The & old harbour Home page one < two see the list open field")
    assert [tuple(x) for x in first.collected.links] == [("/home", "Home page"), ("/l", "the list")]
    assert tuple(first.metadata) == ("The &amp; old harbour", "The & old harbour one < two see the list open")
    assert (first.batch.title, first.batch.text, [tuple(x) for x in first.batch.links]) == ("The & old harbour", "one < two see the list open", [("/l", "the list")])
    assert (found[2].text, found[2].links, found[2].collected.text, found[2].batch.links) == ("", [], "", [])
    assert found[3].text == "\n".join(f"line {i}" for i in range(3000)) and found[3].metadata.text == found[3].text.replace("\n", " ")
    assert found[4].collected.links == found[4].batch.links and [tuple(x) for x in found[4].batch.links] == [(f"/{i}", f"n{i}") for i in range(500)]


def test_page_query_gives_the_lengths_of_what_it_gives(spark, folder):
    found = policy_queries.page_visible_text(spark, folder)
    assert found.where((F.length("text") != F.col("n_chars")) | (F.size("links") != F.col("n_links"))).count() == 0
    assert found.count() == spark.read.parquet(f"{folder}/pages.parquet").count()
