"""Pages made of a small file's keys are worked on by all cores, and repeated labels keep their last value."""

from pyspark.sql import functions as F

from marketloom.operators import pages as operators
from marketloom.plans import registry, pages  # the registry first: it loads the plans


def test_pages_of_a_small_file_are_dealt_to_all_cores(spark):
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    for made in (pages.search_pages(t), pages.advert_pages(t)):
        tasks = made.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == t.part.count()


def test_labels(spark):
    box = lambda inner: f'<div data-testid="ad-parameters-container">{inner}</div>'
    rows = [(1, box("<p>Cor: Azul</p><p>Cor: Verde</p><p>Ano: 2.018</p><p>Modelo</p><p>Portas:</p><p>Condição: a:b</p>")), (2, "<html></html>")]
    found = {r.k: r for r in operators.listing_details(spark.createDataFrame(rows, "k long, html string"), "html").collect()}
    assert (found[1].color, found[1].year, found[1].model, found[1].doors, found[1].condition) == ("Verde", 2018, "Modelo", "", "a:b")
    assert found[2].color is None and found[2].price_eur is None and not [c for c in found[2].asDict() if c.startswith("_")]
