"""What the expressions of a record cost: nothing is computed again for each field, adapter or picture that asks for it."""

import time

from metaloom.operators import adapters, assets, plugins
from pyspark.sql import functions as F


def test_the_domain_is_read_once_for_all_adapters(spark):
    made = adapters.page_columns(adapters.DEFAULT)
    assert "final_url" not in str(made["site_adapter"]) + str(made["site_fits"]) and str(made["site_fits"]).count("site_domain") > 8


def test_the_row_of_a_plugin_is_looked_up_once(spark):
    assert str(plugins.result_of("mine")).count("plugin_rows") == 1


def test_many_pictures_of_a_page_are_compared_once(spark):
    n = 300
    urls = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: assets.asset(F.concat(F.lit("https://e.example.com/a/"), F.floor(i / 2).cast("string"), F.when(i % 2 == 0, ".jpg").otherwise("-300x200.jpg")), "image", "html"))
    pages = spark.range(4).select(F.col("id"), urls.alias("images")).repartition(4)
    began = time.time()
    rows = pages.select(F.size(assets.merged(F.col("images"))).alias("merged"), assets.scored(F.col("images")).alias("s")).collect()
    assert time.time() - began < 30
    for r in rows:
        assert (r.merged, len(r.s)) == (n // 2, n) and all(any("URL group subtracted 4" in x for x in p.reasons) for p in r.s)
        assert [p.url for p in r.s[:2]] == ["https://e.example.com/a/0.jpg", "https://e.example.com/a/0-300x200.jpg"]


def test_media_are_merged_again_only_if_others_give_some(spark):
    """Adapters and plugins without media leave what was found, and a page without cards searches none."""
    from metaloom.operators import record
    from metaloom.plans.api import Engine

    assert "exists(ext" in str(record._again()["media"]) and str(record._tags()["card"]).startswith("Column<'CASE WHEN =(size(card_raw)")
    rows = [(1, "https://www.facebook.com/page", '<meta property="og:title" content="T">'), (2, "https://www.facebook.com/page", '<meta property="og:image" content="/b.jpg"><meta name="twitter:title" content="C">')]
    found = {r.id: r for r in Engine().parse(spark.createDataFrame(rows, "id int, url string, html string")).select("id", "title", "type", "best_image", "images", "videos", "audio").collect()}
    assert (found[1].title, found[1].type, found[1].best_image, found[1].images, found[1].videos, found[1].audio) == ("T", "website", None, [], [], [])
    assert (found[2].title, found[2].type, found[2].best_image, found[2].images[0].source) == ("C", "social_post", "https://www.facebook.com/b.jpg", "openGraph")
