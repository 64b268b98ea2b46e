"""What users call: pages to records, records to preview cards, extension points.

    engine = Engine()
    records = engine.parse(pages)          # pages: url, html and any other columns
    cards = preview_cards(records)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from metaloom.functions.bound import bound
from metaloom.functions.urls import domain_of
from metaloom.operators import adapters, assets, plugins
from metaloom.operators.record import with_fields, with_media, with_tags
from metaloom.sources.pages import scan

RAW = ("og", "og_raw", "card", "card_raw", "html", "jsonld", "jsonld_warnings", "embedded", "embedded_warnings", "oembed_links", "dom_images", "dom_videos", "dom_audio", "adapter_results", "plugin_results")
_shared: list = []


class Registry:
    """Where plugins put what they add."""

    def __init__(self):
        self.adapters = list(adapters.DEFAULT)
        self.extractors: list[tuple[str, Callable[[], Column]]] = []
        self.scorers: list[Callable[[Column, Column, Column], Column]] = []
        self.functions: list[plugins.Function] = []

    def add_adapter(self, name: str, detect: Callable[[Column], Column], extract: Callable[[adapters.Page], Column]) -> None:
        """detect: a condition on the URL; extract: a result (see adapters.result) from a page's columns."""
        self.adapters.append((name, detect, extract))

    def add_extractor(self, name: str, extract: Callable[[], Column]) -> None:
        """extract: a result from the scan's and the tags' columns, null where it has nothing."""
        self.extractors.append((name, extract))

    def add_page_function(self, name: str, function: Callable[[dict], dict | None]) -> None:
        """function: a Python function of one page (see metaloom.operators.plugins), whose errors cost that page a warning."""
        self.functions.append(("Plugin extractor", name, function))
        self.extractors.append((name, lambda: plugins.result_of(name)))

    def add_page_adapter(self, name: str, detect: Callable[[Column], Column], function: Callable[[dict], dict | None]) -> None:
        """The same as an adapter, whose result counts where detect holds; the function may return None at once elsewhere."""
        self.functions.append(("Adapter", name, function))
        self.adapters.append((name, detect, lambda page: plugins.result_of(name)))

    def add_image_scorer(self, scorer: Callable[[Column, Column, Column], Column]) -> None:
        """scorer: points for (asset, index, all assets), added to the score."""
        self.scorers.append(scorer)


class Engine:
    """Parses pages with the default adapters and the plugins it is given; a plugin is (name, function of a Registry)."""

    def __init__(self, plugins: Iterable[tuple[str, Callable[[Registry], None]]] = (), include_raw: bool = False):
        self.plugins, self.include_raw = list(plugins), include_raw

    @staticmethod
    def use_everywhere(name: str, setup: Callable[[Registry], None]) -> None:
        """For all engines; a name counts once."""
        if name not in [n for n, _ in _shared]:
            _shared.append((name, setup))

    def use(self, name: str, setup: Callable[[Registry], None]) -> Engine:
        if name not in [n for n, _ in self.plugins]:
            self.plugins.append((name, setup))
        return self

    def parse(self, pages: DataFrame, oembed: DataFrame | None = None) -> DataFrame:
        """One record for each row of pages (url, html, more). A URL that isn't http(s) gives ok = false.

        oembed (href, body) holds documents that oEmbed links lead to; links without a usable one cost a warning.
        """
        registry, warnings, results = Registry(), [], []
        for _, setup in [*_shared, *self.plugins]:
            setup(registry)
        for name, extract in registry.extractors:  # a plugin that can't be planned costs a warning, not the run
            try:
                made = extract()
                results.append(bound(made, lambda r: F.when(r.isNotNull(), r.cast(adapters.RESULT).withField("source", F.coalesce(r["source"], F.lit(name))))))  # noqa: B023
            except Exception as e:  # noqa: BLE001
                warnings.append(f'Plugin extractor "{name}" failed: {e}')
        functions = tuple(registry.functions)
        more = (plugins.SCHEMA, lambda page: plugins.run(functions, page)) if functions else None
        tagged = with_tags(scan(pages.withColumnsRenamed({c: f"in_{c}" for c in pages.columns if c not in ("url", "html")}), more=more))
        if oembed is not None:
            tagged = _with_oembed(tagged, oembed)
        found = with_fields(with_media(tagged, registry.adapters, results, tuple(registry.scorers)), warnings, ["plugin_warnings"] if functions else [])
        kept = [F.col(f"in_{c}").alias(c) for c in pages.columns if c not in ("url", "html")]
        diagnostics = F.struct(
            F.col("url").alias("originalUrl"), F.col("final_url").alias("finalUrl"), F.col("canonical_url").alias("canonicalUrl"), F.col("sources_used").alias("sourcesUsed"), "warnings", "adapter",
            F.get("adapter_results", F.lit(0)).source.alias("adapterUsed"), F.col("method").alias("extractionMethod"), assets.choice(F.col("best")).alias("selectedImageReason"), F.col("confidence_breakdown").alias("confidenceBreakdown"),
        )
        ok = F.col("final_url").isNotNull()
        fields = [
            ok.alias("ok"), "url", "final_url", F.when(ok, F.col("type")).otherwise("unknown").alias("type"), "title", "description", "publish_date", "site_name", "canonical_url",
            *[F.when(ok, F.col(c)).otherwise(0).alias(c) for c in ("confidence", "completeness", "reliability")], F.col("best.url").alias("best_image"), F.col("pictures").alias("images"),
            F.col("media.videos").alias("videos"), F.col("media.audio").alias("audio"), F.col("html.favicons").alias("favicons"), "article", "product", "video", "playlist", "author", "publisher", "app", "sources",
            diagnostics.alias("diagnostics"), "trace", F.when(~ok, F.lit("Invalid or unsupported URL")).alias("error"),
        ]
        raw = [F.struct(*RAW).alias("raw")] if self.include_raw else []
        return found.select(*kept, *fields, *raw)


def _with_oembed(tagged: DataFrame, oembed: DataFrame) -> DataFrame:
    """Pictures of the documents behind a page's oEmbed links, in the order of the links, and a warning for each link without one.

    Of several documents for one href the one with the smallest hash counts. Links and pages meet by a hash of the page's columns,
    which stays the same when a task runs again; pages equal in all of them share their documents.
    """
    fields = "type string, url string, width double, height double, thumbnail_url string, thumbnail_width double, thumbnail_height double"
    row = F.to_json(F.struct("url", "oembed_links", *[c for c in tagged.columns if c.startswith("in_")]))
    keyed = tagged.withColumn("_row", F.struct(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")))
    links = keyed.where(F.size("oembed_links") > 0).select("_row", F.posexplode("oembed_links").alias("_at", "_link")).dropDuplicates(["_row", "_at"])
    docs = oembed.groupBy(F.col("href").alias("_href")).agg(F.min_by("body", F.xxhash64("body")).alias("_body"))
    json = F.col("_link.type").isNull() | F.lower("_link.type").contains("json")
    failed = lambda why: F.concat(F.lit("Could not fetch oEmbed endpoint "), F.col("_link.href"), F.lit(why))
    warning = (
        F.when(~json, F.concat(F.lit("Skipping non-JSON oEmbed endpoint: "), F.col("_link.href"), F.lit(".")))
        .when(F.col("_body").isNull(), failed(": no response"))
        .when(F.try_parse_json("_body").isNull(), failed(": the response is not JSON"))
    )
    got = links.join(docs, F.col("_link.href") == F.col("_href"), "left").withColumn("_warning", warning).withColumn("d", F.when(F.col("_warning").isNull(), F.from_json("_body", fields)))
    thumb = F.when(F.col("d.thumbnail_url").isNotNull(), assets.asset(F.col("d.thumbnail_url"), "image", "oEmbed", width=F.col("d.thumbnail_width"), height=F.col("d.thumbnail_height")))
    photo = F.when((F.col("d.type") == "photo") & F.col("d.url").isNotNull(), assets.asset(F.col("d.url"), "image", "oEmbed", width=F.col("d.width"), height=F.col("d.height")))
    both = got.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.filter(F.array(thumb, photo), lambda a: a.isNotNull()).alias("a"), "_warning"))).alias("l"))
    told = both.select("_row", F.flatten(F.transform("l", lambda x: x.a)).alias("oembed_images"), F.filter(F.transform("l", lambda x: x._warning), lambda w: w.isNotNull()).alias("oembed_warnings"))
    found = keyed.join(told, "_row", "left").drop("_row")
    return found.withColumns({"oembed_images": F.coalesce("oembed_images", assets.none()), "oembed_warnings": F.coalesce("oembed_warnings", F.array().cast("array<string>"))})


def preview_cards(records: DataFrame, *keep: str) -> DataFrame:
    """The nine fields of a link preview."""
    url = F.coalesce("canonical_url", "final_url")
    return records.select(*keep, "title", "description", F.col("best_image").alias("image"), url.alias("url"), F.col("site_name").alias("siteName"), domain_of(url).alias("domain"), F.col("author.name").alias("author"), "type", "confidence")


#: Lists that stay in a stripped record when they are empty.
KEPT = ("images", "videos", "audio", "favicons", "trace")


def stripped_json(records: DataFrame, *columns: str) -> Column:
    """The record as JSON without nulls and empty lists, but for those of media and of the trace."""
    names = columns or records.columns
    return F.to_json(F.struct(*[_stripped(F.col(c), records.schema[c].dataType, c in KEPT).alias(c) for c in names]))


def _stripped(c: Column, kind: DataType, keep: bool = False) -> Column:
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_stripped(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        inner = F.transform(c, lambda x: _stripped(x, kind.elementType)) if isinstance(kind.elementType, (StructType, ArrayType)) else c
        return F.coalesce(inner, F.array().cast(kind)) if keep else F.when(F.size(c) > 0, inner)
    return c
