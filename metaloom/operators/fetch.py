"""Fetching, replayed from tables: redirects, address checks, direct media, providers that block, and strategies for Reddit.

responses has request_url, status, location, content_type, body (text) and may have bytes, retry_after, error and fetched_at; of several
for one URL the latest counts (without fetched_at the one with the lowest status). dns has host and address. Both come
from a crawler, or from metaloom.sources.live once its rows are written: a plan that fetched while it is used repeats requests whenever a task is retried.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from metaloom.functions import images, urls
from metaloom.functions.http import decode_body
from metaloom.functions.js import rounded, squashed
from metaloom.functions.shared import Scratch
from metaloom.functions.ship import ship
from metaloom.sources.reddit import page_of

REDIRECTS, MOST_REDIRECTS, MOST_BYTES = (301, 302, 303, 307, 308), 5, 2_000_000
HOP = "struct<from:string,to:string,status:int>"
INVALID = "Invalid or unsupported URL"


def latest(responses: DataFrame) -> DataFrame:
    """One answer for each request URL, without its body: request_url, status, location, error and two hashes that tell its row.

    Only hashes of bodies are compared, so no body is sorted or moved.
    """
    columns = responses.columns
    error = F.col("error") if "error" in columns else F.lit(None).cast("string")
    rows = responses.select("request_url", "status", "location", error.alias("error"), (F.col("fetched_at") if "fetched_at" in columns else F.lit(None)).alias("_at"), F.xxhash64("body").alias("_b"), *_row_keys(responses))
    order = [F.col("_at").desc_nulls_last(), F.col("status").asc_nulls_last(), F.col("location").asc_nulls_last(), F.col("_b"), F.col("_k1"), F.col("_k2")]
    first = F.row_number().over(Window.partitionBy("request_url").orderBy(*order))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first", "_at", "_b")


def _row_keys(responses: DataFrame) -> list[Column]:
    """Two hashes of a response's columns: rows that agree in both are equal."""
    columns = sorted(c for c in ("request_url", "status", "location", "content_type", "body", "bytes", "retry_after", "error", "fetched_at") if c in responses.columns)
    told = [x for c in columns for x in (F.col(c), F.isnull(c))]
    return [F.xxhash64(*told).alias("_k1"), F.xxhash64(F.lit(1), *told).alias("_k2")]


def guarded(wanted: DataFrame, dns: DataFrame | None = None, allow_local: bool = False, allow_private: bool = False) -> DataFrame:
    """Adds blocked: why a URL must not be requested, null if it may. All of a name's addresses must be public, and there must be one.

    Without dns names aren't looked up; protocols, local names and addresses in URLs are checked all the same.
    """
    host = F.regexp_replace(urls.host_of(F.col("url")), r"^\[|\]$", "")
    joined = wanted.withColumn("_h", host)
    if dns is None:
        joined = joined.withColumns({"_host": F.lit(None).cast("string"), "_addresses": F.lit(None).cast("array<string>")})
    else:
        known = dns.where("address IS NOT NULL").groupBy(F.lower("host").alias("_host")).agg(F.array_sort(F.collect_set("address")).alias("_addresses"))
        joined = joined.join(known, F.col("_h") == F.col("_host"), "left")
    literal = F.col("_h").rlike(r"^[0-9.]+$|:")

    def refused(address: Column) -> Column:
        kind = urls.ip_class(address)
        why = F.when((kind == "loopback") & F.lit(not allow_local), F.concat(F.lit("Loopback address is blocked: "), address))
        return why.when(~kind.isin("public", "loopback") & F.lit(not allow_private), F.concat(F.lit("Private or reserved network address is blocked: "), address))

    each = F.transform(F.coalesce("_addresses", F.array().cast("array<string>")), refused)
    blocked = (
        F.when(~F.lower("url").rlike("^https?:"), "Unsupported URL protocol")
        .when(urls.is_local_name(F.col("_h")) & F.lit(not allow_local), "Localhost URLs are blocked by default.")
        .when(literal, refused(F.col("_h")))
        .when(F.lit(dns is not None and not (allow_local and allow_private)) & F.col("_host").isNull(), F.concat(F.lit("No address is known for "), F.coalesce("_h", F.lit(""))))
        .otherwise(F.get(F.filter(each, lambda x: x.isNotNull()), 0))
    )
    return joined.withColumn("blocked", blocked).drop("_h", "_host", "_addresses")


def frontier(starts: DataFrame, answers: DataFrame, scratch: Scratch, most: int = MOST_REDIRECTS, dns: DataFrame | None = None, allow_local: bool = False, allow_private: bool = False) -> DataFrame:
    """Where each of starts (start, a distinct normalised URL) ends: start, final_url, redirects, error, and the hashes of the last answer (see latest()).

    A hop joins what is still open with the answers: starts, URLs and the way so far, no body. What has ended is written apart and takes no
    part in later hops, which are as many as the longest chain has, most + 1 at the most. A cycle ends as any chain that is too long.
    """
    open_ = starts.select("start", F.col("start").alias("url"), F.array().cast(f"array<{HOP}>").alias("redirects"))
    ended: list[DataFrame] = []
    for hop in range(most + 1):
        checked = guarded(open_, dns, allow_local, allow_private)
        known = answers.select(F.col("request_url").alias("_q"), "status", "location", "error", "_k1", "_k2")
        joined = checked.join(known.hint("merge"), F.col("blocked").isNull() & (F.col("url") == F.col("_q")), "left")  # a merge join, as a hot target can be split then
        moves = F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False))
        failed = (
            F.when(F.col("blocked").isNotNull(), F.col("blocked"))
            .when(F.col("_q").isNull(), F.concat(F.lit("No response for "), F.col("url")))
            .when(moves & F.col("location").isNull(), F.concat(F.lit("Redirect response from "), F.col("url"), F.lit(" did not include a Location header.")))
            .when(moves & F.lit(hop == most), F.lit(f"Too many redirects. Maximum allowed redirects: {most}."))
            .when(moves & F.col("to").isNull(), F.lit(INVALID))
            .when(~moves, F.col("error"))
        )
        told = joined.withColumn("to", F.when(moves & F.col("location").isNotNull(), urls.resolve_url("location", "url"))).withColumn("failed", failed)
        state = scratch.cut(told.select("start", "url", "redirects", "status", F.when(moves & F.col("failed").isNull(), F.col("to")).alias("to"), "failed", "_k1", "_k2"))
        fine = F.col("failed").isNull()
        ended.append(state.where("to IS NULL").select("start", F.when(fine, F.col("url")).alias("final_url"), "redirects", F.col("failed").alias("error"), *[F.when(fine, F.col(k)).alias(k) for k in ("_k1", "_k2")]))
        step = F.struct(F.col("url").alias("from"), "to", "status").cast(HOP)
        open_ = state.where("to IS NOT NULL").select("start", F.col("to").alias("url"), F.concat("redirects", F.array(step)).alias("redirects"))
        if open_.isEmpty():
            break
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return found


def follow(wanted: DataFrame, responses: DataFrame, most: int = MOST_REDIRECTS, dns: DataFrame | None = None, allow_local: bool = False, allow_private: bool = False) -> DataFrame:
    """Adds final_url, redirects, status, content_type, body and error to wanted (url, more).

    Each distinct URL is followed once, by frontier(); bodies are joined once, at the end. Every hop's target is checked by guarded(), names with
    dns only. Responses may have error, which ends a row when it is reached, and bytes and retry_after, which are added too. Every row of wanted gives
    one row. Narrow tables are written to the shared folder when this is called; the one that the result reads stays.
    """
    spark = wanted.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    asked = wanted.withColumn("_start", urls.normalize_url_once("url"))
    answers = scratch.cut(latest(responses))
    starts = asked.where("_start IS NOT NULL").select(F.col("_start").alias("start")).distinct()
    ended = scratch.cut(frontier(starts, answers, scratch, most, dns, allow_local, allow_private))
    scratch.release(ended)
    more = {c: k for c, k in (("bytes", "binary"), ("retry_after", "string")) if c in responses.columns}
    body = {"status": "int", "content_type": "string", "body": "string", **more}
    chosen = ended.where("_k1 IS NOT NULL").select(F.col("final_url").alias("request_url"), "_k1", "_k2").distinct()
    bodies = responses.select("request_url", *body, *_row_keys(responses)).join(chosen, ["request_url", "_k1", "_k2"], "left_semi").dropDuplicates(["request_url", "_k1", "_k2"])
    bodies = bodies.select(F.col("request_url").alias("_q"), F.col("_k1").alias("_q1"), F.col("_k2").alias("_q2"), *[F.col(c).cast(k).alias(c) for c, k in body.items()])
    rest = [c for c in wanted.columns if c not in ("final_url", "redirects", "error", *body)]
    told = ended.withColumnRenamed("start", "_begun")  # the caller may have a start
    good = asked.where("_start IS NOT NULL").select(*rest, "_start").join(told.hint("merge"), F.col("_start") == F.col("_begun"))
    good = good.join(bodies.hint("merge"), (F.col("final_url") == F.col("_q")) & (F.col("_k1") == F.col("_q1")) & (F.col("_k2") == F.col("_q2")), "left")
    bad = asked.where("_start IS NULL").select(*rest, F.lit(None).cast("string").alias("final_url"), F.array().cast(f"array<{HOP}>").alias("redirects"), *[F.lit(None).cast(k).alias(c) for c, k in body.items()], F.lit(INVALID).alias("error"))
    columns = [*rest, "final_url", "redirects", "status", "content_type", "body", "error", *more]
    return good.select(*columns).unionByName(bad.select(*columns))


def split_by_cache(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of wanted (url, more) that a cache of pages (url, html, final_url, status, content_type) answers, and those to be fetched.

    Both sides are compared by their normalised URLs; an entry without a status counts as 200.
    """
    ship(wanted.sparkSession)
    known = cache.select(urls.normalize_url("url").alias("_u"), "html", "final_url", F.coalesce("status", F.lit(200)).alias("status"), "content_type")
    known = known.withColumn("_i", F.row_number().over(Window.partitionBy("_u").orderBy(F.col("status"), F.col("final_url").asc_nulls_last(), F.xxhash64("html")))).where("_i = 1").drop("_i")
    asked = wanted.withColumn("_u", urls.normalize_url("url"))
    return asked.join(known, "_u").drop("_u"), asked.join(known, "_u", "left_anti").drop("_u")


def cache_rows(followed: DataFrame) -> DataFrame:
    """What is to be appended to the cache after follow(): answers that ended without an error."""
    return followed.where("error IS NULL AND status IS NOT NULL").select(urls.normalize_url("url").alias("url"), F.col("body").alias("html"), "final_url", "status", "content_type", "redirects")


def limited(responses: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Responses with bodies above the limit turned into errors."""
    texts = [c for c in ("body", "bytes") if c in responses.columns]
    large = F.greatest(F.lit(0), *[F.octet_length(c) for c in texts]) > most_bytes
    return responses.withColumns({"error": F.when(large, f"Response body exceeds {most_bytes} bytes."), **{c: F.when(~large, F.col(c)) for c in texts}})


def direct_media(url: Column, content_type: Column, data: Column) -> Column:
    """What is known of a URL that is a picture, video or sound itself, by content type or by extension; null for pages."""
    kind_of, low = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(url)
    ends = lambda *e: low.rlike(r"\.(?:" + "|".join(e) + r")(?:[?#].*)?$")
    kind = (
        F.when(F.startswith(kind_of, F.lit("image/")) | ends("avif", "webp", "png", "jpe?g", "gif"), "image")
        .when(F.startswith(kind_of, F.lit("video/")) | ends("mp4", "webm", "m3u8", "mov"), "video")
        .when(F.startswith(kind_of, F.lit("audio/")) | ends("mp3", "m4a", "wav", "ogg", "aac"), "audio")
    )
    stated = F.struct(urls.url_dimension(url, "width").alias("w"), urls.url_dimension(url, "height").alias("h"))
    picture = kind == "image"
    read = images.dimensions(F.when(picture, data), content_type)
    width, height = (F.when(picture, F.coalesce(a.cast("double"), F.when(stated.w.isNotNull() & stated.h.isNotNull(), b))) for a, b in ((read.width, stated.w), (read.height, stated.h)))
    confidence = F.when(picture, 82).otherwise(70)
    completeness = F.when(picture, F.when(width.isNotNull() & height.isNotNull(), 60).otherwise(45)).otherwise(35)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), url.alias("url"), confidence.alias("confidence"), completeness.alias("completeness"), rounded((confidence + completeness) / 2).alias("reliability"), width.alias("width"), height.alias("height")))


def block_reason(status: Column, html: Column) -> Column:
    """Why a provider's answer is no content, null if it is; phrases count wherever they stand in the body."""
    return _reason(status, *_said(html))


def _said(html: Column) -> tuple[Column, Column]:
    """Title and text of an answer."""
    title = F.coalesce(squashed(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]*>", " ")), F.lit(""))
    return title, F.coalesce(squashed(F.regexp_replace(html, "<[^>]*>", " ")), F.lit(""))


def _reason(status: Column, title: Column, text: Column) -> Column:
    verify = title.rlike(r"(?i)reddit\s*-\s*please wait for verification") | text.rlike("(?i)please wait for verification|verification required|verify you are human")
    phrases = text.rlike("(?i)whoa there, pardner|request has been blocked|too many requests|forbidden|you're blocked|you are blocked|youre blocked|blocked by network security")
    return F.when(verify, "provider_verification_required").when(status.isin(403, 429) | phrases | title.rlike("(?i)^blocked$"), "provider_blocked_request")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Seconds, or the time until a date; null for anything else."""
    seconds = F.nullif(F.regexp_extract(value, r"^\s*(\d+)", 1), F.lit("")).try_cast("bigint")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w+, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.coalesce(seconds * 1000, F.when(date.isNotNull(), F.greatest(F.unix_millis(date) - F.unix_millis(now), F.lit(0))))


def reddit_urls(url: Column) -> tuple[Column, Column]:
    """A post's JSON endpoint and its page on the old site."""
    return _endpoints(urls.domain_of(url), F.regexp_replace(urls.path_of(url), "/$", ""))


def _endpoints(domain: Column, path: Column) -> tuple[Column, Column]:
    short = domain == "redd.it"
    post = F.when(short, F.concat(F.lit("/comments"), path)).otherwise(path)
    return F.when(short | F.contains(path, F.lit("/comments/")), F.concat(F.lit("https://www.reddit.com"), post, F.lit(".json"))), F.concat(F.lit("https://old.reddit.com"), post)


@F.pandas_udf(StringType())
def listing_page(body: pd.Series) -> pd.Series:
    return pd.Series([page_of(b) for b in body], dtype=object)


#: Fixed value: what a user can do about a provider that blocks.
SUGGESTED = "retry_on_different_host_or_use_supported_proxy"


def provider_of(attempts: Column) -> Column:
    """The provider that blocked attempts, by the first that asks for verification, else the last; null if none was blocked."""
    blocked = F.filter(attempts, lambda a: a.blocked.isNotNull())
    chosen = F.coalesce(F.get(F.filter(blocked, lambda a: a.blocked == "provider_verification_required"), F.lit(0)), F.try_element_at(blocked, F.lit(-1)))
    return F.when(chosen.isNotNull(), F.struct(F.lit("reddit").alias("platform"), F.lit(True).alias("blocked"), chosen.status.alias("statusCode"), chosen.blocked.alias("reason"), F.lit(SUGGESTED).alias("suggestedAction")))


def retry_of(attempts: Column) -> Column:
    """Whether and when to try again, after attempts that were blocked; null if none was."""
    failed = F.filter(attempts, lambda a: a.blocked.isNotNull() | a.status.isin(403, 429))
    after = F.get(F.filter(F.transform(failed, lambda a: a.retry_after), lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))
    said = F.transform(failed, lambda a: F.concat(a.how, F.when(a.status.isNotNull(), F.concat(F.lit(" returned "), a.status.cast("string"))).otherwise(" failed")))
    again = F.exists(failed, lambda a: F.coalesce(a.status == 429, F.lit(False)) | (F.coalesce(a.retry_after, F.lit("")) != ""))
    made = F.struct(again.alias("retryable"), F.array_join(said, "; ").alias("reason"), after.alias("retryAfter"), retry_after_ms(after, F.current_timestamp()).alias("retryAfterMs"), F.size(attempts).alias("attempts"))
    return F.when(F.size(failed) > 0, made)


def records(wanted: DataFrame, responses: DataFrame, engine=None, cache: DataFrame | None = None, most_bytes: int = MOST_BYTES, dns: DataFrame | None = None, allow_local: bool = False, allow_private: bool = False) -> DataFrame:
    """Records of wanted (url, more) from replayed responses.

    Reddit posts are tried as JSON, on the old site and as they are; the first answer with content counts. Blocked and failed
    ones become records without content, pictures, videos and sounds records of themselves; everything else is parsed.

    What a cache (as in split_by_cache, and redirects if it has them) answers counts instead of responses. Bodies above most_bytes
    are errors. Targets are checked as in follow(). A body that is only there as bytes is read in the charset of its content type.

    attempts has every try, provider and retry (see provider_of() and retry_of()) what blocked tries say. A row's tries meet by a
    hash of the row, which stays the same when a task runs again; rows that are equal in all columns are fetched once and returned as often.
    """
    from metaloom.plans.api import Engine

    keep = [c for c in wanted.columns if c != "url"]
    # What several columns read has a projection of its own, and the tries no lambda, so that nothing is evaluated again.
    parts = wanted.withColumns({"_row": F.to_json(F.struct(*wanted.columns)), "_site": urls.domain_of(F.col("url")), "_path": F.regexp_replace(urls.path_of(F.col("url")), "/$", "")})
    endpoint, old = _endpoints(F.col("_site"), F.col("_path"))
    parts = parts.withColumns({"_id": F.struct(F.xxhash64("_row").alias("a"), F.xxhash64(F.lit(1), "_row").alias("b")), "_reddit": urls.on_reddit(F.col("_site")), "_json": endpoint, "_old": old})
    a_try = lambda n, how, at: F.struct(F.lit(n).alias("n"), F.lit(how).cast("string").alias("how"), F.col(at).alias("at"))
    tries = F.when(F.col("_reddit"), F.array(a_try(0, "reddit:jsonEndpoint", "_json"), a_try(1, "reddit:oldReddit", "_old"), a_try(2, "reddit:htmlFallback", "url"))).otherwise(F.array(a_try(0, None, "url")))
    asked = parts.select(*keep, "_id", "url", F.explode(tries).alias("t")).where("t.at IS NOT NULL")
    asked = asked.select(*keep, "_id", F.col("url").alias("asked"), F.col("t.n").alias("_n"), F.col("t.how").alias("how"), F.col("t.at").alias("url"))
    got = follow(asked, limited(responses, most_bytes), dns=dns, allow_local=allow_local, allow_private=allow_private)
    if "bytes" in got.columns:
        got = got.withColumn("body", F.coalesce("body", decode_body("bytes", "content_type")))
    if "retry_after" not in got.columns:
        got = got.withColumn("retry_after", F.lit(None).cast("string"))
    if cache is not None:
        past = F.col("redirects") if "redirects" in cache.columns else F.lit(None)
        known = cache.select(urls.normalize_url("url").alias("_u"), F.struct(F.col("html").alias("body"), "final_url", F.coalesce("status", F.lit(200)).alias("status"), "content_type", F.coalesce(past.cast(f"array<{HOP}>"), F.array().cast(f"array<{HOP}>")).alias("redirects")).alias("_c")).dropDuplicates(["_u"])
        hit = F.col("_c").isNotNull()
        got = got.withColumn("_u", urls.normalize_url("url")).join(known, "_u", "left")
        got = got.withColumns({**{c: F.when(hit, F.col(f"_c.{c}")).otherwise(F.col(c)) for c in ("body", "final_url", "status", "content_type", "redirects")}, **{c: F.when(~hit, F.col(c)) for c in ("error", "bytes") if c in got.columns}}).drop("_u", "_c")
    is_reddit = F.col("how").isNotNull()
    title, text = _said(F.when(is_reddit & F.col("status").isNotNull(), F.col("body")))
    got = got.withColumns({"_title": title, "_text": text})
    got = got.withColumns({"blocked": F.when(is_reddit & F.col("status").isNotNull(), _reason(F.col("status"), F.col("_title"), F.col("_text"))), "_page": listing_page(F.when((F.col("how") == "reddit:jsonEndpoint") & F.col("status").between(200, 299), F.col("body")))}).drop("_title", "_text")
    fine = F.when(is_reddit, F.col("status").between(200, 299) & F.col("blocked").isNull() & ((F.col("how") != "reddit:jsonEndpoint") | F.col("_page").isNotNull())).otherwise(F.col("status").isNotNull())
    got = got.withColumn("fine", F.coalesce(fine, F.lit(False)))
    got = got.withColumn("body", F.when(F.col("fine") & F.col("_page").isNull(), F.col("body")))  # no other is read, so none is moved
    # The first that is fine, else the last.
    fields = [c for c in got.columns if c not in ("_id", "_n")]
    tried = F.transform(F.array_sort(F.collect_list(F.struct("_n", "how", F.col("url").alias("at"), "status", "blocked", "error", "retry_after"))), lambda t: t.dropFields("_n"))
    last = F.when(is_reddit, 2).otherwise(0)  # every row has this try
    best = got.groupBy("_id").agg(F.array_distinct(tried).alias("attempts"), F.count_if(F.col("_n") == last).alias("_times"), F.min_by(F.struct(*fields), F.when(F.col("fine"), F.col("_n")).otherwise(100 - F.col("_n"))).alias("b"))
    best = best.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("attempts", "b.*")
    best = best.withColumns({"provider": F.when(~F.col("fine"), provider_of(F.col("attempts"))), "retry": F.when(F.col("how").isNotNull(), retry_of(F.col("attempts")))})
    media = direct_media(F.col("final_url"), F.col("content_type"), F.coalesce(*[F.col("bytes")] * ("bytes" in got.columns), F.encode(F.col("body"), "iso-8859-1")))
    best = best.withColumn("media", F.when(F.col("fine") & ~is_reddit, media))
    target = F.when(F.col("how") == "reddit:jsonEndpoint", F.col("asked")).otherwise(F.col("final_url"))
    inputs = best.withColumn("html", F.when(F.col("fine") & F.col("media").isNull(), F.coalesce("_page", "body")))
    inputs = inputs.select(*keep, "asked", "attempts", "provider", "retry", "how", "status", "error", "blocked", "redirects", "media", "fine", target.alias("url"), "html")
    parsed = (engine or Engine()).parse(inputs.withColumnRenamed("error", "fetch_error"))
    dead = ~F.col("fine")
    none = lambda c: F.when(~dead & F.col("media").isNull(), F.col(c))
    scores = {c: F.when(dead, 0).when(F.col("media").isNotNull(), F.col(f"media.{c}")).otherwise(F.col(c)) for c in ("confidence", "completeness", "reliability")}
    return parsed.withColumns(
        {
            "ok": F.col("fine") & F.coalesce(F.col("status").between(200, 299), F.lit(False)),
            "type": F.when(dead, "unknown").when(F.col("media").isNotNull(), F.col("media.kind")).otherwise(F.col("type")),
            **scores,
            **{c: none(c) for c in ("title", "description", "author", "publisher")},
            "best_image": F.when(dead, None).when(F.col("media.kind") == "image", F.col("media.url")).when(F.col("media").isNull(), F.col("best_image")),
            "method": F.when(F.col("media").isNotNull(), F.concat(F.lit("direct:"), F.col("media.kind"))).when(dead & F.col("how").isNotNull(), "reddit:blockedProvider").otherwise(F.coalesce("how", "diagnostics.extractionMethod")),
            "error": F.coalesce("fetch_error", F.when(dead, F.col("blocked"))),
        }
    ).withColumnRenamed("asked", "requested_url")
