"""Joins that equality alone doesn't state: the last row before a time, addresses in blocks, and hosts below listed domains.

Each becomes an equality join (or one ordered stream) that Spark can deal out, cut where a key is hot. None makes all pairs.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from metaloom.functions.shared import Scratch
from metaloom.functions.ship import ship

#: Rows of a key from which as_of() cuts its time into slices of about as many, by counts of RESOLUTION equal parts of the key's time.
SLICE_ROWS, RESOLUTION = 1_000_000, 4096
#: Tasks over which the rows of a domain with one, two and three labels are dealt.
SALTS = (64, 16, 4)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, name: str = "last", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds to every row of left the last row of right with the same keys whose time isn't later, as a struct of right's columns, or null.

    Both go into one stream for each key, ordered by time, in which the last row of right is carried on. The stream of a hot key is cut into slices
    of time; what a slice starts with is the last row of right before it, found from one row for each slice. Of right's rows at one time the one that is
    greatest in all its columns counts, by their order. Nulls in keys are equal to each other; a null time on the left finds nothing, on the right
    it isn't found. Rows of left come as often as they are there.
    """
    scratch = Scratch(left.sparkSession)
    key = F.struct(*keys)
    theirs = right.where(F.col(right_time).isNotNull()).select(key.alias("_key"), F.col(right_time).alias("_time"), F.struct(*right.columns).alias("_theirs"))
    theirs = theirs.groupBy("_key", "_time").agg(F.max("_theirs").alias("_theirs"))
    mine = left.select(key.alias("_key"), F.col(left_time).alias("_time"), F.struct(*left.columns).alias("_mine"))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = mine.select("_key", "_time", "_mine", none("_theirs", theirs)).unionByName(theirs.select("_key", "_time", none("_mine", mine), "_theirs"))
    timed = _sliced(both.where("_time IS NOT NULL"), slice_rows, scratch)
    one = Window.partitionBy("_key", "_slice").orderBy("_time", F.col("_mine").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    streamed = timed.withColumn("_last", F.last("_theirs", ignorenulls=True).over(one)).where("_mine IS NOT NULL")
    # What each slice starts with; only hot keys have more than one.
    ends = timed.where("_slices > 1 AND _theirs IS NOT NULL").groupBy("_key", "_slice").agg(F.max_by("_theirs", "_time").alias("_end"))
    slices = timed.where("_slices > 1").select("_key", "_slice").distinct().join(ends.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), "_end"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    open_ = streamed.where("_last IS NULL AND _slices > 1").join(carried.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")), "left").select("_mine", F.col("_carried").alias("_last"))
    done = streamed.where("_last IS NOT NULL OR _slices = 1").select("_mine", "_last")
    late = both.where("_time IS NULL").select("_mine", F.col("_theirs").alias("_last"))
    return done.unionByName(open_).unionByName(late).select("_mine.*", F.col("_last").alias(name))


def _sliced(rows: DataFrame, slice_rows: int, scratch: Scratch) -> DataFrame:
    """Adds _slice and _slices: keys with more than slice_rows rows are cut along _time, all others are one slice."""
    at = F.unix_micros(F.col("_time").cast("timestamp"))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi")).where((F.col("_n") > slice_rows) & (F.col("_hi") > F.col("_lo")))
    hot = scratch.cut(sizes.withColumnRenamed("_key", "_hot"))  # as many as the rows hold slices, at most
    if hot.isEmpty():
        return rows.withColumns({"_slice": F.lit(0), "_slices": F.lit(1)})
    part = F.floor((at - F.col("_lo")) * (RESOLUTION - 1) / (F.col("_hi") - F.col("_lo"))).cast("int")
    told = rows.join(hot.hint("merge"), F.col("_key").eqNullSafe(F.col("_hot")), "left").withColumn("_part", F.when(F.col("_n").isNotNull(), part))
    counts = told.where("_part IS NOT NULL").groupBy("_hot", "_part").agg(F.count(F.lit(1)).alias("_c"))
    run = F.sum("_c").over(Window.partitionBy("_hot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(F.col("_hot").alias("_h"), F.col("_part").alias("_p"), F.floor(F.coalesce(run, F.lit(0)) / slice_rows).cast("int").alias("_slice"))
    cut = told.where("_part IS NOT NULL").join(places.hint("merge"), F.col("_hot").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_p")))
    columns = [c for c in rows.columns]
    return cut.select(*columns, "_slice", F.lit(2).alias("_slices")).unionByName(told.where("_part IS NULL").select(*columns, F.lit(0).alias("_slice"), F.lit(1).alias("_slices")))


@F.pandas_udf(StringType())
def address_bits(address: pd.Series) -> pd.Series:
    """An address as 4 or 6 and its bits; null for what is none. An IPv4 address in an IPv6 one counts as itself."""

    def one(text: str | None) -> str | None:
        try:
            a = ipaddress.ip_address((text or "").strip().strip("[]").partition("%")[0])
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        return f"{a.version}{int(a):0{a.max_prefixlen}b}"

    return pd.Series([one(t) for t in address], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def block_bits(block: pd.Series) -> pd.Series:
    """The prefixes of a block (address, address/length or first-last) as 4 or 6 and bits: a range is cut into the fewest; null for what is none."""

    def one(text: str | None) -> list[str] | None:
        try:
            first, dash, last = (text or "").partition("-")
            if dash:
                networks = list(ipaddress.summarize_address_range(ipaddress.ip_address(first.strip()), ipaddress.ip_address(last.strip())))
            else:
                networks = [ipaddress.ip_network(first.strip(), strict=False)]
        except (ValueError, TypeError):
            return None
        return [f"{n.version}{int(n.network_address):0{n.max_prefixlen}b}"[: 1 + n.prefixlen] for n in networks]

    return pd.Series([one(t) for t in block], dtype=object)


def in_blocks(rows: DataFrame, blocks: DataFrame, address: str = "address", block: str = "block") -> DataFrame:
    """Every row of rows with the rows of blocks that hold its address: rows' columns and matched, a struct of blocks' columns.

    Blocks become prefixes of bits, at most 62 (IPv4) or 254 (IPv6) for a range of any size, and each distinct address becomes its prefixes of the
    lengths that blocks have; both are joined by equality. So the work follows addresses and blocks, not their product. Rows outside all blocks
    and what is no address give none.
    """
    ship(rows.sparkSession)
    cut = blocks.select(F.explode(block_bits(block)).alias("_bits"), F.struct(*blocks.columns).alias("matched"))
    lengths = [r.n for r in cut.select(F.length("_bits").alias("n")).distinct().collect()]  # 162 at most
    bits = rows.select(F.col(address).alias("_at")).where("_at IS NOT NULL").distinct().withColumn("_all", address_bits("_at")).where("_all IS NOT NULL")
    prefixes = F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: F.when(n <= F.length("_all"), F.substring("_all", F.lit(1), n)))
    asked = bits.select("_at", F.explode(prefixes).alias("_bits")).where("_bits IS NOT NULL")
    found = asked.join(cut.hint("merge"), "_bits").select("_at", "matched").distinct()
    return rows.join(found.hint("merge"), F.col(address) == F.col("_at")).drop("_at")


def narrowest_block(rows: DataFrame, blocks: DataFrame, address: str = "address", block: str = "block") -> DataFrame:
    """Every row of rows and block: the smallest block that holds its address (ties: the first by text), or null."""
    size = _size(F.col("matched")[block])
    best = in_blocks(rows.select(address).distinct(), blocks.select(block).distinct(), address, block).groupBy(F.col(address).alias("_at")).agg(F.min_by(F.col("matched")[block], F.struct(size, F.col("matched")[block])).alias(block))
    return rows.join(best.hint("merge"), F.col(address) == F.col("_at"), "left").drop("_at")


@F.pandas_udf(DoubleType())
def _size(block: pd.Series) -> pd.Series:
    """How many addresses a block has."""

    def one(text: str) -> float:
        first, dash, last = text.partition("-")
        return float(int(ipaddress.ip_address(last.strip())) - int(ipaddress.ip_address(first.strip())) + 1 if dash else ipaddress.ip_network(first.strip(), strict=False).num_addresses)

    return pd.Series([one(t) for t in block], dtype="float64")


def suffixes(host: Column) -> Column:
    """A host and all domains above it, longest first."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def listed_domains(rows: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain", name: str = "listed") -> DataFrame:
    """Every row of rows and the longest listed domain that its host is or is below, or null.

    Each distinct host becomes its suffixes, which are joined with the list by equality. Suffixes of few labels are shared by many hosts:
    those are dealt over SALTS tasks by the host, and their few entries of the list repeated as often.
    """
    labels = F.size(F.split("_suffix", r"\."))
    salts = F.when(labels == 1, SALTS[0]).when(labels == 2, SALTS[1]).when(labels == 3, SALTS[2]).otherwise(1)
    known = domains.select(F.regexp_replace(F.lower(F.col(domain)), r"^\.|\.$", "").alias("_suffix")).where("_suffix <> ''").distinct()
    known = known.select("_suffix", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    hosts = rows.select(F.col(host).alias("_host")).where("_host IS NOT NULL").distinct()
    asked = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("_suffix")).withColumn("_salt", F.pmod(F.xxhash64("_host"), salts).cast("int"))
    found = asked.join(known.hint("merge"), ["_suffix", "_salt"]).groupBy("_host").agg(F.max_by("_suffix", F.length("_suffix")).alias(name))
    return rows.join(found.hint("merge"), F.col(host) == F.col("_host"), "left").drop("_host")
