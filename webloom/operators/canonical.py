"""URLs of one form: hosts in lower case, and without the parameters that don't change a host's pages.

neutral() learns these from pages: two pages of a host whose URLs differ in one parameter only, by its value or by having
it, speak for the parameter if their content is the same, and against it if not. A parameter is neutral for a host if
at least SUPPORT such groups of pages speak for it and none against. Groups are counted by (host, parameter, rest of
the URL), which are many keys, however large a host is; distinct contents and values are counted as sums of hashes,
so no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .robots import host_of

SUPPORT = 2


def _query(url: Column) -> Column:
    """The parameters, name=value each, in order."""
    said = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.array_remove(F.split(said, "&"), "")


def _name(parameter: Column) -> Column:
    return F.substring_index(parameter, "=", 1)


def _with(url: Column, parameters: Column) -> Column:
    """The URL with its host in lower case, without a fragment, with these parameters in order of name."""
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    said = F.array_join(F.array_sort(parameters), "&")
    return F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest), F.when(said == "", "").otherwise(F.concat(F.lit("?"), said)))


def neutral(pages: DataFrame, content: Column, support: int = SUPPORT) -> DataFrame:
    """host, parameter: what may be dropped. pages: url, and a column that is equal where contents are."""
    rows = pages.where(F.col("url").isNotNull() & content.isNotNull())
    rows = rows.select(host_of(F.col("url")).alias("host"), "url", F.xxhash64(content).alias("content"), _query(F.col("url")).alias("ps")).where("host != ''")
    # A URL has a row for each of its own parameters; without a parameter it may stand beside those that have it.
    have = rows.select("host", "content", F.explode(F.transform("ps", lambda p: F.struct(_name(p).alias("parameter"), p.alias("said"), _with(F.col("url"), F.filter("ps", lambda q: _name(q) != _name(p))).alias("rest")))).alias("x")).select("host", "content", "x.*")
    bare = rows.select("host", F.lit("").alias("said"), "content", _with(F.col("url"), F.col("ps")).alias("rest"))
    known = have.select("host", "parameter", "rest").distinct()
    both = have.select("host", "parameter", "rest", "said", "content").unionByName(known.join(bare, ["host", "rest"]).select("host", "parameter", "rest", "said", "content"))
    groups = both.groupBy("host", "parameter", "rest").agg(F.min("said").alias("a"), F.max("said").alias("b"), F.min("content").alias("c"), F.max("content").alias("d")).where("a != b")
    counts = groups.groupBy("host", "parameter").agg(F.count_if(F.col("c") == F.col("d")).alias("same"), F.count_if(F.col("c") != F.col("d")).alias("other"))
    return counts.where((F.col("same") >= support) & (F.col("other") == 0)).select("host", "parameter")


def canonical(urls: DataFrame, dropped: DataFrame) -> DataFrame:
    """url, canonical for each distinct URL. dropped: host, parameter; a host's are few, and one row."""
    by_host = dropped.groupBy("host").agg(F.collect_set("parameter").alias("drop"))
    rows = urls.select("url").where("url is not null").distinct().withColumn("host", host_of(F.col("url"))).join(by_host, "host", "left")
    kept = F.filter(_query(F.col("url")), lambda p: F.coalesce(~F.array_contains("drop", _name(p)), F.lit(True)))
    return rows.select("url", F.when(F.col("host") == "", F.col("url")).otherwise(_with(F.col("url"), kept)).alias("canonical"))
