"""Robots rules: what a host's robots.txt allows, joined to URLs by their prefixes.

A host's rules are rows (host, allow, pattern). The rule with the longest pattern that fits a URL's path and query
decides, allow if both have the same length; without one the URL is allowed. A plain pattern fits as a prefix: the
URL's path is cut at the lengths of the patterns that its host has, and the cuts are joined to the patterns by
(host, prefix), as one would walk down a tree of prefixes. So a host of many URLs and many rules is many keys.
Patterns with * or a final $ are few; a host's are one array, and are tried one by one.

Rules are cached as a table with the time at which they were fetched; hosts that have none that is young enough are
fetched anew. A robots.txt that isn't there (status 4xx) allows all; one that can't be had otherwise forbids all, until
it is asked again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.sources import web

#: Seconds for which a host's rules are kept; characters of a robots.txt that count, at least what the standard asks for.
AGE, MOST = 24 * 3600, 512_000
_RULES = "host string, allow boolean, pattern string"


def host_of(url: Column) -> Column:
    """scheme://authority in lower case, which is what a robots.txt is for."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """Path and query; at least a slash."""
    rest = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def parse(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the groups that name the agent, by the start of its name, or else of those for all."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    listing = False
    for line in text[:MOST].splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*(names if listing else []), value.lower()]
            listing = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            listing = False
            if value:
                for n in names:
                    groups[n].append((key == "allow", value if value[0] in "/*" else "/" + value))
    own = agent.split("/")[0].lower()
    named = [n for n in groups if n and n != "*" and own.startswith(n)]
    return groups[max(named, key=len)] if named else groups.get("*", [])


def fetched(hosts: DataFrame, agent: str = web.AGENT, now: Column | None = None, **how) -> DataFrame:
    """host, rules (an array), at: the rules of each host, from its robots.txt."""
    asked = hosts.select("host").distinct().withColumn("url", F.concat("host", F.lit("/robots.txt")))
    got = web.fetch(asked.select("url"), **how).join(asked, "url")

    @F.arrow_udf("array<struct<allow: boolean, pattern: string>>")
    def rules(html: pa.Array, error: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("allow", pa.bool_()), ("pattern", pa.string())]))
        out = []
        for h, e in zip(html.to_pylist(), error.to_pylist()):
            found = parse(h, agent) if h is not None else [] if web.lasting(e or "") else [(False, "/")]
            out.append([{"allow": a, "pattern": p} for a, p in found])
        return pa.array(out, kind)

    return got.select("host", rules("html", "error").alias("rules"), (F.unix_timestamp() if now is None else now).cast("bigint").alias("at"))


def cached(hosts: DataFrame, known: DataFrame, now: Column, age: int = AGE, **how) -> DataFrame:
    """host, rules, at of all hosts: the youngest of known, (host, rules, at), if it is young enough, or else fetched."""
    young = known.where(F.col("at") > now - age).groupBy("host").agg(F.max_by("rules", "at").alias("rules"), F.max("at").alias("at"))
    mine = young.join(hosts.select("host").distinct(), "host", "left_semi")
    return mine.unionByName(fetched(hosts.join(young, "host", "left_anti"), now=now, **how))


def _expression(pattern: Column) -> Column:
    """A pattern with * and $ as a regular expression: everything else is quoted."""
    quoted = F.regexp_replace(pattern, r"([\\.+?^${}()\[\]|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\\\$$", r"\$"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed for each distinct URL. rules: host, allow, pattern."""
    rows = urls.select("url").where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.select("host", "allow", "pattern").where("pattern is not null and pattern != ''").distinct()
    wild = F.col("pattern").contains("*") | F.col("pattern").endswith("$")
    said = F.struct(F.length("pattern").alias("n"), "allow").alias("said")
    plain = rules.where(~wild).select("host", F.col("pattern").alias("prefix"), said)
    # What a host has: the lengths of its plain patterns, and its other patterns. A robots.txt is bounded, and so are these.
    held = rules.groupBy("host").agg(
        F.collect_set(F.when(~wild, F.length("pattern"))).alias("lengths"),
        F.collect_set(F.when(wild, F.struct(F.length("pattern").alias("n"), "allow", _expression(F.col("pattern")).alias("like")))).alias("others"),
    )
    rows = rows.join(held, "host", "left")
    cuts = F.filter("lengths", lambda n: n <= F.length("path"))
    each = rows.select("url", "host", F.explode(F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    by_prefix = each.join(plain, ["host", "prefix"]).groupBy("url").agg(F.max("said").alias("said"))
    fits = F.filter("others", lambda x: F.regexp_like(F.col("path"), x["like"]))
    by_form = F.array_max(F.transform(fits, lambda x: F.struct(x["n"].alias("n"), x["allow"].alias("allow"))))
    both = rows.select("url", by_form.alias("other")).join(by_prefix, "url", "left")
    return both.select("url", F.coalesce(F.greatest("said", "other")["allow"], F.lit(True)).alias("allowed"))


def matches(pattern: str, path: str) -> bool:
    """A single pattern, for tests and small lists."""
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*")))
    return re.match(body + (r"\Z" if end else ""), path, re.S) is not None
