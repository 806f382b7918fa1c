"""URL filters: a blocked Bloom filter of the listed URLs in front of an exact hash join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.llm import bloom
from rollscan.llm.common import BROADCAST_ROWS, sized, stage

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical parts: host lower-cased (A-Z), path up to ? or #; both empty where there is no ``://``."""
    there = F.instr(url, "://")
    rest = F.when(there > 0, F.substring(url, there + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages' columns with host, path, rule and verdict.

    rules(host, path, action): a rule fits its host and all subdomains of it where the path starts with the rule's; the
    longest fitting rule wins (ties: the first by code point; block before allow where both are listed). Urls that no
    rule fits get `default` and a null rule, as do null urls, urls without ``://`` and all urls of an empty list.
    Repeated rows are kept. Clashing columns host, path, rule, verdict of pages are replaced.
    """
    listed = stage(rules.select(F.concat("host", "path").alias("rule"), "host", "path", "action").groupBy("rule", "host", "path").agg(F.max("action").alias("action")), "rules")
    shape = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = host_and_path(F.col(url))
    pages = pages.drop(*[c for c in ("rule", "verdict") if c in pages.columns])
    parted = pages.withColumns({"host": host, "path": path})
    if not shape["n"]:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = F.split("host", r"\.")
    depth = F.least(F.size(labels), F.lit(shape["labels"]))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    probes = parted.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("rule"))
    possible = bloom.probe(probes, F.col("rule"), bloom.build(listed, "rule", shape["n"])).filter("possible").select("row.*")
    exact = possible.join(sized(listed.select("rule", "action"), shape["n"]), "rule")
    first = F.struct((-F.length("rule")).alias("l"), F.col("rule").alias("r"))
    best = exact.groupBy("host", "path").agg(F.min_by("rule", first).alias("rule"), F.min_by("action", first).alias("verdict"))
    best = stage(best, "matched")
    # urls without a host fit no rule, however many there are
    some = parted.filter("host <> ''").join(sized(best, limit=BROADCAST_ROWS // 10), ["host", "path"], "left")
    none = parted.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    out = some.unionByName(none)
    return out.select(*[F.col(f"`{c}`") for c in parted.columns if c not in ("host", "path")], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
