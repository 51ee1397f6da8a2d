"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Every host gets a posterior share of good pages. Its prior is the posterior of its registered
domain, whose prior is the posterior of the suffix, whose prior is the share over all labelled
pages. How far a level trusts its parent is estimated from the data of that level: the spread of
its groups beyond binomial noise gives the strength of a beta-binomial prior. A host is blocked
only when even the upper bound of its posterior is below the cutoff, so hosts without labels,
and hosts with few, keep what their domain and suffix deserve.

Only DataFrame functions are used. Page rows are never shuffled when the table of hosts is
small (measured); beyond that the join shuffles and adaptive execution splits a host that holds
much of the table. Labels are counted per host before anything is joined.

Defined results
---------------
* URL NULL or without ``://``: host and path are empty; such pages share the host ``""``.
* A page key that is NULL or repeated: each row is judged by itself.
* Outcomes with a NULL key or a NULL outcome do not count; a page labelled twice counts twice.
* No labels at all: every posterior is the neutral 1/2 and nothing is blocked but by a rule.
* The suffix is the longest of ``suffixes`` that a host ends with, else its last label; the registered
  domain has one label more. A port and a user part do not count for these levels. A host of one
  label, a suffix itself and an IP address are their own domains.
* Columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.operators.joins import sized
from reviewmill.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUTOFF = 0.5
Z = 1.645
LEVELS = ("suffix", "domain", "host")


class Rule(NamedTuple):
    """``text`` is a host and a path, such as ``example.net/en/``."""

    verdict: str
    text: str


# The rules of the contract.
RULES = (
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
)

# Public suffixes of several labels, by top-level domain. Others can be passed.
SECOND_LEVELS = {
    "ar": "com edu gob gov int mil net org", "au": "asn com edu gov id net org",
    "bd": "ac com edu gov net org", "br": "art blog com edu eco gov jus leg mil net org tv",
    "cn": "ac com edu gov mil net org", "co": "com edu gov mil net nom org", "cy": "ac com gov net org",
    "eg": "com edu gov net org", "gr": "com edu gov net org", "hk": "com edu gov idv net org",
    "id": "ac co desa go mil my net or sch web", "il": "ac co gov k12 muni net org",
    "in": "ac co edu firm gen gov ind mil net nic org res", "jp": "ac ad co ed go gr lg ne or",
    "ke": "ac co go me ne or sc", "kr": "ac co go hs kg mil ms ne or pe re sc",
    "mx": "com edu gob net org", "my": "com edu gov mil name net org", "ng": "com edu gov name net org sch",
    "nz": "ac co cri geek gen govt health iwi maori mil net org school", "pe": "com edu gob mil net nom org",
    "ph": "com edu gov mil net ngo org", "pk": "com edu gov net org", "pl": "com edu gov net org",
    "sa": "com edu gov med net org sch", "sg": "com edu gov net org per", "th": "ac co go in mi net or",
    "tr": "av bel biz com edu gen gov info k12 mil name net org pol tel tv web",
    "tw": "club com ebiz edu game gov idv mil net org", "ua": "com edu gov in net org",
    "uk": "ac co gov ltd me net nhs org plc police sch", "uy": "com edu gub mil net org",
    "ve": "co com edu gob info net org web", "vn": "ac com edu gov net org",
    "za": "ac co edu gov law mil net nom org school web",
}
SUFFIXES = tuple(f"{label}.{top}" for top, labels in SECOND_LEVELS.items() for label in labels.split())


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    found = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(found, UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    found = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, found), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits as a struct of verdict and text, else NULL."""
    found = F.lit(None).cast("struct<verdict:string,text:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        domain, _, start = rule.text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        value = F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.text).alias("text"))
        found = F.when(fits, value).otherwise(found)
    return found


def levels_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")

    def last(labels: int) -> Column:
        return F.regexp_extract(name, rf"(?:[^.]*\.){{0,{labels - 1}}}[^.]*$", 0)

    suffix, domain = last(1), last(2)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        listed = last(labels).isin([s for s in suffixes if s.count(".") + 1 == labels])
        suffix = F.when(listed, last(labels)).otherwise(suffix)
        domain = F.when(listed, last(labels + 1)).otherwise(domain)
    address = name.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[^\]]*\])\z")
    return F.when(address, name).otherwise(suffix), F.when(address, name).otherwise(domain)


def _groups(hosts: DataFrame, level: str) -> DataFrame:
    """Labelled and good pages of each group of a level, with the group it belongs to."""
    above = {"suffix": F.lit(""), "domain": F.col("suffix"), "host": F.col("domain")}[level]
    return hosts.groupBy(F.col(level).alias("name"), above.alias("above")).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")
    )


def _strength(groups: DataFrame) -> DataFrame:
    """One row: how many labelled pages the prior of a level is worth.

    The correlation within groups by the method of moments, kept between 0.001 and 0.999.
    """
    rate, noise = F.col("k") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    found = groups.where("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col("prior")) * (rate - F.col("prior"))).alias("spread"),
        F.sum(noise).alias("expected"),
        F.sum((F.col("n") - 1) * noise).alias("room"),
    )
    share = (F.col("spread") - F.col("expected")) / F.col("room")
    share = F.when(F.col("room") > 0, share).otherwise(F.lit(0.5))
    share = F.least(F.greatest(share, F.lit(0.001)), F.lit(0.999))
    return found.select((1 / share - 1).alias("strength"))


def host_reputation(hosts: DataFrame, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``host``, ``n``, ``k``, posterior ``mean`` and its ``upper`` bound.

    ``hosts`` has ``host``, ``n`` (labelled pages) and ``k`` (good ones), one row per host. One
    pass over the hosts for each level; the strength of a level is a single row.
    """
    suffix, domain = levels_of(F.col("host"), suffixes)
    hosts = hosts.select("host", "n", "k", suffix.alias("suffix"), domain.alias("domain"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rate = F.coalesce(F.try_divide(F.col("k"), F.col("n")), F.lit(0.5))
    parents = total.select(F.lit("").alias("above"), rate.alias("prior"))
    for level in LEVELS:
        groups = _groups(hosts, level).join(sized(parents), "above")
        groups = cut_lineage(groups.select("name", "n", "k", "prior"))
        groups = groups.crossJoin(F.broadcast(_strength(groups)))
        good = F.col("strength") * F.col("prior") + F.col("k")
        bad = F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("k")
        mean, size = good / (good + bad), good + bad
        spread = F.sqrt(mean * (1 - mean) / (size + 1))
        scored = groups.select(
            "name", "n", "k", mean.alias("mean"), (mean + z * spread).alias("upper")
        )
        parents = scored.select(F.col("name").alias("above"), F.col("mean").alias("prior"))
    return scored.withColumnRenamed("name", "host")


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    page_key: str = "page_id",
    url: str = "url",
    outcome_key: str = "page_id",
    good: str = "good",
    rules: Sequence[Rule] = RULES,
    cutoff: float = CUTOFF,
    z: float = Z,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Each page with its host, path, rule and verdict; ``outcomes`` holds (page key, good or not).

    All outcomes of a page key count for each row of that key.
    """
    parsed = pages.select(
        F.col(page_key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    known = outcomes.select(
        F.col(outcome_key).alias("page_id"), F.col(good).cast("boolean").alias("good")
    ).where("page_id IS NOT NULL AND good IS NOT NULL")
    # outcomes are added up first, so a repeated page key joins one row
    known = known.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("k"))
    labelled = parsed.join(known, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = (
        parsed.groupBy("host")
        .agg(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("k"))
        .unionByName(labelled)
        .groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    )
    scored = cut_lineage(host_reputation(cut_lineage(hosts), z, suffixes))
    judged = parsed.join(sized(scored), "host").withColumn(
        "_rule", fitting_rule(F.col("host"), F.col("path"), rules)
    )
    by_method = F.when(F.col("upper") < cutoff, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.text").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
        F.col("n").alias("n_labelled"),
        F.col("k").alias("n_good"),
    )
