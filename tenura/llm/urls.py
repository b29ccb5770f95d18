"""URL filters: explicit rules first, then the reputation of the host by empirical Bayes.

Pages with a labelled outcome (good or not) are counted per host. The rate of good pages is shrunk
through three levels of beta-binomial priors: a suffix towards all pages, a registered domain
towards its suffix, a host towards its domain. The suffix is one of the given public suffixes of
several labels, else the last label; the registered domain has one label more. Numeric addresses are
domains of their own under one suffix. The strength of each level's prior comes from the
spread of rates at that level (method of moments). A page whose host is, with the given confidence,
below the wanted rate is blocked; hosts without evidence inherit their domain's or suffix's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.text import lower_ascii
from tenura.sources.scratch import materialize


# Second-level labels under which country registries hand out domains, by country.
REGISTRY_LABELS = {
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "au": "asn com edu gov id net org",
    "nz": "ac co geek gen govt iwi maori net org school",
    "jp": "ac ad co ed go gr lg ne or",
    "kr": "ac co go ne or pe re",
    "in": "ac co edu firm gen gov ind net org res",
    "za": "ac co gov law net org school web",
    "br": "com edu gov net org",
    "cn": "ac com edu gov net org",
    "tw": "com edu gov idv net org",
    "hk": "com edu gov idv net org",
    "sg": "com edu gov net org per",
    "mx": "com edu gob net org",
    "ar": "com edu gob net org",
    "tr": "com edu gov net org",
    "il": "ac co gov net org",
    "id": "ac co go net or sch web",
    "th": "ac co go in net or",
}
PUBLIC_SUFFIXES = tuple(f"{label}.{country}" for country, labels in REGISTRY_LABELS.items()
                        for label in labels.split())
ADDRESS = r"(?s)\A([0-9]{1,3}\.){3}[0-9]{1,3}\z|\A\[.*\]\z"


@dataclass(frozen=True)
class Reputation:
    """Block when the upper bound of the good rate, ``sds`` deviations up, is under ``min_good``.

    ``least`` and ``most`` bound the strength of a prior, counted in pages.
    """

    min_good: float = 0.5
    sds: float = 1.645
    least: float = 2.0
    most: float = 1000.0


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, ties in text order; else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def levels(host: Column, public: Sequence[str] = PUBLIC_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without a port.

    ``public`` lists suffixes of two or three labels; the longest that ends a host counts, and a host
    that is itself a suffix is its own domain. IPv4 and bracketed addresses share the suffix
    ``(address)`` and are domains of their own, with which nothing else is pooled.
    """
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    known = F.array(*[F.lit(p) for p in sorted(set(public))]).cast("array<string>")

    def last(n: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)),
                                    F.lit(n)), ".")

    depth = F.when(F.array_contains(known, last(3)), 3).when(
        F.array_contains(known, last(2)), 2).otherwise(1)
    suffix = F.when(depth == 3, last(3)).when(depth == 2, last(2)).otherwise(last(1))
    domain = F.when(depth == 3, last(4)).when(depth == 2, last(3)).otherwise(last(2))
    address = name.rlike(ADDRESS)
    return (F.when(address, name).otherwise(domain),
            F.when(address, F.lit("(address)")).otherwise(suffix))


def _strength(groups: DataFrame, by: Sequence[str], limits: Reputation) -> float:
    """Prior strength by moments: how much rates of ``groups`` differ beyond binomial noise."""
    within = groups.where("n > 0")
    parents = within.groupBy(*by).agg(
        F.sum("good").alias("g"), F.sum("n").alias("t"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("sq"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"))
    rate = F.col("g") / F.col("t")
    # Sum over groups of n (rate - parent rate)^2, and what binomial noise alone would give.
    spread = F.col("gg") - F.col("g") * rate
    noise = rate * (1 - rate) * (F.col("k") - 1)
    extra = rate * (1 - rate) * (F.col("t") - F.col("sq") / F.col("t") - (F.col("k") - 1))
    row = parents.agg(F.sum(spread - noise).alias("over"), F.sum(extra).alias("extra")).first()
    if not row["extra"] or row["extra"] <= 0 or row["over"] is None or row["over"] <= 0:
        return limits.most
    return min(max(row["extra"] / row["over"] - 1.0, limits.least), limits.most)


def reputations(pages: DataFrame, limits: Reputation = Reputation(),
                public: Sequence[str] = PUBLIC_SUFFIXES) -> DataFrame:
    """(host, n, good, mean, upper) of each host of ``pages`` (host, good).

    ``good`` is 1 or 0 for labelled pages and null for others. Sums are whole numbers and every
    group is summed in parts first, so a host with a third of all pages costs one row per task.
    """
    domain, suffix = levels(F.col("host"), public)
    hosts = pages.groupBy("host").agg(F.sum(F.coalesce("good", F.lit(0))).alias("good"),
                                      F.count("good").alias("n"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"),
                                                    F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = (total["good"] or 0) / total["n"] if total["n"] else 0.5
    k_suffix = _strength(suffixes.withColumn("all", F.lit(0)), ["all"], limits)
    k_domain = _strength(domains, ["suffix"], limits)
    k_host = _strength(hosts, ["domain"], limits)

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("good") + prior * strength) / (F.col("n") + strength)

    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), k_suffix).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", shrunk(F.col("of_suffix"), k_domain).alias("of_domain"))
    mean = shrunk(F.col("of_domain"), k_host)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k_host + 1))
    return hosts.join(domains, "domain").select("host", "n", "good", mean.alias("mean")) \
        .withColumn("upper", F.least(F.col("mean") + limits.sds * deviation, F.lit(1.0)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule],
          limits: Reputation = Reputation(), id_col: str = "page_id",
          url_col: str = "url", public: Sequence[str] = PUBLIC_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, host_pages, host_mean, host_upper) for each row of ``pages``.

    ``outcomes`` (id, good) are the labelled pages; an id with several outcomes is good if all
    are. Null and malformed urls share the empty host. The rules are a short list, at most 1,000;
    ``public`` are the suffixes of several labels under which domains are registered.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1,000 rules")
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = outcomes.toDF("id", "good").where("id is not null and good is not null")
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    marked = rows.select("id", "host").join(known, "id", "left")
    found = reputations(marked.select("host", "good"), limits, public)
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.join(found, "host").withColumns({"rule": rule, "verdict": verdict})
    by_host = F.when(F.col("upper") < limits.min_good, "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule",
                       F.coalesce("verdict", by_host).alias("verdict"),
                       F.col("n").alias("host_pages"), F.round("mean", 6).alias("host_mean"),
                       F.round("upper", 6).alias("host_upper"))
