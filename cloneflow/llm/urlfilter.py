"""URL filter: allow and block rules, and beyond them the reputation of a host as its labelled pages suggest it.

Bad pages among labelled pages are beta-binomial counts. A suffix (`net`) is shrunk towards the whole, a registered
domain towards its suffix, a host towards its registered domain; the strength of each prior is estimated from how much the
groups of that level differ. A host is blocked when the lower bound of its posterior bad rate exceeds a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.llm.common import LOWER, UPPER
from cloneflow.operators.joins import join_unique
from cloneflow.session import materialize

# Host, path and verdict, given with the task.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
MAX_RULES = 1000

BLOCK_ABOVE = 0.5
DEVIATIONS = 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or no `://`: both empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct `(size, host_size, rule, verdict)`, or null. Ties go to the longer host.

    The rules are part of the expression, so their number is bounded; a list that grows belongs in a table.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into an expression")
    fitting = []
    for of, start, verdict in rules:
        here = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        made = F.struct(F.lit(len(of + start)).alias("size"), F.lit(len(of)).alias("host_size"), F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting.append(F.when(here, made))
    return F.greatest(*fitting) if len(fitting) > 1 else fitting[0] if fitting else F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def prior_strength(groups: DataFrame) -> DataFrame:
    """One row, `strength`: the moment estimate of alpha + beta from `n` and `bad` of the groups of one level.

    It stays between MIN_STRENGTH (groups differ wildly, or there is nothing to tell) and MAX_STRENGTH (they do not differ).
    """
    sums = groups.where(F.col("n") > 0).agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum("n").cast("double").alias("total"),
        F.sum("bad").cast("double").alias("hits"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("sizes"),
    )
    p = F.col("hits") / F.col("total")
    spread = F.col("square") - F.col("total") * p * p
    variance = p * (1 - p)
    room = variance * (F.col("total") - F.col("sizes") / F.col("total") - (F.col("k") - 1))
    rho = F.when(room > 0, (spread - variance * (F.col("k") - 1)) / room)
    strength = F.when(rho > 0, (1 - rho) / rho).otherwise(F.when(rho.isNull(), MIN_STRENGTH).otherwise(MAX_STRENGTH))
    return sums.select(F.least(F.greatest(strength, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)).alias("strength"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """`host, n, bad, mean, low`: posterior mean and lower bound of the bad rate of each host.

    `outcomes` is `host, bad` with bad 1, 0 or null (not labelled); every host in it gets a row. Each host is one row from the
    first aggregation on, so nothing below moves a host's pages.
    """
    hosts = materialize(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    hosts = hosts.withColumns({"domain": _domain(F.col("host")), "suffix": _suffix(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # One row each: plain numbers to the driver.
    total, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    of_suffix, of_domain, of_host = (prior_strength(level).first()[0] for level in (suffixes, domains, hosts))
    overall = ((bad or 0) + 1.0) / ((total or 0) + 2.0)
    shrunk = lambda strength, towards: (F.col("bad") + F.lit(strength) * towards) / (F.col("n") + F.lit(strength))
    suffixes = suffixes.select("suffix", shrunk(of_suffix, F.lit(overall)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(of_domain, F.col("suffix_mean")).alias("domain_mean"))
    mean = shrunk(of_host, F.col("domain_mean"))
    deviation = F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(of_host) + 1))
    return hosts.join(domains, "domain").select("host", "n", "bad", mean.alias("mean"), F.greatest(mean - DEVIATIONS * deviation, F.lit(0.0)).alias("low"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """`page_id, host, path, rule, verdict, mean, low` of every row of `pages` (page_id, url).

    `labels` is `page_id, bad`; several labels of a page count as one, bad if any is; null ones do not count. A null page_id
    has no label. A url without a host belongs to the host "". Rows may repeat; empty tables give no rows.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = labels.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = materialize(reputations(urls.join(labels, "page_id", "left").select("host", "bad")).select("host", "mean", "low"), "reputations")
    judged = join_unique(urls, known, ["host"], ["page_id", "path"])
    rule = best_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("best", rule)
    method = F.when(F.col("low") > block_above, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "mean", "low")
