"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts.

The share of bad pages of a host is shrunk through beta-binomial priors: towards its registered
domain, that towards its suffix, that towards all labelled pages. How strongly each level is
shrunk is estimated from the data by moments. A host is blocked when the lower posterior bound
of its bad share lies above a threshold.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut, join_by_size, join_spread


class UrlRule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)
#: Rules that are compiled into one expression; a longer list is refused.
MOST_RULES = 1000
#: A host is blocked when its bad share is above this by the lower bound.
THRESHOLD = 0.35
#: Standard deviations of the posterior between its mean and the lower bound.
Z = 1.645
#: Bounds of the intra-class correlation, so that the prior weighs 1 to 9999 pages.
RHO = (0.0001, 0.5)
#: Hosts under a country's second level, such as a.co.uk: their suffix has two labels.
SECOND_LEVEL = r"(^|\.)((ac|co|com|edu|gov|net|org)\.[a-z][a-z])$"


#: What stands beside a host's name: a user name before it, a port behind it.
BESIDE = r"^(?s:.*)@|:[0-9]*\z"
#: Hosts that are addresses, and the suffix that they are given.
ADDRESS, ADDRESSES = r"^([0-9]+(\.[0-9]+){3}|\[[^\]]*\])\z", "[]"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    parts = r"^([^/?#]*)([^?#]*)"
    return pages.withColumn("host", lower_ascii(F.regexp_extract(rest, parts, 1))).withColumn("path", F.regexp_extract(rest, parts, 2))


def rule_of(rules: tuple[UrlRule, ...], found: str) -> Column:
    """Of the rules that fit a row's host and path, the longest one's ``text`` or ``action``.

    Rules go longest first (then by code point) into one CASE, so the first that fits wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, found))) if out is None else out.when(fits, F.lit(getattr(r, found)))
    return F.lit(None).cast("string") if out is None else out


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host, user names and ports aside.

    An address (digits and dots, or in brackets) is its own domain, under the suffix of all addresses.
    """
    name = F.regexp_replace(host, BESIDE, "")
    two = F.regexp_extract(name, SECOND_LEVEL, 2)
    last = F.when(two != "", two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    labels = F.when(two != "", F.regexp_extract(name, r"([^.]*\.?[^.]*\.[^.]*)$", 1)).otherwise(F.regexp_extract(name, r"([^.]*\.?[^.]*)$", 1))
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(labels), F.when(address, F.lit(ADDRESSES)).otherwise(last)


def strength(level: DataFrame) -> float:
    """Pages that a level's prior weighs, from one row of sums: 1 / rho - 1 by moments.

    ``level`` has n, bad and prior (the parent's mean). Var(bad / n) is
    prior * (1 - prior) * (1 + (n - 1) * rho) / n under a beta-binomial model.
    """
    v = F.col("prior") * (1 - F.col("prior"))
    d = F.col("bad") / F.col("n") - F.col("prior")
    s = level.where("n > 0").agg(F.sum(F.col("n") * d * d - v).alias("over"), F.sum(v * (F.col("n") - 1)).alias("room")).first()
    rho = min(max((s["over"] or 0.0) / s["room"], RHO[0]), RHO[1]) if s["room"] else RHO[0]
    return 1 / rho - 1


def shrunk(level: DataFrame) -> DataFrame:
    """``level`` with the posterior beta's a and b; n, bad and prior are as in strength()."""
    m = strength(level)
    return level.withColumn("a", F.col("bad") + F.lit(m) * F.col("prior")).withColumn("b", F.col("n") - F.col("bad") + F.lit(m) * (1 - F.col("prior")))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, pages, n, bad, mean, bound: one row for every host of ``outcomes``.

    ``outcomes`` has host and numbers of pages, labelled and bad ones (null counts as 0). Sums are taken
    before anything is shuffled, so a host with a third of the pages costs one row per task.
    Hosts without labels get their domain's prior. Without any label the mean is one half.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    sums = lambda: (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = cut(
        outcomes.groupBy("host").agg(F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.sum(F.coalesce("labelled", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad")).withColumn("domain", domain).withColumn("suffix", suffix)
    )
    whole = hosts.agg(*sums()).first()
    mean = whole["bad"] / whole["n"] if whole["n"] else 0.5
    prior = F.col("a") / (F.col("a") + F.col("b"))
    # a suffix may have a third of all domains, and a domain that gives each user a host a third of all hosts
    domains = cut(hosts.groupBy("suffix", "domain").agg(*sums(), F.count("*").alias("hosts")))
    suffixes = cut(shrunk(domains.groupBy("suffix").agg(*sums(), F.count("*").alias("domains")).withColumn("prior", F.lit(float(mean)))))
    domains = cut(shrunk(join_by_size(domains, suffixes.select("suffix", "domains", prior.alias("prior")), ["suffix"], "domains")))
    each = shrunk(join_by_size(hosts, domains.select("suffix", "domain", "hosts", prior.alias("prior")), ["suffix", "domain"], "hosts"))
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return each.select("host", "pages", "n", "bad", (F.col("a") / total).alias("mean"), (F.col("a") / total - F.lit(Z) * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of ``pages``.

    The verdict is the rule's action, where one fits, else block if the host's bound is above
    the threshold. ``outcomes`` should hold every page of ``pages`` (see page_outcomes); a host that
    it lacks is allowed. Null urls have host and path "" and are judged as the host "". Very long urls are read whole, repeated
    pages repeat in the result, other columns are ignored, and an empty table gives none.
    """
    hosts = cut(reputations(outcomes).select("host", "pages", "bound"))
    rows = parsed(pages).select("page_id", "host", "path", rule_of(rules, "text").alias("rule"), rule_of(rules, "action").alias("action"))
    rows = join_by_size(rows, hosts, ["host"], "pages")
    verdict = F.coalesce(F.col("action"), F.when(F.col("bound") > threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("bound", 6).alias("bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, pages, labelled, bad: a page's document is the last number of its url's path.

    A page is bad if its document is labelled low quality or toxic. A document with several
    labels counts as bad if any says so; null labels and unlabelled documents count for nothing.
    Pages are counted by host and document before they meet the labels; those without a number, of
    which there may be any share, don't meet them. A document that many hosts name meets them in many tasks.
    """
    number = F.regexp_extract("path", r"/([0-9]{1,18})[^/]*/?$", 1)
    docs = cut(parsed(pages.select("url")).groupBy("host", F.when(number != "", number.cast("long")).alias("doc_id")).agg(F.count("*").alias("pages")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    marks = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    none = F.lit(0).cast("long")
    numbered = docs.where("doc_id is not null")
    named = cut(numbered.groupBy("doc_id").agg(F.count("*").alias("hosts")).join(marks, "doc_id"))
    marked = join_spread(numbered, named, ["doc_id"], "hosts", ["host"]).select("host", none.alias("pages"), F.col("pages").alias("labelled"), (F.col("pages") * F.col("bad")).alias("bad"))
    return docs.select("host", "pages", none.alias("labelled"), none.alias("bad")).unionByName(marked)
