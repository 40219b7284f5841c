"""URL filters: explicit rules first, else the empirical-Bayes reputation of the host, in DataFrame functions only.

Labelled outcomes (bad or not) of pages are counted by host. The rate of a host is shrunk to that of its registered domain, a domain's to
that of its suffix, a suffix's to that of all pages: at each level the children of a parent share a beta prior around the parent's
posterior mean. The prior's strength is fitted on the level's own counts by the moments of the beta-binomial distribution: with n outcomes, y of them
bad, and the mean m of the parent, E[(y - n m)^2] = n m (1 - m) (1 + (n - 1) rho). A host is blocked if its rate of bad pages exceeds `limit` by
a one-sided posterior bound (mean - z deviations), so that few or no labels never block.

Counts are combined map-side by host; what follows works on one row a host. Rules meet hosts by an equi-join on the host and its parents.

Defined results: a null url, or one without ://, has an empty host and path, which share a reputation of their own; a page is as bad as its worst label,
labels without an outcome count as none; labels of no page and pages without labels are fine, without any labels nothing is blocked by the method; rows that repeat are judged each;
of rules that fit, that with the most characters wins, then that with the longer host, then block before allow; a rule without a host fits nothing; a null page_id has no label;
an empty table gives an empty result; other columns are ignored. The rules that fit one host travel as one list with it, which the list of rules bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, sent_side, written

#: Suffixes of two labels under which names are registered (a parameter); any other suffix is one label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bound's deviations (one-sided 95 %), the rate above which a host is blocked, and the least and most correlation of a parent's children: a prior weighs as much as 3 to 999 outcomes.
Z, LIMIT, LEAST_RHO, MOST_RHO = 1.645, 0.5, 0.001, 0.25
#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Address of a machine instead of a name.
NUMERIC = r"^[0-9.]+$|^\["


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(rule, verdict) of pairs."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules))))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and its suffix, without user and port; an address is its own domain, without suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    double, numeric = last(2).isin(*suffixes), name.rlike(NUMERIC)
    return F.when(numeric, name).when(double, last(3)).otherwise(last(2)), F.when(numeric, "").when(double, last(2)).otherwise(last(1))


def _shrunk(children: DataFrame, mean: str, to: str) -> DataFrame:
    """Adds the children's posterior mean and the weight of prior and outcomes, from n, y and the parent's mean."""
    m, n, y = F.col(mean), F.col("n"), F.col("y")
    moments = children.agg(
        F.sum((y - n * m) ** 2 - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("pairs"))
    rho = F.when(F.col("pairs") > 0, F.col("over") / F.col("pairs")).otherwise(0)
    strength = moments.select((1 / F.least(F.lit(MOST_RHO), F.greatest(F.lit(LEAST_RHO), F.round(rho, 6))) - 1).alias("strength"))
    weight = F.col("strength") + n
    return children.crossJoin(F.broadcast(strength)).withColumn(to, (F.col("strength") * m + y) / weight).withColumn("weight", weight).drop("strength")  # one row


def reputations(hosts: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, y, rate, bound) from (host, n, y): outcomes, bad ones, posterior mean of the bad rate and its lower bound."""
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = written(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "y"), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "domains")
    total = domains.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).select(F.when(F.col("n") > 0, F.col("y") / F.col("n")).otherwise(0.0).alias("all"))
    by_suffix = _shrunk(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).crossJoin(F.broadcast(total)), "all", "of_suffix")  # one row
    by_suffix = written(by_suffix.select("suffix", "of_suffix"), "suffixes")
    by_domain = written(_shrunk(domains.join(sent_side(by_suffix), "suffix"), "of_suffix", "of_domain").select("domain", "suffix", "of_domain"), "domain-rates")
    by_host = _shrunk(hosts.join(sent_side(by_domain), ["domain", "suffix"]), "of_domain", "rate")
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return by_host.select("host", "n", "y", "rate", bound.alias("bound"))


def _rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of the hosts that rules fit; rules: (verdict, rule), rule: host and path."""
    slash = F.locate("/", F.col("rule"))
    at = F.when(slash > 0, F.col("rule").substr(F.lit(1), slash - 1)).otherwise(F.col("rule"))
    given = rules.where("rule is not null and verdict in ('allow', 'block')").select("rule", "verdict", F.translate(at, UPPER, LOWER).alias("at"), F.when(slash > 0, F.col("rule").substr(slash, F.length("rule"))).otherwise("").alias("start"))
    given = written(given.where("at <> ''").distinct(), "rules")
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(parents).alias("at")).distinct().join(sent_side(given), "at")
    ordered = F.struct(F.length("rule").alias("size"), F.length("at").alias("of_host"), (F.col("verdict") == "block").alias("blocks"), "start", "rule", "verdict")
    return each.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(ordered))).alias("rules"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", of: str = "doc_id", bad: Column | None = None,
    limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labels, n_bad, bound) of every page; the last three are the host's.

    outcomes: labels by page (column `of`), of which `bad` says whether the page is bad; rules: (rule, verdict).
    """
    prepare(pages.sparkSession)
    bad = F.col("bad") if bad is None else bad
    seen = pages.select(F.col(key).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = outcomes.select(F.col(of).cast("long").alias("page_id"), bad.cast("long").alias("bad")).where("page_id is not null and bad is not null")
    labels = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = seen.select("page_id", "host").join(labels, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    known = written(reputations(counted, z, suffixes), "reputations")
    of_host = written(known.join(_rules_of(known.select("host"), rules), "host", "left").select("host", "n", "y", F.round("bound", 6).alias("bound"), "rules"), "judged-hosts")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    found = seen.join(sent_side(of_host), "host").withColumn("first", F.try_element_at(fits, F.lit(1)))
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", by_method).alias("verdict"), F.col("n").alias("n_labels"), F.col("y").alias("n_bad"), "bound",
    )
