"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled pages (bad or not) are counted per host. A host's bad rate is a beta posterior whose prior sits at the mean of
the rest of its registered domain, whose prior sits at the rest of its suffix, whose prior sits at all the rest. How
strongly each level is shrunk comes from the data: the beta-binomial's method of moments over the groups of the level
compares how far group rates spread with how far chance alone would spread them; a parent of few pages shrinks no more
than it is known itself. A host is blocked when the lower bound of its posterior (mean less Z standard deviations)
passes the limit, so a few bad pages don't condemn it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import stash, table
from weft.llm.graph import join_counted

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Suffixes of two labels under which names are registered (fixed values), a default: a caller with the whole public
#: list gives it as ``suffixes``. Any other suffix is the last label.
TWO_LABELS = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr", "co.kr"]
Z, LIMIT, STRONGEST = 1.645, 0.5, 1e6


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _registrable(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column, suffixes: list[str] = TWO_LABELS) -> Column:
    two = F.substring_index(_registrable(host), ".", -2)
    return F.when(two.isin(suffixes), two).otherwise(F.substring_index(two, ".", -1))


def domain_of(host: Column, suffixes: list[str] = TWO_LABELS) -> Column:
    bare = _registrable(host)
    return F.when(F.substring_index(bare, ".", -2).isin(suffixes), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); a rule fits its host and all subdomains from its path on."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, mean: Column) -> DataFrame:
    """One row: the prior's strength by the method of moments, from n, bad and the mean each group is shrunk to."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)
    chance = mean * (1 - mean)
    sums = groups.filter("n > 0").agg(F.sum(spread).alias("s"), F.sum(chance).alias("c"), F.sum(chance * F.col("n")).alias("cn"), F.sum("n").cast("double").alias("all"), F.count("*").alias("g"))
    # E[spread] = sum chance + rho * sum (n - 1) chance, with rho = 1 / (strength + 1)
    rho = F.when(F.col("cn") > F.col("c"), F.greatest((F.col("s") - F.col("c")) / (F.col("cn") - F.col("c")), F.lit(1 / (STRONGEST + 1)))).otherwise(1 / (STRONGEST + 1))
    return sums.select(F.coalesce(F.greatest(1 / rho - 1, F.lit(1.0)), F.lit(STRONGEST)).alias("strength"))


def host_reputation(pages: DataFrame, suffixes: list[str] = TWO_LABELS) -> DataFrame:
    """host, pages, n and bad (labelled, labelled bad), rate, spread and bound for every host of ``pages``.

    ``pages`` has host and bad (1, 0 or null for unlabelled). Without any label every rate is 0.5 and no bound passes.
    """
    hosts = stash(pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    # the parent of all suffixes is one row; a parent's table has what its posterior is made of
    parent = hosts.agg(F.lit(0.5).alias("prior"), F.lit(1.0).alias("strength"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    above: list[str] = []
    for level in ("suffix", "domain", "host"):
        keys = [*above, level]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
        if above:  # a suffix such as com has a great part of all hosts
            children = stash(parent.join(groups.groupBy(*above).agg(F.count("*").alias("children")), above))
            groups = join_counted(groups, children, above, "children", groups.count()).drop("children")
        else:
            groups = groups.crossJoin(F.broadcast(parent))
        # a group is shrunk to the rest of its parent, and no more surely than the rest is known
        known = F.col("strength") + F.col("all_n") - F.col("n")
        rest = (F.col("prior") * F.col("strength") + F.col("all_bad") - F.col("bad")) / known
        groups = groups.select(*keys, "n", "bad", "pages", rest.alias("prior"), known.alias("known"))
        groups = stash(groups.crossJoin(F.broadcast(_strength(groups, F.col("prior")))))  # one row beside every group
        groups = groups.withColumn("strength", 1 / (1 / F.col("strength") + 1 / F.col("known")))
        parent = groups.select(*keys, "prior", "strength", F.col("n").alias("all_n"), F.col("bad").alias("all_bad"))
        above = keys
    a, b = F.col("prior") * F.col("strength") + F.col("bad"), (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")
    groups = groups.withColumn("rate", a / (a + b)).withColumn("spread", F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))))
    return groups.select("host", "pages", "n", "bad", "rate", "spread", (F.col("rate") - Z * F.col("spread")).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", rules: list[tuple[str, str]] = RULES, suffixes: list[str] = TWO_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict and bound of every row of ``pages``.

    ``outcomes`` has page_id and bad (0 or 1); a page with several is bad if any is. A null url, or one without
    ``://``, has an empty host and path, which count as a host like others. Repeated rows are judged alike, and each
    counts for its host; an empty table gives an empty result.
    """
    known = outcomes.filter(F.col("bad").isin(0, 1) & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    own = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = stash(own.join(known, "page_id", "left"))
    hosts = stash(host_reputation(seen, suffixes).select("host", "pages", "bound"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = join_counted(seen, hosts, ["host"], "pages", seen.count()).withColumn("rule", rule).withColumn("by_rule", verdict)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bound") > LIMIT, "block").otherwise("allow")).alias("verdict"), "bound")


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label no pages. Labels stand in for crawl outcomes here: that of an id is the outcome of the page with
    this id, bad if low in quality or toxic. They say nothing of a host, so hosts hardly differ and none is blocked."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels)
    return out.select("page_id", "host", "path", "rule", "verdict")


#: The same in DuckDB; suffixes of two labels don't occur in the tables.
ORACLE = r"""
with known as (
  select doc_id as page_id, max(greatest(1 - quality, toxic)) as bad from labels where quality is not null and toxic is not null group by 1
), seen as (
  select p.page_id, translate(coalesce(regexp_extract(p.url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(p.url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, k.bad
  from pages p left join known k using (page_id)
), h as (
  select host, count(*) as pages, count(bad) as n, coalesce(sum(bad), 0) as bad, string_split(bare, '.')[-1] as suffix,
         array_to_string(string_split(bare, '.')[-2:], '.') as domain from (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from seen) group by host, bare
), g0 as (select 0.5 as pp, 1.0 as ps, sum(n) as pn, sum(bad) as pb from h
), g1 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(ps + pn) - sum(n) as known, (any_value(pp * ps + pb) - sum(bad)) / (any_value(ps + pn) - sum(n)) as prior from h, g0 group by suffix
), k1 as (select coalesce(greatest(1 / r - 1, 1.0), 1e6) as kappa from (select case when sum(prior * (1 - prior) * n) > sum(prior * (1 - prior))
    then greatest((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / (sum(prior * (1 - prior) * n) - sum(prior * (1 - prior))), 1 / 1000001.0) else 1 / 1000001.0 end as r from g1 where n > 0)
), s1 as (select suffix, prior as pp, 1 / (1 / kappa + 1 / known) as ps, n as pn, bad as pb from g1, k1
), g2 as (select suffix, domain, sum(n) as n, sum(bad) as bad, any_value(ps + pn) - sum(n) as known, (any_value(pp * ps + pb) - sum(bad)) / (any_value(ps + pn) - sum(n)) as prior from h join s1 using (suffix) group by all
), k2 as (select coalesce(greatest(1 / r - 1, 1.0), 1e6) as kappa from (select case when sum(prior * (1 - prior) * n) > sum(prior * (1 - prior))
    then greatest((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / (sum(prior * (1 - prior) * n) - sum(prior * (1 - prior))), 1 / 1000001.0) else 1 / 1000001.0 end as r from g2 where n > 0)
), s2 as (select suffix, domain, prior as pp, 1 / (1 / kappa + 1 / known) as ps, n as pn, bad as pb from g2, k2
), g3 as (select host, n, bad, ps + pn - n as known, (pp * ps + pb - bad) / (ps + pn - n) as prior from h join s2 using (suffix, domain)
), k3 as (select coalesce(greatest(1 / r - 1, 1.0), 1e6) as kappa from (select case when sum(prior * (1 - prior) * n) > sum(prior * (1 - prior))
    then greatest((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / (sum(prior * (1 - prior) * n) - sum(prior * (1 - prior))), 1 / 1000001.0) else 1 / 1000001.0 end as r from g3 where n > 0)
), ab as (select host, prior / (1 / kappa + 1 / known) + bad as a, (1 - prior) / (1 / kappa + 1 / known) + n - bad as b from g3, k3
), bound as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) as bound from ab
), ruled as (
  select page_id, host, path, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from seen
)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when bound > 0.5 then 'block' else 'allow' end as verdict from ruled join bound using (host)
"""
