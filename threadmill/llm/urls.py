"""URL filter: curated rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and public suffix. Each level's rate is
shrunk towards its parent's posterior mean by a beta-binomial prior; a level's prior strength comes
from the spread of its own groups by the method of moments. A page that no rule fits is blocked if
even the upper bound of its host's posterior is below the wanted rate. The bound is the normal
approximation of the beta posterior's quantile, mean plus Z standard deviations: SQL has no beta
quantile. It is close for hosts of many labels; for few, the prior decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (host, path, verdict): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Public suffixes of several labels; any other suffix is the last label. A full list, with its ``*.`` and ``!`` entries, can be passed instead.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr")
#: No public suffix has more labels.
MAX_SUFFIX_LABELS = 5
#: Rules are compiled into one expression, so their number is bounded.
MAX_RULES = 1000
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
#: A host stays unless the posterior's mean plus Z standard deviations is below LEAST_RATE.
Z, LEAST_RATE = 1.2816, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def site_of(host: Column) -> Column:
    """The host without user, port, brackets and a dot at its end: what a reputation is of."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\[(.*)\]$", "$1"), r"\.+$", "")


def registered_domain(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix; a site of one label is its own domain and suffix, an IP address its own domain."""
    last = lambda n: F.call_function("substring_index", site, F.lit("."), F.lit(-n))
    known = lambda c: c.isin(*suffixes) if suffixes else F.lit(False)
    labels = F.lit(1)
    for n in range(2, MAX_SUFFIX_LABELS + 1):
        long = F.size(F.split(site, r"\.")) >= n
        listed = known(last(n)) | known(F.concat(F.lit("*."), last(n - 1)))
        labels = F.when(long & known(F.concat(F.lit("!"), last(n))), F.lit(n - 1)).when(long & listed, F.lit(n)).otherwise(labels)
    by_labels = lambda k: F.call_function("substring_index", site, F.lit("."), -k)
    is_ip = site.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | site.contains(":")
    return F.when(is_ip, site).otherwise(by_labels(labels + 1)), F.when(is_ip, F.lit("ip")).otherwise(by_labels(labels))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, of equally long ones the last; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules, not {len(rules)}")
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _posterior(groups: DataFrame, mean: str) -> DataFrame:
    """Add ``a`` and ``b`` of each group's posterior; the level's prior strength is one number for all."""
    m = F.greatest(F.least(F.col(mean), F.lit(0.999)), F.lit(0.001))
    seen = groups.where("n > 0").select(F.col("n").cast("double").alias("n"), (F.col("good") / F.col("n")).alias("rate"), m.alias("m"))
    k, total, squares, chi = seen.agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n") * (F.col("rate") - F.col("m")) * (F.col("rate") - F.col("m")) / (F.col("m") * (1 - F.col("m")))), F.lit(0.0)),
    ).first()
    room = total - squares / total - (k - 1) if total else 0.0
    rho = max((chi - (k - 1)) / room, 1e-4) if room > 0 else 1e-4
    strength = min(max(1 / rho - 1, MIN_STRENGTH), MAX_STRENGTH)
    return groups.withColumn("a", strength * m + F.col("good")).withColumn("b", strength * (1 - m) + F.col("n") - F.col("good"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per site of ``pages``: site, n, good, mean and upper bound of its posterior.

    ``outcomes`` has page_id, n and good: the number of labels of a page and how many of them are
    good. Without any label every site has the same mean, one half. Pages without id have no labels.
    """
    host, _ = host_and_path(F.col("url"))
    sites = (
        pages.select("page_id", site_of(host).alias("site")).join(outcomes, "page_id", "left")
        .groupBy("site").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    domain, suffix = registered_domain(F.col("site"), suffixes)
    sites = cut(sites.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    good, n = by_suffix.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_suffix = _posterior(by_suffix.withColumn("m_all", F.lit((good + 1) / (n + 2))), "m_all").select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m_suffix"))
    domains = _posterior(domains.join(by_suffix, "suffix"), "m_suffix").select("domain", "suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m_domain"))
    posterior = _posterior(sites.join(domains, ["domain", "suffix"]), "m_domain")
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return posterior.select("site", "n", "good", F.round(a / (a + b), 9).alias("mean"), F.round(a / (a + b) + Z * deviation, 9).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_rate: float = LEAST_RATE, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, reputation.

    A null url, or one without ``://``, has an empty host and path, which is a host of its own. Repeated
    rows are judged alike and each counts; a null page_id is carried along. Other columns are ignored.
    An empty table gives no rows; without outcomes all hosts are allowed. A hot host is counted before
    the shuffle, and meets its one reputation row in an equi-join, which AQE can split.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url")
    judged = read.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), site_of(F.col("host")).alias("site"))
    reputation = host_reputation(read, outcomes, suffixes).select("site", "mean", "upper")
    by_method = F.when(F.col("upper") < least_rate, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(reputation, "site", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.round("mean", 6).alias("reputation"))


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages, from the labels of the same id: good is of quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), labelled_outcomes(table(spark, sf_dir, "labels")))


def _level_sql(name: str, groups: str, mean: str) -> str:
    """The groups of a level with the strength of its prior and the posterior's ``a`` and ``b``."""
    return f"""
{name}_m AS (SELECT *, greatest(least({mean}, 0.999), 0.001)::DOUBLE AS m FROM {groups}),
{name}_k AS (
  SELECT coalesce(sum(n), 0)::DOUBLE AS total, coalesce(sum(n * n), 0)::DOUBLE AS squares, count(*) AS k, coalesce(sum(n * (good::DOUBLE / n - m) * (good::DOUBLE / n - m) / (m * (1 - m))), 0) AS chi
  FROM {name}_m WHERE n > 0),
{name}_s AS (
  SELECT least(greatest(1 / CASE WHEN total > 0 AND total - squares / total - (k - 1) > 0 THEN greatest((chi - (k - 1)) / (total - squares / total - (k - 1)), 1e-4) ELSE 1e-4 END - 1, {MIN_STRENGTH}), {MAX_STRENGTH}) AS strength
  FROM {name}_k),
{name} AS (SELECT g.*, strength * m + good AS a, strength * (1 - m) + n - good AS b FROM {name}_m g, {name}_s)"""


def _sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [(h, p, v) for h, p, v in sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1])))]
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'" for h, p, v in fits) + " END"
    listed = ", ".join(f"'{x}'" for x in SUFFIXES)
    return rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM pages),
p AS (SELECT page_id, {lower.format("x.h")} AS host, x.p AS path FROM u),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^\[(.*)\]$', ''), '\.+$', '') AS site FROM p),
labelled AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 1 AND coalesce(toxic, 0) = 0)::INT) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
counted AS (SELECT site, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good FROM s LEFT JOIN labelled USING (page_id) GROUP BY site),
split AS (SELECT *, string_split(site, '.') AS l, regexp_matches(site, '^[0-9]+(\.[0-9]+){{3}}$') OR contains(site, ':') AS ip FROM counted),
known AS (SELECT *, CASE WHEN len(l) >= 2 AND array_to_string(l[-2:], '.') IN ({listed}) THEN 2 ELSE 1 END AS k FROM split),
sites AS (SELECT site, n, good, CASE WHEN ip THEN site ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain, CASE WHEN ip THEN 'ip' ELSE array_to_string(l[greatest(len(l) - k + 1, 1):], '.') END AS suffix FROM known),
by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM sites GROUP BY ALL),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM by_domain GROUP BY suffix),
whole AS (SELECT (coalesce(sum(good), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS m_all FROM by_suffix),
suffix_in AS (SELECT by_suffix.*, m_all FROM by_suffix, whole),{_level_sql("at_suffix", "suffix_in", "m_all")},
domain_in AS (SELECT by_domain.*, a / (a + b) AS m_suffix FROM by_domain JOIN (SELECT suffix, a, b FROM at_suffix) USING (suffix)),{_level_sql("at_domain", "domain_in", "m_suffix")},
site_in AS (SELECT sites.*, a / (a + b) AS m_domain FROM sites JOIN (SELECT domain, suffix, a, b FROM at_domain) USING (domain, suffix)),{_level_sql("at_site", "site_in", "m_domain")},
reputation AS (SELECT site, round(a / (a + b), 9) AS mean, round(a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS upper FROM at_site)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, coalesce({case(lambda h, p, v: v)}, CASE WHEN upper < {LEAST_RATE} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS reputation
FROM s LEFT JOIN reputation USING (site)
"""


SQL = _sql()
