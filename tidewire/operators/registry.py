"""Source registry: routing by type and site rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.urls import host_of

# ---- fixed values -----------------------------------------------------------
SCHEDULED_TYPES = ["rss", "static"]
PUBLISHED = "meta[property='article:published_time']"
# site: landing url, list selectors, allowed paths, allowed domains, date selectors, feed url
SITE_RULES = {
    "openai.com": (
        None,
        ["article a[href]", "a[href^='/news/']", "a[href^='/blog/']", "[data-component='Card'] a[href]"],
        ["/news/", "/blog/"], ["openai.com", "www.openai.com"],
        [PUBLISHED, "meta[name='date']", "time[datetime]"], None),
    "blog.google": (
        None,
        ["a[href^='/blog/']", "a[href^='/updates/']", "article a[href]"],
        ["/blog/", "/updates/", "/articles/"], ["blog.google"],
        ["meta[itemprop='datePublished']", "time[datetime]"], None),
    "anthropic.com": (
        None,
        ["a[href^='/news/']", "article a[href]", "[class*='ArticleCard'] a[href]"],
        ["/news/", "/blog/", "/updates/"], ["anthropic.com", "www.anthropic.com"],
        [PUBLISHED, "time[datetime]"], None),
    "x.ai": (
        None,
        ["a[href^='/news/']", "article a[href]", "[class*='news-card'] a[href]"],
        ["/news/", "/blog/"], ["x.ai", "www.x.ai"],
        [PUBLISHED, "time[datetime]"], None),
    "nvidia.com": (
        "https://nvidianews.nvidia.com/news",
        ["a[href*='/news/']", ".news-listing__item a[href]", ".c-news-list__item a[href]"],
        ["/news/"], ["nvidianews.nvidia.com", "www.nvidia.com", "nvidia.com"],
        [PUBLISHED, "meta[name='pubdate']", "time[datetime]"], None),
    "microsoft.com": (
        "https://blogs.microsoft.com/ai/",
        ["article a[href]", "a[href*='/ai/']", ".c-post-list a[href]"],
        ["/ai/", "/ai-blog/"], ["blogs.microsoft.com", "www.microsoft.com", "microsoft.com"],
        [PUBLISHED, "meta[name='publish-date']", "time[datetime]"], None),
    "finextra.com": (
        None,
        [".news-listing a[href]", "a[href*='/newsarticle/']", "article a[href]"],
        ["/newsarticle/", "/pressarticle/"], ["finextra.com", "www.finextra.com"],
        [PUBLISHED, "meta[name='date']", "time[datetime]"], None),
    "savanta.com": (
        None,
        ["a[href*='/industries/financial-services/']", ".cards-grid a[href]", "article a[href]"],
        ["/industries/financial-services", "/insights/", "/news/"], ["savanta.com", "www.savanta.com"],
        [PUBLISHED, "meta[name='date']", "time[datetime]"], None),
    "idc.com": (None, [], None, None, [], "https://www.idc.com/rss/idcpressreleases.xml"),
}
MAX_LINKS_STATIC = 50
MAX_LINKS_DYNAMIC = 20
# ---- end of fixed values ----------------------------------------------------

RULE_TYPE = ("site string, landing_url string, list_selectors array<string>, allow array<string>,"
             " allowed_domains array<string>, date_selectors array<string>, feed_url string")


def site_rules(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SITE_RULES.items()], RULE_TYPE)


def route_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled sources that can be scheduled, and enabled ones that cannot."""
    live = sources.where("enabled")
    known = F.col("type").isin(*SCHEDULED_TYPES)
    return live.where(known), live.where(~known)


def with_site_rule(sources: DataFrame) -> DataFrame:
    """Rule by parser name, else by domain; without one the own domain is allowed.

    The rule table is the fixed list above, nine rows, hence broadcast.
    """
    domain = F.regexp_replace(F.lower(host_of(F.col("url"))), r"^www\.", "")
    rules = site_rules(sources.sparkSession)
    fields = [c for c in rules.columns if c != "site"]

    def named(prefix: str) -> DataFrame:
        return F.broadcast(rules.select(F.col("site").alias(f"{prefix}_site"),
                                        F.struct(*fields).alias(f"{prefix}_rule")))

    keyed = sources.withColumn("domain", domain).withColumn(
        "_key", F.coalesce(F.nullif(F.lower("parser"), F.lit("")), F.col("domain")))
    both = (keyed.join(named("own"), F.col("_key") == F.col("own_site"), "left")
            .join(named("dom"), F.col("domain") == F.col("dom_site"), "left")
            .withColumn("_rule", F.coalesce("own_rule", "dom_rule")))
    return (both.withColumn("rule_site", F.coalesce("own_site", "dom_site"))
            .withColumns({c: F.col(f"_rule.{c}") for c in fields})
            .withColumn("allowed_domains", F.coalesce(
                "allowed_domains", F.array(F.col("domain"), F.concat(F.lit("www."), F.col("domain")))))
            .withColumn("request_url", F.coalesce("landing_url", "url"))
            .withColumn("mode", F.when(F.col("feed_url").isNotNull()
                                       | F.lower("request_url").rlike(r"(\.xml|/rss)$"), "rss").otherwise("html"))
            .drop("_key", "_rule", "own_site", "own_rule", "dom_site", "dom_rule"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Row with a key; the equality reaches the scan."""
    return df.where(F.col(key) == value).limit(1)
