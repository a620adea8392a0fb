"""URL screening and origin allow-lists: narrow column work, no join and no shuffle but the reports and tables of rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions import urls
from feedlake.functions.text import contains_any, ends_with_any
from feedlake.session import stored


def is_private_host(host: Column) -> Column:
    """Lower-case host without port: local names, private or loopback IPv4, private suffixes."""
    a, b = (urls.ipv4_octets(host)[i] for i in (0, 1))
    private = (
        (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (host == "0.0.0.0")
    )
    return host.isin(*C.LOCALHOST_NAMES) | F.coalesce(private, ends_with_any(host, C.PRIVATE_SUFFIXES))


def looks_like_feed(path: Column, query: Column) -> Column:
    low = F.lower(path)
    return (
        contains_any(low, C.FEED_PATH_TEXTS) | ends_with_any(low, C.FEED_PATH_ENDINGS)
        | contains_any(F.lower(query), C.FEED_QUERY_WORDS)
    )


def screen_urls(df: DataFrame, url: str = "url", level: str = "basic") -> DataFrame:
    """Adds ``reason`` (first failed check, NULL when accepted) and ``sanitised_url`` (accepted only).

    ``strict`` adds length, private networks, extensions and injected script to the basic checks, and
    the column ``looks_like_feed``, which is a hint and rejects nothing.
    """
    if level not in ("basic", "strict"):
        raise ValueError(f"unknown level {level!r}")
    u = F.col(url)
    parts = df.withColumns({
        "_scheme": urls.scheme_of(u), "_host": F.lower(urls.host_of(u)),
        "_path": urls.path_of(u), "_query": urls.query_of(u),
    })
    scheme, host = F.col("_scheme"), F.col("_host")
    reason = F.when(u == "", C.URL_EMPTY)
    if level == "strict":
        reason = reason.when(F.octet_length(u) > C.MAX_URL_BYTES, C.URL_TOO_LONG)
    reason = (
        reason.when(~urls.is_parsable(u), C.URL_UNPARSABLE)
        .when(~scheme.isin("", "http", "https"), C.URL_SCHEME)
        .when(host == "", C.URL_HOST)
    )
    if level == "basic":
        reason = reason.when(host.contains("localhost") | host.contains("127.0.0.1"), C.URL_LOCALHOST)
    else:
        parts = parts.withColumns({
            "_name": F.substring_index(host, ":", 1),
            "_decoded": F.lower(urls.decoded_path(F.col("_path"))),
        })
        script = F.exists(
            urls.decoded_query_values(F.col("_query")), lambda v: contains_any(v, C.INJECTION_TEXTS)
        )
        reason = (
            reason.when(is_private_host(F.col("_name")), C.URL_PRIVATE)
            .when(contains_any(F.col("_decoded"), C.SUSPICIOUS_EXTENSIONS), C.URL_EXTENSION)
            .when(script, C.URL_MALICIOUS)
        )
    out = parts.withColumn("reason", reason)
    clean = F.when(F.col("reason").isNull(), urls.sanitised(u, scheme, F.col("_path")))
    out = out.withColumn("sanitised_url", clean)
    if level == "strict":
        out = out.withColumn(
            "looks_like_feed",
            F.when(F.col("reason").isNull(), looks_like_feed(F.col("_decoded"), F.col("_query"))),
        )
    return out.drop("_scheme", "_host", "_path", "_query", "_name", "_decoded")


def screening_report(screened: DataFrame) -> DataFrame:
    return screened.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("urls"))


@dataclass(frozen=True)
class OriginPolicy:
    """Allowed origins per environment; a policy is configuration, so it travels inside the plan."""

    development: tuple[str, ...] = C.DEVELOPMENT_ORIGINS
    staging: tuple[str, ...] = C.STAGING_ORIGINS
    production: tuple[str, ...] = C.PRODUCTION_ORIGINS
    allow_subdomains: bool = False
    domains: tuple[str, ...] = field(default=())

    def allows(self, origin: Column, environment: Column) -> Column:
        env = F.lower(environment)
        return (
            F.when(env.isin("production", "prod"), self._listed(origin, self.production))
            .when(env.isin("staging", "stage"), self._listed(origin, self.staging))
            .otherwise(self._listed(origin, self.development))
        )

    def _listed(self, origin: Column, allowed: tuple[str, ...]) -> Column:
        exact = list(allowed)
        suffixes = []
        if self.allow_subdomains:
            wild = [o[2:] for o in allowed if o.startswith("*.")]
            for domain in (*self.domains, *wild):
                exact += [f"https://{domain}", f"http://{domain}"]
                suffixes.append(f".{domain}")
        return origin.isin(*exact) | ends_with_any(origin, suffixes)


def origin_audit(requests: DataFrame, policy: OriginPolicy) -> DataFrame:
    """Adds ``allowed``: the origin is listed for the request's environment (unknown: development)."""
    origin = F.coalesce("origin", F.lit(""))
    environment = F.coalesce("environment", F.lit(""))
    return requests.withColumn("allowed", (origin != "") & policy.allows(origin, environment))


def origin_rules(spark: SparkSession, policy: OriginPolicy) -> DataFrame:
    """A policy as rows: environment, text, and whether the text is a suffix (else the whole origin)."""
    rows = []
    for environment in ("development", "staging", "production"):
        allowed = getattr(policy, environment)
        rows += [(environment, origin, False) for origin in allowed]
        if policy.allow_subdomains:
            for domain in (*policy.domains, *(o[2:] for o in allowed if o.startswith("*."))):
                rows += [(environment, f"https://{domain}", False), (environment, f"http://{domain}", False), (environment, f".{domain}", True)]
    return spark.createDataFrame(rows, "environment string, text string, suffix boolean")


def origin_audit_by_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`origin_audit` against a table of rules of any size (environment, text, suffix).

    Every distinct origin of an environment meets the rules in one hash join: as it is, and as its
    suffixes from each dot on.  A rule whose suffix doesn't begin with a dot or whose text is null allows
    nothing.
    """
    named = F.lower(F.coalesce("environment", F.lit("")))
    class_of = F.when(named.isin("production", "prod"), "production").when(named.isin("staging", "stage"), "staging").otherwise("development")
    asked = requests.select(class_of.alias("rule_env"), F.coalesce("origin", F.lit("")).alias("asked")).where("asked <> ''").distinct()
    places = F.filter(F.sequence(F.lit(1), F.length("asked")), lambda i: F.substr(F.col("asked"), i, F.lit(1)) == ".")
    suffixes = F.transform(places, lambda i: F.struct(F.substr(F.col("asked"), i).alias("text"), F.lit(True).alias("suffix")))
    whole = F.array(F.struct(F.col("asked").alias("text"), F.lit(False).alias("suffix")))
    keys = asked.select("rule_env", "asked", F.explode(F.concat(whole, suffixes)).alias("k")).select("rule_env", "asked", "k.*")
    known = rules.select(F.col("environment").alias("rule_env"), "text", "suffix").distinct()
    allowed = stored(keys.join(known, ["rule_env", "text", "suffix"], "left_semi").select("rule_env", "asked").distinct().withColumn("allowed", F.lit(True)), "origins")
    marked = requests.withColumns({"rule_env": class_of, "asked": F.coalesce("origin", F.lit(""))})
    return marked.join(allowed, ["rule_env", "asked"], "left").select(*requests.columns, F.coalesce("allowed", F.lit(False)).alias("allowed"))
