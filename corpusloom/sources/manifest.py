"""The manifest of public documents: scan, validation, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "document_id string, regulator string, title string, source_url string, format string, public boolean, retrieved_at string, sha256 string, resolved_url string"
SOURCE_COLUMNS = [c.split()[0] for c in SOURCE.split(", ")]
# Official hosts by regulator, and formats.
HOSTS = {
    "OSFI": ["www.osfi-bsif.gc.ca", "osfi-bsif.gc.ca"],
    "FINTRAC": ["fintrac-canafe.canada.ca"],
    "OPC": ["www.priv.gc.ca", "priv.gc.ca"],
}
FORMATS = ("html", "pdf")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "host.docker.internal")


def url_allowed(url: Column, hosts: Column) -> Column:
    """https, one of the hosts, no user, port 443 or none. Null or unparsable isn't."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    fine = (
        (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https")
        & F.array_contains(hosts, F.lower(F.try_parse_url(url, F.lit("HOST"))))
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & port.isin("", "443")
    )
    return F.coalesce(fine, F.lit(False))


def local_endpoint(url: Column) -> Column:
    """http on this machine, without user, path, query or fragment."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    fine = (F.lower(part("PROTOCOL")) == "http") & F.regexp_replace(F.lower(part("HOST")), r"[\[\]]", "").isin(*LOCAL_HOSTS) & part("USERINFO").isNull() & F.coalesce(part("PATH"), F.lit("")).isin("", "/") & part("QUERY").isNull() & part("REF").isNull()
    return F.coalesce(fine, F.lit(False))


def hosts_of(regulator: Column) -> Column:
    table = F.create_map(*[x for r, hs in HOSTS.items() for x in (F.lit(r), F.array(*map(F.lit, hs)))])
    return F.element_at(table, regulator)


def checked(sources: DataFrame) -> DataFrame:
    """sources with ``errors``, the names of the rules each row breaks (empty: valid)."""
    hosts = hosts_of(F.col("regulator"))
    rules = {
        "document_id": F.col("document_id").rlike("^[a-z][a-z0-9-]{0,79}$"),
        "regulator": F.col("regulator").isin(*HOSTS),
        "title": F.length("title") >= 1,
        "format": F.col("format").isin(*FORMATS),
        "public": F.col("public"),
        "source_url": url_allowed(F.col("source_url"), hosts),
        "resolved_url": F.coalesce(F.col("resolved_url"), F.lit("")).eqNullSafe(F.lit("")) | url_allowed(F.col("resolved_url"), hosts),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return sources.withColumn("errors", broken)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest file. Empty, invalid or repeated entries are refused."""
    raw = spark.read.option("multiLine", True).schema(f"schema_version int, purpose string, terms_checked_at string, terms map<string,string>, documents array<struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>>").json(path)
    found = checked(raw.select(F.explode("documents").alias("d")).select("d.*"))
    bad = found.agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("distinct"), F.count_if(F.size("errors") > 0).alias("invalid")).first()
    if not bad["n"]:
        raise ValueError("a manifest holds at least one document")
    if bad["distinct"] != bad["n"]:
        raise ValueError("a manifest names each document once")
    if bad["invalid"]:
        raise ValueError(f"{bad['invalid']} manifest entries are invalid")
    return found.drop("errors")


def lookup(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events (document_id, run_id of 32 hex digits) with their source, which must have been downloaded."""
    ready = sources.where("sha256 IS NOT NULL AND retrieved_at IS NOT NULL")
    return events.where(F.col("run_id").rlike("^[0-9a-f]{32}$")).join(ready, "document_id")
