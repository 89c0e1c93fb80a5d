"""Tenants: keys, rules, selections, destinations and the document catalogue."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from idloom import dims


def key_digest(secret: Column) -> Column:
    return F.sha2(secret, 256)


@F.pandas_udf(StringType())
def hmac_sha256(body: pd.Series, secret: pd.Series) -> pd.Series:
    """Lower-case hex HMAC-SHA256; null if either side is null."""
    return pd.Series([None if b is None or s is None else hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() for b, s in zip(body, secret, strict=True)])


def issue_keys(requests: DataFrame) -> DataFrame:
    """Key records from requests with a secret: 17 characters are shown, only the digest is kept."""
    return requests.withColumns({"prefix": F.substring("secret", 1, 17), "digest": key_digest(F.col("secret"))}).drop("secret")


def authenticate(attempts: DataFrame, keys: DataFrame, applications: DataFrame, as_of: str) -> DataFrame:
    """(attempt columns, application_id) of attempts whose digest belongs to a key that is neither revoked nor expired
    (ISO texts compare in time order) of an enabled application."""
    live = keys.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    ok = live.join(applications.where("enabled").select(F.col("id").alias("application_id")), "application_id").select("digest", "application_id")
    return attempts.join(ok, "digest")


def last_used(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """``keys`` with the time of their last use."""
    return keys.drop("last_used_at").join(uses.groupBy("digest").agg(F.max("at").alias("last_used_at")), "digest", "left")


def rule_problems(mode: Column, documents: Column, required: Column, count: Column) -> Column:
    """Names of what is wrong with a tenant's document rules."""
    required = F.coalesce(required, F.array().cast("array<string>"))
    n = F.size(documents)
    checks = {
        "mode": ~mode.isin("all", "optional", "exact"),
        "documents": (n < 1) | (n > len(dims.KINDS)) | (F.size(F.array_except(documents, F.array(*map(F.lit, dims.KINDS)))) > 0),
        "unique": (F.size(F.array_distinct(documents)) != n) | (F.size(F.array_distinct(required)) != F.size(required)),
        "mandatory": F.size(F.array_except(required, documents)) > 0,
        "count": (mode == "exact") & (count.isNull() | (count > n) | (count < F.size(required)) | (count < 1)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in checks.items()]))


def policy(mode: Column, documents: Column, required: Column, count: Column) -> Column:
    """selection, required documents and the least and greatest number of documents that a tenant's rules ask for."""
    n, required = F.size(documents), F.coalesce(required, F.array().cast("array<string>"))
    whole, exact = mode == "all", mode == "exact"
    return F.struct(
        F.when(whole, "all").when(exact, "exact").otherwise("minimum").alias("selection"),
        F.when(whole, documents).otherwise(required).alias("required"),
        F.when(whole, n).when(exact, count).otherwise(F.greatest(F.lit(1), F.size(required))).cast("int").alias("least"),
        F.when(exact, count).otherwise(n).cast("int").alias("most"),
    )


def selection_problem(chosen: Column, rule: Column, allowed: Column) -> Column:
    """Why a choice of documents is refused, or null."""
    foreign = F.size(F.array_except(chosen, allowed)) > 0
    return (
        F.when(F.size(F.array_distinct(chosen)) != F.size(chosen), "duplicate")
        .when(F.size(F.array_except(rule["required"], chosen)) > 0, "mandatory_missing")
        .when(F.size(chosen) > rule["most"], "too_many")
        .when((rule["selection"] == "all") & ((F.size(chosen) != F.size(allowed)) | foreign), "not_all")
        .when((F.size(chosen) < rule["least"]) | foreign, "too_few_or_not_allowed")
    )


def application_problems(name: Column, *urls: Column) -> Column:
    """Names of what is wrong with a tenant's name (2 to 100 characters) and destinations (HTTP(S), no credentials)."""
    trimmed = F.length(F.trim(name))
    out = [F.when(F.coalesce(~trimmed.between(2, 100), F.lit(True)), F.lit("name"))]
    for i, url in enumerate(urls):
        good = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False)) & F.try_parse_url(url, F.lit("USERINFO")).isNull() & (F.length(url) <= 2048)
        out.append(F.when(url.isNotNull() & ~good, F.lit(f"url{i}")))
    return F.array_compact(F.array(*out))


def public_application(applications: DataFrame) -> DataFrame:
    """Without secrets, but saying whether they exist."""
    return applications.withColumns({"webhook_configured": F.col("webhook_secret").isNotNull() & (F.col("webhook_secret") != ""), "imported": F.col("legacy").isNotNull()}).drop("webhook_secret", "legacy")


def catalogue(adapters: DataFrame, served: DataFrame) -> DataFrame:
    """(kind, available): whether all types that a kind needs are served. ``adapters`` has (kind, type)."""
    have = served.select("type").distinct().withColumn("_have", F.lit(True))
    return adapters.join(have, "type", "left").groupBy("kind").agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("available"))


def unknown_types(adapters: DataFrame, served: DataFrame) -> DataFrame:
    """Served types that no kind needs."""
    return served.join(adapters.select("type").distinct(), "type", "left_anti")


def destinations(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """``sessions`` with the url of their destination, ``main`` where none is named. ``targets`` has (application_id,
    destination_id, url)."""
    named = sessions.withColumn("destination_id", F.coalesce("destination_id", F.lit("main")))
    return named.join(targets.select("application_id", "destination_id", "url"), ["application_id", "destination_id"], "left")


def import_once(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The incoming rows that don't exist yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def revoke(keys: DataFrame, revocations: DataFrame, keep_first: bool = False) -> DataFrame:
    """``keys`` with revocation times from (id, at): the last one counts, or with ``keep_first`` the one there was."""
    last = revocations.groupBy("id").agg(F.max("at").alias("_at"))
    now = F.coalesce("revoked_at", "_at") if keep_first else F.coalesce("_at", "revoked_at")
    return keys.join(last, "id", "left").withColumn("revoked_at", now).drop("_at")


def unavailable_documents(applications: DataFrame, available: DataFrame) -> DataFrame:
    """(id, kind) of documents that a tenant's rules name and the catalogue doesn't offer."""
    named = applications.select("id", F.explode("documents").alias("kind")).distinct()
    return named.join(available.where("available").select("kind"), "kind", "left_anti").select("id", "kind")


def insecure_destinations(applications: DataFrame, *urls: str) -> DataFrame:
    """(id, url) of destinations that aren't HTTPS."""
    each = applications.select("id", F.explode(F.array(*urls)).alias("url")).where("url IS NOT NULL")
    return each.where(F.coalesce(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))) != "https", F.lit(True)))


def configuration_problems(clients: DataFrame, required: DataFrame, known_fields: list[str]) -> DataFrame:
    """(subject, problem, detail): required fields and policies that don't exist, ids and keys used twice, weak secrets."""
    row = lambda df, subject, problem, detail: df.select(subject.cast("string").alias("subject"), F.lit(problem).alias("problem"), detail.alias("detail"))
    policies = [p[0] for p in dims.POLICIES]
    parts = [
        row(required.where(~F.col("field").isin(known_fields)), F.col("kind"), "unknown_field", F.col("field")),
        row(clients.select("id", F.explode("policies").alias("p")).where(~F.col("p").isin(policies)), F.col("id"), "unknown_policy", F.col("p")),
        row(clients.groupBy("id").count().where("count > 1"), F.col("id"), "id_twice", F.lit(None).cast("string")),
        row(clients.groupBy("api_key").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1"), F.col("id"), "key_twice", F.lit(None).cast("string")),
        row(clients.where(F.length("api_key") < 32), F.col("id"), "weak_secret", F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def consume_tokens(issued: DataFrame, uses: DataFrame) -> DataFrame:
    """(use columns, accepted): the first use of a token within its life is accepted, every other one is not. ``issued``
    has (token, expires_at_ms), ``uses`` (use_id, token, at_ms)."""
    known = uses.join(issued.select("token", "expires_at_ms"), "token", "left")
    live = F.coalesce(F.col("at_ms") < F.col("expires_at_ms"), F.lit(False))
    first = F.min(F.when(live, F.struct("at_ms", "use_id"))).over(Window.partitionBy("token"))
    return known.withColumn("_first", first).select("use_id", "token", "at_ms", F.coalesce(live & (F.struct("at_ms", "use_id") == F.col("_first")), F.lit(False)).alias("accepted"))
