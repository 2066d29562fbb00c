"""Pseudonyms for identifiers and scrubbing of personal data from texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.semantics import ascii_regex, trim_all
from talkloom.plans.fixed import ACCOUNT, CLEAR_AGENTS, DOMAIN, RESIDUAL, SCRUB_CODES, SCRUB_SQL, UUID


def scrub(text: Column, variant: str = "sql") -> Column:
    """``text`` with personal data replaced by placeholders; later patterns see what earlier ones left.

    ``sql`` masks bare log-in addresses, ``codes`` masks one-time codes instead and leaves blank texts alone.
    """
    rules = {"sql": SCRUB_SQL, "codes": SCRUB_CODES}[variant]
    return reduce(lambda t, rule: F.regexp_replace(t, ascii_regex(rule[0]), rule[1].replace("$", "\\$")), rules, text)


def entities(text: Column) -> Column:
    """Domains, account numbers and UUIDs masked; names need a model and stay."""
    out = F.regexp_replace(text, ascii_regex(UUID), "[ACCOUNT_ID]")
    out = F.regexp_replace(out, ascii_regex(ACCOUNT), "[ACCOUNT_ID]")
    return F.regexp_replace(out, ascii_regex(DOMAIN), "[DOMAIN]")


def number_placeholders(text: Column) -> Column:
    """Every [TAG] as [TAG_1]: numbers are kept by tag, so they never pass 1."""
    return F.regexp_replace(text, r"\[(PERSON|EMAIL|PHONE|LOCATION|DOMAIN|ACCOUNT_ID|CREDENTIAL|URL|IP|API_KEY|OTP)\]", "[$1_1]")


def hashed(x: Column) -> Column:
    return F.sha2(x, 256)


def pseudonymise(messages: DataFrame, clear_agents: list[str] | None = None) -> DataFrame:
    """Messages with hashed identifiers, the hash of the e-mail for the e-mail, and scrubbed content."""
    clear = CLEAR_AGENTS if clear_agents is None else clear_agents
    return messages.select(
        hashed(F.col("conversation_id").cast("string")).alias("conversation_id"),
        hashed(F.col("client_id").cast("string")).alias("client_id"),
        hashed(F.lower(trim_all(F.coalesce("clients_email", F.lit("no_email"))))).alias("client_id_email_hash"),
        F.when(F.col("agent").isin(clear), F.col("agent")).otherwise(hashed(F.lower(trim_all(F.col("agent"))))).alias("agent"),
        hashed(F.lower(trim_all(F.col("client_name")))).alias("client_name"),
        "conversation_start_date", "rating", "agreements_subscription", "category", "message_date", "agent_or_bot",
        scrub(F.col("content")).alias("content"),
    )


def residual_scan(df: DataFrame, text: str) -> DataFrame:
    """(risk_type, hits, status): rows that still match each of the patterns, counted in one pass."""
    n = len(RESIDUAL)
    counts = df.agg(*[F.count_if(F.col(text).rlike(ascii_regex(p))).alias(k) for k, p in RESIDUAL])
    rows = counts.select(F.stack(F.lit(n), *[x for k, _ in RESIDUAL for x in (F.lit(k), F.col(k))]).alias("risk_type", "hits"))
    return rows.withColumn("status", F.when(F.col("hits") == 0, "CLEAN").otherwise("REVIEW"))
