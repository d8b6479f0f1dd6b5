"""Refresh tokens as a log of events, and health of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reused(presented: DataFrame) -> DataFrame:
    """Families of which a token was presented after it had been rotated: family_id, at (first such time), reuses.

    ``presented``: family_id, token_hash, at, seq. The first presentation rotates a token, each later one is a reuse.
    """
    nth = F.row_number().over(Window.partitionBy("family_id", "token_hash").orderBy("at", "seq"))
    return presented.withColumn("__n", nth).where("__n > 1").groupBy("family_id").agg(F.min("at").alias("at"), F.count("*").alias("reuses"))


def revoke(tokens: DataFrame, named: DataFrame, by: str = "family_id") -> DataFrame:
    """``tokens`` with all of the ``named`` families revoked; by token_hash one token, by user_id all of a user."""
    hit = named.select(by, F.lit(True).alias("__hit")).distinct()
    return tokens.join(hit, by, "left").withColumn("revoked", F.col("revoked") | F.col("__hit").isNotNull()).drop("__hit")


def rotate(tokens: DataFrame, presented: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens after each presentation (token_hash, successor) of a live one: the old revoked, the successor added with
    the same family, user and expiry. Also what becomes of each presentation: rotated, reuse, expired or unknown.

    ``presented`` has one row for a token and a column ``now``.
    """
    seen = presented.join(tokens, "token_hash", "left")
    outcome = F.when(F.col("family_id").isNull(), "unknown").when(F.col("revoked"), "reuse").when(F.col("expires_at") < F.col("now"), "expired").otherwise("rotated")
    seen = seen.withColumn("outcome", outcome)
    done = seen.where("outcome = 'rotated'")
    old = tokens.join(done.select("token_hash", F.lit(True).alias("__hit")), "token_hash", "left").withColumn("revoked", F.col("revoked") | F.col("__hit").isNotNull()).drop("__hit")
    successors = done.select(*[(F.col("successor") if c == "token_hash" else F.lit(False) if c == "revoked" else F.col(c)).alias(c) for c in tokens.columns])
    return old.unionByName(successors), seen.select("token_hash", "outcome")


def live(tokens: DataFrame, now) -> DataFrame:
    """Tokens that haven't expired."""
    return tokens.where(F.col("expires_at") >= F.lit(now))


def purge(tokens: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Tokens that haven't expired, and how many had (one row, ``purged``)."""
    return live(tokens, now), tokens.where(F.col("expires_at") < F.lit(now)).agg(F.count("*").alias("purged"))


def user_of_token(presented: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """The user (user_id, ...) of each presented token; a token or user that isn't there gives no row."""
    return presented.select("token_hash").join(tokens.select("token_hash", "user_id"), "token_hash").join(users, "user_id")


def user_of_account(asked: DataFrame, accounts: DataFrame, users: DataFrame, link: bool = False) -> DataFrame:
    """(request_id, outcome, user_id) of sign-ins (request_id, provider, subject, email) by another provider.

    ``known``: the account belongs to a user; ``missing_user``: to one that is gone; ``linked``: the address is a
    user's, whose account it becomes; ``has_password``: likewise, but the user has a password and ``link`` is off;
    ``new``: a user is to be made. ``accounts``: provider, subject, user_id; ``users``: user_id, email in lower case
    and unique, has_password.
    """
    rows = asked.withColumn("email", F.lower(F.trim("email"))).join(accounts.select("provider", "subject", F.col("user_id").alias("__account")), ["provider", "subject"], "left")
    rows = rows.join(users.select(F.col("user_id").alias("__account"), F.col("user_id").alias("__known")), "__account", "left").join(users.select("email", F.col("user_id").alias("__mail"), "has_password"), "email", "left")
    locked = F.coalesce("has_password", F.lit(False)) & F.lit(not link)
    outcome = F.when(F.col("__known").isNotNull(), "known").when(F.col("__account").isNotNull(), "missing_user").when(F.col("__mail").isNull(), "new").when(locked, "has_password").otherwise("linked")
    return rows.select("request_id", outcome.alias("outcome"), F.when(outcome == "known", F.col("__known")).when(outcome == "linked", F.col("__mail")).alias("user_id"))


def readiness(components: DataFrame, by: str) -> DataFrame:
    """ready: all required components healthy, and none draining; alive: no required one failed."""
    required = F.coalesce(F.col("required"), F.lit(True))
    return components.groupBy(by).agg((F.bool_and(~required | (F.col("state") == "healthy")) & ~F.bool_or(F.coalesce("draining", F.lit(False)))).alias("ready"), F.bool_and(~required | (F.col("state") != "failed")).alias("alive"))
