"""Run records of batch submissions: duplicates, orphans, the latest, and the checks before a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_REQUESTS = 200


def latest_run(records: DataFrame) -> DataFrame:
    return records.agg(F.max_by(F.struct(*records.columns), F.struct("submitted", "batch_id")).alias("r")).filter("r is not null").select("r.*")


def sent_before(records: DataFrame, digest: str) -> DataFrame:
    """The first record with this digest, if any."""
    same = records.filter(F.col("digest") == digest)
    return same.agg(F.min_by(F.struct(*records.columns), F.struct("submitted", "batch_id")).alias("r")).filter("r is not null").select("r.*")


def orphans(account: DataFrame, records: DataFrame) -> DataFrame:
    """Batches of the account that no local record knows."""
    return account.join(records.select("batch_id"), "batch_id", "left_anti")


class Refused(RuntimeError):
    """A submission that a guard stopped."""


def guard(pending: bool, duplicate: bool, again: bool, requests: int, confirmed: bool, most: int = MAX_REQUESTS) -> bool:
    """Checks in order, before anything is sent; True if the submission may go ahead, False if it only shows its cost."""
    if pending:
        raise Refused("a submission is pending; reconcile it first")
    if duplicate and not again:
        raise Refused("the same requests were sent before")
    if requests > most:
        raise Refused(f"{requests} requests; at most {most} are allowed")
    return confirmed


def newer_or_same(stamp: str | None, present: str | None) -> None:
    """Refuses an extract that is older than the one on disk; stamps are compared as text."""
    if stamp and present and stamp < present:
        raise Refused(f"extract of {stamp} is older than the one of {present}")
