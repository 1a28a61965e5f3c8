"""Candidates of a search: prefilter, outcomes, acceptance, provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.urls import candidate, host
from marlstone.operators.sequence import first_seen

REASONS = ("invalid_url", "url_pattern", "missing_title", "missing_location", "missing_date", "past_date")
SEED_OUTCOMES = ("candidate", "duplicate", "robots_unavailable", "robots_disallowed", "fetch_failed", "not_html", "malformed", "budget", "deadline", "not_attempted")


def prefilter_reason(url: Column, title: Column, location: Column, date: Column, pattern: str, today: str) -> Column:
    """Why a candidate is dropped, by the first requirement that fails; null if it stays."""
    day = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return (
        F.when(~F.coalesce(F.regexp_like(url, F.lit("^https?://[^/@\\s]+")), F.lit(False)), "invalid_url")
        .when(~F.regexp_like(url, F.lit(pattern)), "url_pattern")
        .when(blank(title), "missing_title")
        .when(blank(location), "missing_location")
        .when(day.isNull(), "missing_date")
        .when(day < F.lit(today).cast("date"), "past_date")
    )


@dataclass(frozen=True)
class Profile:
    """What a candidate must have for one purpose; `past`: whether dates before today are taken."""

    urls: str
    hosts: str = ".+"
    title: bool = True
    date: bool = False
    location: bool = False
    past: bool = False


#: The profiles' patterns, requirements and policies for past dates.
PROFILES = {
    "events": Profile("^https?://"),
    "training": Profile("(?i)^https?://[^?#]*(training|course|learn|academy|workshop|bootcamp|webinar)", date=True),
    "conferences": Profile("(?i)^https?://[^?#]*(conference|congress|summit|symposium|forum|annual-meeting)", date=True, location=True),
    "announcements": Profile("(?i)^https?://[^?#]*(announce|news|notice|press|media)", past=True),
}


def candidate_day(raw: Column) -> Column:
    """The moment of a date alone or of a whole timestamp with its offset; null for anything else."""
    day = F.when(F.regexp_like(raw, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.concat(raw, F.lit("T00:00:00Z")))
    return F.try_to_timestamp(F.coalesce(day, F.when(F.regexp_like(raw, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")), raw)))


def profile_reasons(candidates: DataFrame, today: str, url: str = "url", title: str = "title", location: str = "location", date: str = "date") -> DataFrame:
    """The rows, once for each of `PROFILES`, with `profile`, `canonical` and `reason`: why the profile drops the candidate, by the
    first thing that fails, null if it takes it. Texts of blanks are missing; today is a date in UTC."""
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    now = F.lit(f"{today}T00:00:00Z").cast("timestamp")
    rows = candidates.withColumn("canonical", candidate(F.col(url))).withColumn("_at", candidate_day(F.trim(date)))

    def why(p: Profile) -> Column:
        admitted = F.regexp_like("canonical", F.lit(p.urls)) & F.regexp_like(host(F.col("canonical")), F.lit(p.hosts))
        out = F.when(F.col("canonical").isNull(), "invalid_url").when(~F.coalesce(admitted, F.lit(False)), "url_pattern")
        out = out.when(F.lit(p.title) & ~some(title), "missing_title").when(F.lit(p.location) & ~some(location), "missing_location")
        return out.when(F.lit(p.date) & F.col("_at").isNull(), "missing_date").when(F.lit(not p.past) & (F.col("_at") < now), "past_date")

    each = F.array(*[F.struct(F.lit(n).alias("profile"), why(p).alias("reason")) for n, p in PROFILES.items()])
    return rows.select(*candidates.columns, "canonical", F.explode(each).alias("_p")).select(*candidates.columns, "canonical", "_p.profile", "_p.reason")


def histogram(df: DataFrame, by: list[str], col: str, values: tuple[str, ...]) -> DataFrame:
    """A count column per value of a fixed list, and `total`."""
    counts = [F.count_if(F.col(col) == v).alias(v) for v in values]
    return df.groupBy(*by).agg(*counts, F.count(col).alias("total"))


def outcome(accepted: Column, error: Column, budget_stopped: Column, validated: Column, offered: Column, dropped: Column) -> Column:
    return (
        F.when(accepted > 0, "accepted").when(error, "error").when(budget_stopped, "budget_stopped").when((validated == 0) & (offered == 0) & (dropped == 0), "candidate_empty").when(offered == 0, "offered_empty").otherwise("judge_empty")
    )


def accept(selected: DataFrame, offered: DataFrame, url: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, left): offered rows whose exact address was selected, in selection order, and the others."""
    chosen = first_seen(selected.select(url, order), [url], [order])
    return offered.join(chosen, url), offered.join(chosen, url, "left_anti")


def restored(hits: DataFrame, known: DataFrame, url: str, cols: list[str]) -> DataFrame:
    """Hits whose fields are replaced by what is known of their address."""
    k = known.select(url, *[F.col(c).alias(f"_{c}") for c in cols])
    return hits.join(k, url, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in hits.columns])
