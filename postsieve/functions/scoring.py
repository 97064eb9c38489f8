"""Scoring rules of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, any_of, blank, strip

# Skill groups and title words of the rules.
PREMIUM_SKILLS = [
    "cissp", "appsec", "soc", "siem", "incident response", "penetration testing",
    "vulnerability management", "oscp", "cism", "ceh",
]
GOOD_SKILLS = [
    "infosec", "network security", "cloud security", "iam", "threat hunting", "grc",
    "security engineer",
]
SENIOR_WORDS = ["senior", "lead", "staff", "principal", "director", "manager", "head", "vp"]
JUNIOR_WORDS = [
    "junior", "fresher", "entry level", "new grad", "intern", "0-2 years", "associate",
    "graduate", "trainee", "apprentice", "analyst i", "analyst 1",
]

WATCHLIST_SCORE = 100


def watchlist_key(company: Column | str) -> Column:
    return strip(F.lower(blank(company)))


def watchlist_match(company: Column | str, watchlist: list[str]) -> Column:
    """Equality with a listed name, case and outer space aside. For lists known in code."""
    if not watchlist:
        return F.lit(False)
    return watchlist_key(company).isin([w.lower().strip() for w in watchlist])


def score(
    on_watchlist: Column | str,
    title: Column | str = "title",
    remote_policy: Column | str = "remote_policy",
    salary: Column | str = "salary_min",
    tech_stack: Column | str = "tech_stack",
    years_of_experience: Column | str = "years_of_experience",
    high_salary: int = 150_000,
    fair_salary: int = 100_000,
) -> Column:
    """Rule score: 100 for a watch-list company, else at most 99 and possibly negative."""
    yoe, pay, name = _col(years_of_experience), _col(salary), F.lower(blank(title))
    policy = F.lower(blank(remote_policy))
    # elements between NUL characters: one pattern then tests a whole word list, where a
    # condition per word would outgrow what the JVM compiles
    tech = F.concat(F.lit("\0"), F.lower(F.array_join(_col(tech_stack), "\0")), F.lit("\0"))

    def overlaps(words) -> Column:
        return tech.rlike(f"\0(?:{any_of(words)})\0")

    def names(words) -> Column:
        return name.rlike(any_of(words))

    base = (
        F.lit(50)
        + F.when(yoe <= 2, 50).when(yoe >= 5, -80).otherwise(0)
        + F.when(policy == "remote", 20).when(policy == "hybrid", 8).otherwise(0)
        + F.when(pay >= high_salary, 15).when(pay >= fair_salary, 8).otherwise(0)
        + F.when(overlaps(PREMIUM_SKILLS), 15).when(overlaps(GOOD_SKILLS), 8).otherwise(0)
    )
    factor = F.when(names(SENIOR_WORDS), 0.1).when(names(JUNIOR_WORDS), 2.0).otherwise(1.0)
    ruled = F.least(F.lit(99), (base * factor).cast("int"))
    return F.when(_col(on_watchlist), WATCHLIST_SCORE).otherwise(ruled)


def is_dream(score_col: Column | str = "score") -> Column:
    return _col(score_col) == WATCHLIST_SCORE
