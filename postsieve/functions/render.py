"""Texts of alerts, digests and health reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, blank, coalesce_blank

# Icons of the rendered texts.
POLICY_ICONS = {"remote": "🏠", "hybrid": "🔄", "onsite": "🏢"}
TIER_ICONS = {1: "🥇", 2: "🥈", 3: "🥉", 4: "📡"}


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) != 0


def format_salary(
    low: Column | str = "salary_min",
    high: Column | str = "salary_max",
    currency: Column | str = "salary_currency",
    period: Column | str = "salary_period",
) -> Column:
    lo, hi = _col(low), _col(high)
    upper = F.when(_given(hi), F.concat(F.lit(" – "), _money(hi))).otherwise("")
    tail = F.when(blank(period) != "", F.concat(F.lit(" / "), F.lower(_col(period)))).otherwise("")
    shown = F.concat(F.lit("💰 "), _money(lo), upper, F.lit(" "), coalesce_blank(currency, F.lit("USD")), tail)
    return F.when(_given(lo), shown).otherwise("💰 Not disclosed")


def format_tech(
    tech: Column | str = "tech_stack", certs: Column | str = "certifications_required", most: int | None = None
) -> Column:
    """Lines of skills (the first `most` of them if given) and of required certificates."""
    t, c = _col(tech), _col(certs)
    shown = t if most is None else F.slice(t, 1, most)
    skills = F.when(F.size(t) > 0, F.concat(F.lit("🔧 "), F.array_join(shown, " · ")))
    needed = F.when(F.size(c) > 0, F.concat(F.lit("📜 Req: "), F.array_join(c, ", ")))
    # concat_ws leaves out the line that is NULL
    return coalesce_blank(F.concat_ws("\n", skills, needed), F.lit("🔧 Not specified"))


def render_alert() -> Column:
    """Alert text of a row of the jobs table."""
    policy = _col("remote_policy")
    icon = F.lit("📍")
    for name, mark in POLICY_ICONS.items():
        icon = F.when(policy == name, mark).otherwise(icon)
    return F.concat_ws(
        "\n",
        F.concat(
            F.when(_col("score") >= 90, "🔥").otherwise("✅"),
            F.lit(" <b>"),
            F.when(_col("is_dream"), "⭐ DREAM COMPANY! ").otherwise(""),
            F.lit("NEW JOB ALERT</b>"),
        ),
        F.lit(""),
        F.concat(F.lit("🏢 <b>"), blank("company"), F.lit("</b>")),
        F.concat(F.lit("💼 "), blank("title")),
        F.concat(
            icon,
            F.lit(" "),
            F.initcap(coalesce_blank(policy, F.lit("unknown"))),
            F.lit(" | "),
            coalesce_blank("location", F.lit("Unknown Location")),
        ),
        format_salary(),
        format_tech(),
        F.concat(F.lit("📊 Score: <b>"), _col("score").cast("string"), F.lit("/100</b>")),
        F.lit(""),
        F.concat(F.lit('🔗 <a href="'), blank("url"), F.lit('">Apply Now</a>')),
        F.lit(""),
        F.concat(
            F.lit("<i>Tier "),
            _col("source_tier").cast("string"),
            F.lit(" | "),
            blank("source_name"),
            F.lit(" | "),
            F.date_format("ingested_at", "HH:mm"),
            F.lit(" UTC</i>"),
        ),
    )


def digest_entry() -> Column:
    """Two lines of a digest for a row of the jobs table."""
    return F.concat(
        F.lit("• <b>"), blank("company"), F.lit("</b>: "), blank("title"),
        F.lit(" (Score: "), _col("score").cast("string"), F.lit(")\n"),
        F.lit('  <a href="'), blank("url"), F.lit('">Apply Here</a>'),
    )


def tier_line(tier: Column | str, count: Column | str) -> Column:
    icon = F.lit("")
    for number, mark in TIER_ICONS.items():
        icon = F.when(_col(tier) == number, mark).otherwise(icon)
    return F.concat(
        F.lit("  "), F.when(_col(count) > 0, "✅").otherwise("⚠️"), F.lit(" "), icon,
        F.lit(" Tier "), _col(tier).cast("string"),
        F.lit(": <b>"), _col(count).cast("string"), F.lit("</b> new jobs"),
    )
