"""String and hash columns: keys, surrogate ids, title splitting, tag stripping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inside of a character class: every character that counts as white space (ASCII,
# separators U+001C-U+001F, NEL and the Unicode separators). `\s` and `trim` alone
# cover less, and scraped text is full of no-break spaces.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"

# The same characters one by one: all that lie below the CJK planes and count as space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(rows: DataFrame, *names: str) -> DataFrame:
    """Keep costly columns from being copied.

    The optimizer moves a filter below the projection it reads from by repeating the expressions inside of it,
    so a filter on a derived column would run the regular expressions behind it once more per mention. A generator
    of one row holds them: filters on its output stay above it, filters on other columns pass it and reach the scan.
    """
    kept = [c for c in rows.columns if c not in names]
    out = rows.select(*kept, F.explode(F.array(F.struct(*names))).alias("_once"))
    return out.select(*[F.col("_once")[c].alias(c) if c in names else F.col(c) for c in rows.columns])


def iso_time(c: Column | str) -> Column:
    """ISO text of a time, with microseconds where there are any; NULL for none."""
    iso, micros = F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(_col(c), "SSSSSS")
    return F.when(micros == "000000", iso).otherwise(F.concat(iso, F.lit("."), micros))


def blank(c: Column | str) -> Column:
    """NULL as empty string."""
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space, Unicode spaces included.

    A trim over a character set looks at the two ends only; a pattern would walk the text.
    """
    return F.btrim(_col(c), F.lit(SPACES))


def any_of(words) -> str:
    """Pattern that hits where one of the words occurs."""
    return "|".join(rf"\Q{w}\E" for w in words)


def is_blank(c: Column | str) -> Column:
    return blank(c) == ""


def coalesce_blank(first: Column | str, second: Column | str) -> Column:
    """`first` unless it is NULL or empty, else `second`."""
    return F.coalesce(F.nullif(_col(first), F.lit("")), _col(second))


def dedup_hash(title: Column | str, company: Column | str, location: Column | str) -> Column:
    """Cross-source key: sha256 of the lowercased, stripped fields."""
    parts = [strip(F.lower(blank(c))) for c in (title, company, location)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def canonical_hash(title: Column | str, company: Column | str, location: Column | str) -> Column:
    """Key of the jobs table: as `dedup_hash`, but white space counts."""
    parts = [F.lower(blank(c)) for c in (title, company, location)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def surrogate_id(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(blank(key)), 1, 16))


def company_from_slug(slug: Column | str) -> Column:
    """Hyphens to spaces, then every run of letters capitalized.

    `initcap` alone starts words only after a space, so the runs of letters are
    capitalized one by one ("3d-systems" becomes "3D Systems").
    """
    runs = F.regexp_extract_all(F.translate(_col(slug), "-", " "), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def split_title_company(title: Column | str) -> tuple[Column, Column]:
    """Split at the last " at "; without one the title stays and the company is empty."""
    t = blank(title)
    pattern = r"(?s)\A(.*) at (.*)\z"
    found = F.contains(t, F.lit(" at "))
    name = F.when(found, strip(F.regexp_extract(t, pattern, 1))).otherwise(t)
    company = F.when(found, strip(F.regexp_extract(t, pattern, 2))).otherwise("")
    return name, company


def cut(c: Column | str, length: int | None = None) -> Column:
    """The first `length` characters; without a length the whole text."""
    return _col(c) if length is None else F.substring(_col(c), 1, length)


def compose_text(*parts: Column | str, length: int | None = None) -> Column:
    """Space-joined fields, cut when a length is given."""
    return cut(F.concat_ws(" ", *[blank(p) for p in parts]), length)


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), "<[^>]+>", "")


def subject_line(html: Column | str, default: str = "Posting alert", length: int | None = None) -> Column:
    """First non-blank line of the text without tags, stripped, cut if a length is given.

    The first non-space character lies on that line, so one match from there to the
    line end gives it without splitting the whole text.
    """
    line = strip(F.regexp_extract(strip_tags(html), rf"[^{SPACE}][^\n]*", 0))
    return coalesce_blank(cut(line, length), F.lit(default))
