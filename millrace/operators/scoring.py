"""Rule-based quality model of articles: factors, inclusion decisions with the reason, replication counts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sampling

DROP = -1_000_000.0
#: publication type: (included, upsampling); types are keyed one a line, as their names hold commas
_TYPES = """
Case Reports|0|0
Clinical Study|1|.4
Clinical Trial, Phase I|1|.2
Clinical Trial, Phase II|1|.4
Clinical Trial, Phase III|1|.6
Clinical Trial, Phase IV|1|.8
Comment|0|.1
Comparative Study|1|.5
Editorial|0|.1
Guideline|1|1
Letter|0|.1
Meta-Analysis|1|1
Observational Study|1|.5
Observational Study, Veterinary|0|x
Patient Education Handout|1|1
Practice Guideline|1|1
Preprint|0|x
Randomized Controlled Trial|1|.5
Retracted Publication|0|x
Retraction of Publication|0|x
Review|1|.5
Systematic Review|1|.8
"""
TYPES = {t: (int(a), DROP if b == "x" else float(b)) for t, a, b in (r.split("|") for r in _TYPES.strip().split("\n"))}
MESH_DROPPED = ("Animals",)
DATE_FACTORS = {"old": 0.0, "middle": 0.2, "new": 1.0}
CITATION_FACTORS = {"bottom": 0.0, "middle": 0.5, "top": 1.0}
REFERENCE_DATE = dt.date(2023, 7, 15)
OLD_BEFORE = "2013-07-17 00:00:00"
NEW_FROM = "2018-01-14 12:00:00"
BANDS = ("top25", "middle50", "bottom25")


@dataclass(frozen=True)
class Columns:
    """Where the model finds what it looks at: arrays of types and mesh headings, a venue, a date string, citations."""

    types: str = "publicationtype"
    mesh: str = "mesh"
    venue: str = "venue"
    date: str = "publicationDate"
    citations: str = "citationCount"


def parsed_date(c: Column) -> Column:
    """Null for what is no date."""
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd"))


def citations_per_year(citations: Column, date: Column, reference: dt.date = REFERENCE_DATE) -> Column:
    """Years count from the date to the reference, floored, plus one; null in the year after the reference."""
    years = F.floor(F.datediff(F.lit(reference), date) / 365) + 1
    return F.when(years != 0, citations / years)


def thresholds(df: DataFrame, c: Columns = Columns(), reference: dt.date = REFERENCE_DATE, approximate: bool = False) -> DataFrame:
    """One row (top25, middle50, bottom25) of citations per year; exact by interpolation, with one entry of state a distinct value
    (citation counts by years are few values, however many the articles), or approximate with bounded state."""
    x = df.select(citations_per_year(F.col(c.citations), parsed_date(F.col(c.date)), reference).alias("x")).filter("x is not null")
    q = F.percentile_approx("x", [0.75, 0.5, 0.25], 10_000) if approximate else F.percentile("x", F.array(F.lit(0.75), F.lit(0.5), F.lit(0.25)))
    return x.agg(q.alias("q")).select(*[F.col("q")[i].alias(b) for i, b in enumerate(BANDS)])


def with_thresholds(df: DataFrame, t: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(t.limit(1)))


def journal_key(venue: Column) -> Column:
    return F.translate(F.lower(venue), ":,.-", "")


def approved_key(name: str) -> str:
    """A listed name's key; here & counts as and, which it does not in an article's venue."""
    spelled = "and".join(name.lower().split("&"))
    return spelled.translate({ord(x): None for x in ":,.-"})


def approved_journals(names: DataFrame, name: str = "name") -> DataFrame:
    """(key): the keys of a table of journal names, once each, to be joined to venues."""
    spelled = F.translate(F.replace(F.lower(name), F.lit("&"), F.lit("and")), ":,.-", "")
    return names.select(spelled.alias("key")).filter("key is not null").distinct()


def with_approved(articles: DataFrame, journals: DataFrame, venue: str = "venue") -> DataFrame:
    """``articles`` with ``approved``: whether the venue is one of the journals. The list is short; AQE broadcasts it if it is."""
    j = journals.select(F.col("key").alias("__mr_journal"))
    return articles.join(j, journal_key(F.col(venue)) == F.col("__mr_journal"), "left").withColumn("approved", F.col("__mr_journal").isNotNull()).drop("__mr_journal")


def date_band(d: Column) -> Column:
    return F.when(d < F.lit(OLD_BEFORE).cast("timestamp"), "old").when(d < F.lit(NEW_FROM).cast("timestamp"), "middle").when(d.isNotNull(), "new")


def citation_band(per_year: Column) -> Column:
    return F.when(per_year <= F.col("bottom25"), "bottom").when(per_year <= F.col("top25"), "middle").when(per_year.isNotNull(), "top")


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def factor(approved: Column, c: Columns = Columns(), reference: dt.date = REFERENCE_DATE) -> Column:
    """The upsampling factor. Types and headings count as often as they stand; date and citations only where the sum so
    far is positive, and then their absence, like a null array or venue, gives DROP."""
    up = _map({t: b for t, (_, b) in TYPES.items()})
    types = _sum(F.transform(c_ := F.col(c.types), lambda t: F.coalesce(F.try_element_at(up, t), F.lit(0.0))))
    mesh = _sum(F.transform(F.col(c.mesh), lambda m: F.when(m.isin(*MESH_DROPPED), DROP).otherwise(0.0)))
    base = types + mesh + F.when(approved, 1.0).otherwise(0.0)
    date = parsed_date(F.col(c.date))
    per_year = citations_per_year(F.col(c.citations), date, reference)
    more = F.try_element_at(_map(DATE_FACTORS), date_band(date)) + F.try_element_at(_map(CITATION_FACTORS), citation_band(per_year))
    return F.when(c_.isNull() | F.col(c.mesh).isNull() | F.col(c.venue).isNull(), DROP).when(base > 0, F.coalesce(base + more, F.lit(DROP))).otherwise(base)


def reason(approved: Column, c: Columns = Columns(), reference: dt.date = REFERENCE_DATE) -> Column:
    """The first rule that excludes an article, or ``include``."""
    flags = _map({t: float(a) for t, (a, _) in TYPES.items()})
    covered = F.filter(F.transform(F.col(c.types), lambda t: F.try_element_at(flags, t)), lambda x: x.isNotNull())
    date = parsed_date(F.col(c.date))
    per_year = citations_per_year(F.col(c.citations), date, reference)
    return (
        F.when(F.col(c.types).isNull() | F.col(c.mesh).isNull(), "nometadata")
        .when(F.exists(covered, lambda x: x == 0), "publication_type")
        .when(F.size(covered) == 0, "publication_notcovered")
        .when(F.exists(c_ := F.col(c.mesh), lambda m: m.isin(*MESH_DROPPED)) & c_.isNotNull(), "mesh")
        .when(date_band(date) == "old", "date")
        .when(citation_band(per_year) == "bottom", "citation")
        .when(per_year.isNull(), "nometadata")
        .when(~F.coalesce(approved, F.lit(False)), "journal")
        .otherwise("include")
    )


def count_linear(f: Column, key: str, fold: float = 1.0) -> Column:
    return sampling.stochastic_round(1 + f * fold, key)


def count_proportional(f: Column, key: str, fold: float = 1.0) -> Column:
    return sampling.stochastic_round(f * fold, key)


def count_exponential(f: Column, key: str, fold: float = 1.0, most: int = 5) -> Column:
    return F.least(sampling.stochastic_round(F.exp(f) * fold, key), F.lit(most).cast("long"))


COUNTS = {"linear": count_linear, "proportional": count_proportional, "exponential": count_exponential}
