"""Queries of the general problems over the filing tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators.coverage import coverage_summary, periods_and_gaps
from meridian.operators.known_at import known_states, with_known
from meridian.operators.quantities import to_common_units
from meridian.session import broadcast_if_small, table


def _day(column: str) -> F.Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(""))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spells = table(spark, sf_dir, "universe_membership")
    found = periods_and_gaps(spells, "cik", "member_from", "member_to")
    return found.select("cik", "kind", _day("start_date").alias("start_date"), _day("end_date").alias("end_date"))


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_summary(table(spark, sf_dir, "universe_membership"), "cik", "member_from", "member_to")


_FACT = {"entity": "cik", "at": "filing_date", "effective": "instant", "disclosed": "filed", "source": "accn", "value": "val"}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings for which some public float was known. The states of the distinct
    (cik, day) pairs are joined back to the filings on that pair."""
    filings = table(spark, sf_dir, "filings").select("accession_number", "cik", "filing_date").distinct()
    facts = table(spark, sf_dir, "float_facts")
    known = with_known(filings, facts, **_FACT).where("known_effective is not null")
    return known.select(
        "accession_number", F.col("known_source").alias("fact_accn"), F.date_format("known_effective", "yyyy-MM-dd").alias("fact_instant")
    )


def p4_all_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = table(spark, sf_dir, "filings").select("accession_number", "cik", "filing_date").distinct()
    known = with_known(filings, table(spark, sf_dir, "float_facts"), **_FACT)
    return known.select(
        "accession_number", "cik", "filing_date", F.col("known_val").alias("public_float"), F.col("known_disclosed").alias("float_filed")
    )


def p4_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_states(table(spark, sf_dir, "filings"), table(spark, sf_dir, "float_facts"), **_FACT)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_common_units(table(spark, sf_dir, "fundamental_facts"), table(spark, sf_dir, "concept_families"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).where("exponent <> 0 and status = 'ok'").select("fact_id", "common_unit", "exponent")


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact in its common unit."""
    return _units(spark, sf_dir)


def p7_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each (cik, family) as converted, beside what ``concept_resolution`` recorded."""
    family = table(spark, sf_dir, "concept_families").select("taxonomy", "concept", "family")
    facts = table(spark, sf_dir, "fundamental_facts").select("fact_id", "cik", "taxonomy", "concept", "unit").distinct()
    per = (
        facts.join(broadcast_if_small(family.distinct()), ["taxonomy", "concept"])
        .join(_units(spark, sf_dir).select("fact_id", "common_unit", "exponent"), "fact_id")
        .groupBy("cik", "family")
        .agg(
            F.count("*").alias("n_facts"),
            F.count_if(F.col("exponent") != 0).alias("n_rescaled"),
            F.max("common_unit").alias("common_unit"),
            (F.count_distinct("unit") > 1).cast("int").alias("units_mixed_now"),
        )
    )
    old = table(spark, sf_dir, "concept_resolution").select("cik", "family", "unit", "units_mixed", "tags").distinct()
    old = old.groupBy("cik", "family").agg(
        F.max("unit").alias("unit_recorded"), F.max("units_mixed").alias("units_mixed"), F.max("tags").alias("tags")
    )
    return old.join(per, ["cik", "family"], "left")


QUERIES = {
    "p3_found": p3_found,
    "p3_summary": p3_summary,
    "p4_found": p4_found,
    "p4_all_filings": p4_all_filings,
    "p7_found": p7_found,
    "p7_values": p7_values,
    "p7_resolution": p7_resolution,
}

_P3 = """
with s as (select cik, member_from f, coalesce(member_to, date '9999-12-31') t from universe_membership
           where member_from is not null and coalesce(member_to, date '9999-12-31') > member_from),
o as (select cik, f, t, max(t) over (partition by cik order by f, t rows between unbounded preceding and 1 preceding) m from s),
i as (select cik, f, t, sum(case when m is null or f > m then 1 else 0 end) over (partition by cik order by f, t) g from o),
p as (select cik, min(f) f, max(t) t from i group by cik, g),
g as (select cik, t f, lead(f) over (partition by cik order by f) t from p)
"""

SQL = {
    "p3_found": _P3
    + """select cik, 'period' as kind, strftime(f, '%Y-%m-%d') as start_date,
       case when t = date '9999-12-31' then '' else strftime(t, '%Y-%m-%d') end as end_date from p
union all select cik, 'gap', strftime(f, '%Y-%m-%d'), strftime(t, '%Y-%m-%d') from g where t is not null""",
    "p3_summary": _P3
    + """, u as (select cik, 1 as isp, f, t from p union all select cik, 0, f, t from g where t is not null)
select cik, count(case when isp = 1 then 1 end) as n_periods, count(case when isp = 0 then 1 end) as n_gaps,
  coalesce(sum(case when isp = 1 and t < date '9999-12-31' then date_diff('day', f, t) end), 0)::bigint as days_covered,
  coalesce(sum(case when isp = 0 then date_diff('day', f, t) end), 0)::bigint as days_in_gaps,
  bool_or(isp = 1 and t = date '9999-12-31') as is_open from u group by cik""",
    "p4_found": """
with f as (select distinct accession_number, cik, filing_date from filings),
k as (select distinct cik, instant, filed, accn, val from float_facts where instant is not null and filed is not null),
j as (select f.accession_number, k.accn, k.instant,
        row_number() over (partition by f.accession_number order by k.instant desc, k.filed desc, k.accn desc, k.val desc) rn
      from f join k on f.cik = k.cik and k.instant < f.filing_date and k.filed < f.filing_date)
select accession_number, accn as fact_accn, strftime(instant, '%Y-%m-%d') as fact_instant from j where rn = 1""",
    "p4_all_filings": """
with f as (select distinct accession_number, cik, filing_date from filings),
k as (select distinct cik, instant, filed, accn, val from float_facts where instant is not null and filed is not null),
j as (select f.accession_number, f.cik, f.filing_date, k.val, k.filed,
        row_number() over (partition by f.accession_number order by k.instant desc nulls last, k.filed desc, k.accn desc, k.val desc) rn
      from f left join k on f.cik = k.cik and k.instant < f.filing_date and k.filed < f.filing_date)
select accession_number, cik, filing_date, val as public_float, filed as float_filed from j where rn = 1""",
}
