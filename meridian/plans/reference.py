"""Queries of the point-in-time operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.operators import folds as fo
from meridian.operators import graph, metrics, quality
from meridian.operators import sequence as sq
from meridian.operators import text as tx
from meridian.operators.answers import read_answer
from meridian.operators.asof import duration_bucket, duration_preference, latest_known, next_after, partner_near
from meridian.operators.coverage import periods_and_gaps
from meridian.operators.order import position_in_group, value_ranks
from meridian.session import broadcast_if_small, checkpointed, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").select("accession_number", "cik", "form", "filing_date", "report_date", "acceptance_datetime", "items").distinct()


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fundamental_facts").select(
        "fact_id", "cik", "concept", "unit", "value", "period_start", "period_end", "form", "accession_number", "filed", "fy", "fp"
    ).distinct()


_F = "f as (select distinct accession_number, cik, form, filing_date, report_date, acceptance_datetime, items from filings)"
_X = "x as (select distinct fact_id, cik, concept, unit, value, period_start, period_end, form, accession_number, filed, fy, fp from fundamental_facts)"


# --- as-of lookups -----------------------------------------------------------------


@query(f"""
with {_F}, {_X}, q as (select distinct f.cik, f.filing_date, x.concept from f join (select distinct cik, concept from x) x using (cik)),
j as (select q.*, x.fact_id, x.value, x.period_end, x.filed, row_number() over (partition by q.cik, q.filing_date, q.concept
        order by x.period_end desc, x.filed desc, x.accession_number desc, x.fact_id desc) rn
      from q join x on x.cik = q.cik and x.concept = q.concept and x.filed <= q.filing_date and x.period_end is not null)
select cik, filing_date, concept, fact_id, value, period_end, filed from j where rn = 1""")
def asof_latest_fact(spark, d):
    """Latest period first, then latest filed, of what had been filed by the day itself."""
    x = facts(spark, d)
    q = filings(spark, d).select("cik", "filing_date").distinct().join(x.select("cik", "concept").distinct(), "cik")
    known = latest_known(
        q, x.where("period_end is not null"), keys=["cik", "concept"], at="filing_date", available=F.col("filed"),
        order=[F.col(c) for c in ("period_end", "filed", "accession_number", "fact_id", "value")],
    )
    return known.where("known is not null").select("cik", "filing_date", "concept", "known.fact_id", "known.value", "known.period_end", "known.filed")


@query(f"""
with {_F}, k as (select distinct cik, instant, filed, accn, val from float_facts where instant is not null and filed is not null),
q as (select distinct cik, filing_date from f),
j as (select q.*, k.instant, k.filed, k.val, row_number() over (partition by q.cik, q.filing_date order by k.instant desc, k.filed desc, k.accn desc, k.val desc) rn
      from q join k on k.cik = q.cik and k.filed < q.filing_date and k.instant < q.filing_date)
select cik, filing_date, val as public_float, instant, date_diff('day', instant, filing_date) as age_days,
       date_diff('day', instant, filing_date) > 830 as is_stale from j where rn = 1""")
def asof_strict_staleness(spark, d):
    """Known strictly before the day, with its age; older than 830 days is stale."""
    k = table(spark, d, "float_facts").where("instant is not null and filed is not null")
    known = latest_known(
        filings(spark, d), k, keys=["cik"], at="filing_date", available=F.greatest("instant", "filed"), inclusive=False,
        order=[F.col("instant"), F.col("filed"), F.col("accn"), F.col("val")],
    ).where("known is not null")
    age = F.datediff("filing_date", "known.instant")
    return known.select("cik", "filing_date", F.col("known.val").alias("public_float"), "known.instant", age.cast("long").alias("age_days"), (age > 830).alias("is_stale"))


_BUCKET = """case when period_start is null or period_end is null then 'instant' when date_diff('day', period_start, period_end) <= 0 then 'other'
 when date_diff('day', period_start, period_end) <= 115 then 'Q' when date_diff('day', period_start, period_end) <= 210 then 'H1'
 when date_diff('day', period_start, period_end) <= 300 then '9M' when date_diff('day', period_start, period_end) <= 400 then 'FY' else 'other' end"""


@query(f"""
with {_X}, b as (select *, {_BUCKET} as bucket from x)
select concept, bucket, count(*) as n, count(distinct cik) as n_ciks, min(filed) as first_filed from b group by concept, bucket""")
def duration_buckets(spark, d):
    b = facts(spark, d).withColumn("bucket", duration_bucket(F.col("period_start"), F.col("period_end")))
    return b.groupBy("concept", "bucket").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("n_ciks"), F.min("filed").alias("first_filed"))


@query(f"""
with {_X}, b as (select *, {_BUCKET} as bucket from x where period_end is not null),
p as (select *, case bucket when 'FY' then 5 when 'Q' then 4 when 'H1' then 3 when '9M' then 2 when 'other' then 1 else 0 end as pref from b),
r as (select *, row_number() over (partition by cik, concept order by period_end desc, pref desc, filed desc, accession_number desc, fact_id desc) rn from p)
select cik, concept, fact_id, bucket, period_end, value from r where rn = 1""")
def latest_by_duration(spark, d):
    """The latest period of each concept; of durations that end together full years first, else the shortest."""
    b = facts(spark, d).where("period_end is not null").withColumn("bucket", duration_bucket(F.col("period_start"), F.col("period_end")))
    order = [F.col("period_end"), duration_preference(F.col("bucket")).alias("pref"), F.col("filed"), F.col("accession_number"), F.col("fact_id"), F.col("bucket"), F.col("value")]
    best = b.groupBy("cik", "concept").agg(F.max(F.struct(*order)).alias("r"))
    return best.select("cik", "concept", "r.fact_id", "r.bucket", "r.period_end", "r.value")


@query(f"""
with {_X}, fam as (select distinct family, concept, preference from concept_families),
c as (select x.cik, fam.family, fam.preference, x.concept, x.period_end, x.filed, x.accession_number, x.fact_id, x.value from x join fam using (concept) where x.period_end is not null),
r as (select *, row_number() over (partition by cik, family order by period_end desc, filed desc, preference desc, accession_number desc, fact_id desc) rn,
        max(filed) over (partition by cik) as as_of from c)
select cik, family, concept, fact_id, period_end, case when date_diff('day', period_end, as_of) > 200 then null else value end as value,
       date_diff('day', period_end, as_of) > 200 as is_stale from r where rn = 1""")
def freshest_of_family(spark, d):
    """Freshest fact under any alias of a family; the alias order only breaks exact ties, and a stale value is null."""
    fam = table(spark, d, "concept_families").select("family", "concept", "preference").distinct()
    c = facts(spark, d).where("period_end is not null").join(broadcast_if_small(fam), "concept")
    best = c.groupBy("cik", "family").agg(
        F.max(F.struct("period_end", "filed", "preference", "accession_number", "fact_id", "concept", "value")).alias("r")
    )
    as_of = c.groupBy("cik").agg(F.max("filed").alias("as_of"))
    stale = F.datediff("as_of", "r.period_end") > 200
    return best.join(as_of, "cik").select(
        "cik", "family", "r.concept", "r.fact_id", "r.period_end", F.when(~stale, F.col("r.value")).alias("value"), stale.alias("is_stale")
    )


@query(f"""
with {_X}, l as (select cik, concept, period_start, period_end, value, row_number() over (partition by cik, concept, period_start, period_end
        order by filed desc, accession_number desc, fact_id desc) rn, filed, accession_number, fact_id from x where period_end is not null and value is not null),
a as (select * from l where rn = 1),
j as (select a.cik, a.concept, a.period_start, a.period_end, a.value, b.value as prior_value, b.period_end as prior_end,
        row_number() over (partition by a.cik, a.concept, a.period_start, a.period_end
          order by abs(date_diff('day', b.period_end, (a.period_end - interval 12 month)::date)), b.filed desc, b.accession_number desc, b.fact_id desc) rn
      from a join a b on a.cik = b.cik and a.concept = b.concept
        and abs(date_diff('day', b.period_end, (a.period_end - interval 12 month)::date)) <= 45
        and ((a.period_start is null and b.period_start is null) or
             abs(date_diff('day', a.period_start, a.period_end) - date_diff('day', b.period_start, b.period_end)) <= 20))
select cik, concept, period_start, period_end, value, prior_end, prior_value,
       case when abs(prior_value) >= 1e-6 then round((value - prior_value) / abs(prior_value), 6) end as growth from j where rn = 1""")
def growth_year_on_year(spark, d):
    """Change against the period that ended a calendar year before (45 days more or less, with a duration within 20 days)."""
    x = facts(spark, d).where("period_end is not null and value is not null")
    a = x.groupBy("cik", "concept", "period_start", "period_end").agg(F.max(F.struct("filed", "accession_number", "fact_id", "value")).alias("r"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    target = F.add_months("period_end", -12)
    left = a.select("cik", "concept", "period_start", "period_end", F.col("r.value").alias("value"), target.alias("_t"))
    left = left.withColumn("_b", F.explode(F.sequence(F.floor((day("_t") - 45) / 91), F.floor((day("_t") + 45) / 91))))
    right = a.select("cik", "concept", F.col("period_start").alias("_ps"), F.col("period_end").alias("prior_end"), "r", F.floor(day("period_end") / 91).alias("_b"))
    gap = F.abs(F.datediff("prior_end", "_t"))
    lengths = F.abs(F.datediff("period_end", "period_start") - F.datediff("prior_end", "_ps")) <= 20
    met = left.join(right, ["cik", "concept", "_b"]).where((gap <= 45) & ((F.col("period_start").isNull() & F.col("_ps").isNull()) | lengths))
    best = met.groupBy("cik", "concept", "period_start", "period_end", "value").agg(F.max(F.struct((-gap).alias("g"), "r", "prior_end")).alias("p"))
    prior = F.col("p.r.value")
    growth = F.when(F.abs(prior) >= 1e-6, F.round((F.col("value") - prior) / F.abs(prior), 6))
    return best.select("cik", "concept", "period_start", "period_end", "value", "p.prior_end", prior.alias("prior_value"), growth.alias("growth"))


@query(f"""
with {_F} select f.accession_number, exists (select 1 from universe_membership m where m.cik = f.cik and m.member_from <= f.filing_date
    and f.filing_date < coalesce(m.member_to, date '9999-12-31') and coalesce(m.member_to, date '9999-12-31') > m.member_from) as is_member from f""")
def membership_flag(spark, d):
    """Half-open membership on the filing day. Spells are merged first, so each filing meets one period at most."""
    return _inside(spark, d, F.col("member_from"), F.col("member_to"), "is_member")


@query(f"""
with {_F} select f.accession_number, exists (select 1 from universe_membership m where m.cik = f.cik and m.member_from is not null
    and (m.member_from - interval 12 month)::date <= f.filing_date and f.filing_date <= coalesce(m.member_to, date '9999-12-30')) as in_scope from f""")
def membership_with_lead_in(spark, d):
    """Closed interval, opened twelve months early."""
    return _inside(spark, d, F.add_months("member_from", -12), F.date_add("member_to", 1), "in_scope")


def _inside(spark, d, start, end, name):
    spells = table(spark, d, "universe_membership").select("cik", start.alias("a"), end.alias("b"))
    periods = periods_and_gaps(spells, "cik", "a", "b").where("kind = 'period'")
    f = filings(spark, d).select("accession_number", "cik", "filing_date")
    known = latest_known(f, periods, keys=["cik"], at="filing_date", available=F.col("start_date"), order=[F.col("start_date"), F.col("end_date")])
    inside = F.col("known").isNotNull() & (F.col("known.end_date").isNull() | (F.col("filing_date") < F.col("known.end_date")))
    return f.join(known.withColumn("_in", inside).select("cik", "filing_date", "_in"), ["cik", "filing_date"], "left").select(
        "accession_number", F.coalesce("_in", F.lit(False)).alias(name)
    )


@query(f"""
with {_F}, k as (select accession_number, cik, form, filing_date from f where form in ('10-K', '10-Q')),
p as (select a.accession_number, a.cik, a.form, a.filing_date, b.accession_number as prior, date_diff('day', b.filing_date, a.filing_date) as gap,
        row_number() over (partition by a.accession_number order by abs(date_diff('day', b.filing_date, a.filing_date) - 365), b.accession_number) rn
      from k a join k b on a.cik = b.cik and a.form = b.form and date_diff('day', b.filing_date, a.filing_date) between 300 and 430)
select accession_number, prior as prior_accession, gap as gap_days from p where rn = 1""")
def prior_year_partner(spark, d):
    """The filing of the same form 300 to 430 days before, nearest to 365, then the smallest accession."""
    k = filings(spark, d).where(F.col("form").isin("10-K", "10-Q"))
    p = partner_near(k, keys=["cik", "form"], day="filing_date", tie="accession_number", least=300, most=430, ideal=365)
    return p.select("accession_number", F.col("partner").alias("prior_accession"), F.col("gap").cast("long").alias("gap_days"))


@query(f"""
with {_F}, p as (select a.accession_number, b.accession_number as prior, b.filing_date as d,
        row_number() over (partition by a.accession_number order by b.filing_date desc, b.accession_number) rn
      from f a join f b on a.cik = b.cik and b.filing_date < a.filing_date)
select accession_number, prior as prior_accession, d as prior_date from p where rn = 1""")
def prior_filing(spark, d):
    """The latest filing of an earlier day; of several the smallest accession."""
    f = filings(spark, d).select("accession_number", "cik", "filing_date")
    days = f.groupBy("cik", "filing_date").agg(F.min("accession_number").alias("smallest"))
    known = latest_known(f, days, keys=["cik"], at="filing_date", available=F.col("filing_date"), order=[F.col("filing_date").alias("day"), F.col("smallest")], inclusive=False)
    known = known.where("known is not null").select("cik", "filing_date", F.col("known.smallest").alias("prior_accession"), F.col("known.day").alias("prior_date"))
    return f.join(known, ["cik", "filing_date"]).select("accession_number", "prior_accession", "prior_date")


@query(f"""
with {_F}, n as (select a.accession_number, min(b.filing_date) as e from f a left join f b on b.cik = a.cik and b.form = '8-K' and b.filing_date > a.filing_date
  where a.form = '10-K' group by a.accession_number)
select n.accession_number, n.e as next_event, coalesce(date_diff('day', f.filing_date, n.e) <= 90, false) as within_90
from n join f on f.accession_number = n.accession_number""")
def next_event_label(spark, d):
    """The next 8-K after each 10-K, and whether it comes within 90 days."""
    f = filings(spark, d)
    k = f.where("form = '10-K'").select("accession_number", "cik", "filing_date")
    n = next_after(k, f.where("form = '8-K'"), keys=["cik"], at="filing_date", when="filing_date")
    return k.join(n, ["cik", "filing_date"]).select(
        "accession_number", F.col("next").alias("next_event"), F.coalesce(F.datediff("next", "filing_date") <= 90, F.lit(False)).alias("within_90")
    )


# --- clusters, islands, ranks ------------------------------------------------------


@query(f"""
with {_F}, o as (select *, case when date_diff('day', lag(filing_date) over (partition by cik order by filing_date), filing_date) > 5 then 1 else 0 end s from f where filing_date is not null),
g as (select *, sum(s) over (partition by cik order by filing_date range unbounded preceding) c from o),
r as (select *, count(*) over (partition by cik, c) n, row_number() over (partition by cik, c order by filing_date desc, case when form in ('10-K', '10-Q') then 1 else 0 end desc, accession_number desc) rn from g)
select cik, accession_number, filing_date, n as n_in_cluster from r where rn = 1""")
def gap_cluster_dedup(spark, d):
    """One filing of each cluster of days at most 5 apart: the latest, periodic forms first."""
    f = filings(spark, d).where("filing_date is not null")
    order = [F.col("filing_date"), F.col("form").isin("10-K", "10-Q").cast("int").alias("periodic"), F.col("accession_number")]
    last = sq.last_of_cluster(f, "cik", "filing_date", 5, order)
    return last.select("cik", "last.accession_number", "last.filing_date", F.col("n").alias("n_in_cluster"))


_PANEL = f"""with {_F}, pq as (select distinct cik, year(filing_date) * 4 + quarter(filing_date) - 1 as q from f where filing_date is not null),
i as (select q, row_number() over (order by q) - 1 as p from (select distinct q from pq))"""


def _panel(spark, d):
    pq = filings(spark, d).where("filing_date is not null").select("cik", fo.quarter_index(F.col("filing_date")).alias("q")).distinct()
    dates = sq.dense_index(pq, "q", "p")  # as many rows as there are quarters
    return pq.join(F.broadcast(dates), "q"), dates


@query(f"""{_PANEL}, r as (select pq.cik, i.p, i.p - row_number() over (partition by pq.cik order by i.p) g from pq join i using (q)),
s as (select cik, min(p) a, max(p) b, count(*) n from r group by cik, g)
select s.cik, x.q as first_quarter, y.q as end_quarter, s.n as n_quarters from s join i x on x.p = s.a left join i y on y.p = s.b + 1""")
def spells_from_panel(spark, d):
    """Runs of consecutive quarters with a filing; the end is the next quarter of the list, or open."""
    panel, dates = _panel(spark, d)
    s = sq.islands(panel, "cik", "p")
    a = F.broadcast(dates.select(F.col("p").alias("first"), F.col("q").alias("first_quarter")))
    b = F.broadcast(dates.select((F.col("p") - 1).alias("last"), F.col("q").alias("end_quarter")))
    return s.join(a, "first").join(b, "last", "left").select("cik", "first_quarter", "end_quarter", F.col("n").alias("n_quarters"))


@query(f"""{_PANEL}, m as (select pq.cik, i.p from pq join i using (q)),
e as (select a.p, count(*) n from m a left join m b on b.cik = a.cik and b.p = a.p - 1 where b.cik is null group by a.p),
x as (select b.p + 1 as p, count(*) n from m b left join m a on a.cik = b.cik and a.p = b.p + 1 where a.cik is null group by b.p)
select i.q as quarter, (select count(*) from m where m.p = i.p) as members, coalesce(e.n, 0) as entries, coalesce(x.n, 0) as exits
from i left join e on e.p = i.p left join x on x.p = i.p""")
def churn(spark, d):
    """Members, entries and exits of each quarter; everyone enters in the first."""
    panel, dates = _panel(spark, d)
    marks = panel.select("cik", F.inline(F.array(
        F.struct(F.col("p").alias("at"), F.lit(1).alias("now"), F.lit(0).alias("before")), F.struct((F.col("p") + 1).alias("at"), F.lit(0).alias("now"), F.lit(1).alias("before")),
    )))
    both = marks.groupBy("cik", "at").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    c = both.groupBy("at").agg(F.sum("now").alias("members"), F.count_if(F.expr("now = 1 and before = 0")).alias("entries"), F.count_if(F.expr("now = 0 and before = 1")).alias("exits"))
    return c.join(F.broadcast(dates), c["at"] == dates["p"]).select(F.col("q").alias("quarter"), "members", "entries", "exits")


@query("""
with a as (select cast(cik as varchar) e, filed d, lpad(cast(fact_id as varchar), 12, '0') t, value v from (select distinct cik, filed, fact_id, value, concept from fundamental_facts) where concept = 'Assets' and filed is not null),
r as (select q.e, q.d, q.t, q.v, c.e as ce, case when c.e = q.e then q.v else c.v end as cv,
        row_number() over (partition by q.e, q.d, q.t, c.e order by c.d desc, c.t desc) rn
      from a q join a c on c.d <= q.d and c.d >= q.d - 180)
select e as cik, d as filed, t as fact, case when v is null or count(cv) < 2 then null
       else round((count(case when cv < v then 1 end) + 0.5 * count(case when cv = v then 1 end)) / count(cv), 6) end as pct
from r where rn = 1 group by e, d, t, v""")
def trailing_percentile(spark, d):
    return _trailing(spark, d, True)


@query("""
with a as (select cast(cik as varchar) e, filed d, lpad(cast(fact_id as varchar), 12, '0') t, value v from (select distinct cik, filed, fact_id, value, concept from fundamental_facts) where concept = 'Assets' and filed is not null),
r as (select q.e, q.d, q.t, q.v, c.v as cv, row_number() over (partition by q.e, q.d, q.t, c.e order by c.d desc, c.t desc) rn
      from a q left join a c on c.d < q.d and c.d >= q.d - 180)
select e as cik, d as filed, t as fact, case when v is null or count(cv) < 2 then null
       else round((count(case when cv < v then 1 end) + 0.5 * count(case when cv = v then 1 end)) / count(cv), 6) end as pct
from r where rn = 1 group by e, d, t, v""")
def trailing_percentile_earlier_days(spark, d):
    return _trailing(spark, d, False)


def _trailing(spark, d, same_day):
    a = facts(spark, d).where("concept = 'Assets'").select("cik", "filed", F.lpad(F.col("fact_id").cast("string"), 12, "0").alias("fact"), "value")
    out = sq.trailing_percentile(a, entity="cik", day="filed", tie="fact", value="value", same_day=same_day)
    return out.withColumn("pct", F.round("pct", 6))


_SCORED = "s as (select o_orderkey as id, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as q, o_totalprice as x, o_custkey from orders)"


@query(f"""
with {_SCORED}, t as (select *, count(*) over (partition by q) n, rank() over (partition by q order by x) lo, count(*) over (partition by q, x) ties from s),
p as (select *, (lo - 0.5) / n as a, (lo + ties - 1 - 0.5) / n as b, (lo + (ties - 1) / 2.0 - 0.5) / n as m from t)
select q, case when least(floor(a * 3), 2) <> least(floor(b * 3), 2) then 'no_call' when m >= 2.0 / 3 then 'upper' when m < 1.0 / 3 then 'lower' else 'middle' end as call, count(*) as n
from p group by 1, 2""")
def tercile_calls(spark, d):
    """Thirds by midrank within a quarter; ties that straddle a boundary are no call."""
    t = value_ranks(_orders(spark, d), ["q"], "x").select("q", F.col("group_size").alias("n"), F.col("lowest").alias("lo"), "ties")
    a, b, m = (F.col("lo") - 0.5) / F.col("n"), (F.col("lo") + F.col("ties") - 1.5) / F.col("n"), (F.col("lo") + (F.col("ties") - 1) / 2 - 0.5) / F.col("n")
    third = lambda c: F.least(F.floor(c * 3), F.lit(2))
    call = F.when(third(a) != third(b), "no_call").when(m >= 2 / 3, "upper").when(m < 1 / 3, "lower").otherwise("middle")
    return t.groupBy("q", call.alias("call")).agg(F.sum("ties").alias("n"))


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), fo.quarter_index(F.col("o_orderdate")).alias("q"), F.col("o_totalprice").alias("x"), F.col("o_custkey"), F.col("o_orderdate"))


_LINES = "l as (select l_orderkey as id, sum(l_quantity) as y from lineitem group by 1)"


@query(f"""
with {_SCORED}, {_LINES}, j as (select s.q, s.id, s.x, l.y from s join l using (id)),
r as (select *, row_number() over (partition by q order by x, id) rn, count(*) over (partition by q) n from j),
b as (select q, greatest(1, ceil(5.0 * (rn - 1) / greatest(n - 1, 1))) as bin, y from r)
select q, round(avg(case when bin = 5 then y end) - avg(case when bin = 1 then y end), 6) as spread, count(*) as n from b group by q""")
def quintile_spread(spark, d):
    j = _orders(spark, d).join(_line_sums(spark, d), "id")
    p = position_in_group(j.select("q", "x", "id", "y"), ["q"], [F.col("x"), F.col("id")])
    b = p.select("q", "y", F.greatest(F.lit(1), F.ceil(5 * F.col("position") / F.greatest(F.col("group_size") - 1, F.lit(1)))).alias("bin"))
    at = lambda k: F.avg(F.when(F.col("bin") == k, F.col("y")))
    return b.groupBy("q").agg(F.round(at(5) - at(1), 6).alias("spread"), F.count("*").alias("n"))


def _line_sums(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("y"))


@query(f"""
with {_SCORED}, {_LINES}, j as (select s.q, s.x, l.y from s join l using (id) where s.x is not null and l.y is not null),
r as (select q, rank() over (partition by q order by x) + (count(*) over (partition by q, x) - 1) / 2.0 as a,
        rank() over (partition by q order by y) + (count(*) over (partition by q, y) - 1) / 2.0 as b from j)
select q, count(*) as n, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) end as ic from r group by q""")
def rank_ic_by_period(spark, d):
    j = _orders(spark, d).join(_line_sums(spark, d), "id")
    return sq.rank_correlation(j, "q", "x", "y").withColumn("ic", F.round("ic", 6))


@query(f"""
with {_F}, r as (select *, row_number() over (partition by cik, form order by filing_date desc, accession_number desc) rn from f)
select cik, form, accession_number, rn as rank from r where rn <= 2""")
def newest_per_form(spark, d):
    top = sq.top_per_group(filings(spark, d), ["cik", "form"], [F.col("filing_date").desc(), F.col("accession_number").desc()], 2)
    return top.select("cik", "form", "accession_number", F.col("rank").cast("long").alias("rank"))


@query(f"""
with {_X}, r as (select *, row_number() over (partition by cik, concept, period_end order by filed, accession_number, fact_id) a,
   row_number() over (partition by cik, concept, period_end order by filed desc, accession_number desc, fact_id desc) b, count(*) over (partition by cik, concept, period_end) n from x where filed is not null)
select p.cik, p.concept, p.period_end, p.fact_id as first_fact, q.fact_id as last_fact, p.n as n_facts
from r p join r q on p.cik = q.cik and p.concept = q.concept and p.period_end is not distinct from q.period_end and p.a = 1 and q.b = 1""")
def first_and_last_filed(spark, d):
    """First and last disclosure of each period."""
    x = facts(spark, d).where("filed is not null")
    order = F.struct("filed", "accession_number", "fact_id")
    return x.groupBy("cik", "concept", "period_end").agg(
        F.min(order)["fact_id"].alias("first_fact"), F.max(order)["fact_id"].alias("last_fact"), F.count("*").alias("n_facts")
    )


_DAILY = "e as (select user_id, cast(ts as date) as day, avg(value) as v from events group by 1, 2)"


def _daily(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@query(f"""
with {_DAILY}, r as (select *, case when lag(v) over w > 0 and v > 0 then ln(v / lag(v) over w) end as lr, lag(v, 2) over w as v2, lag(v, 7) over w as v7 from e window w as (partition by user_id order by day)),
s as (select *, case when count(lr) over f = 5 then stddev_samp(lr) over f end as vol from r window f as (partition by user_id order by day rows between 4 preceding and current row))
select user_id, day, round(v2 / nullif(v7, 0) - 1, 6) as momentum, round(vol, 6) as volatility from s""")
def momentum_and_volatility(spark, d):
    """Change from 7 to 2 observations ago, and the deviation of the last 5 log changes, if all are there. One row per user and day."""
    w = Window.partitionBy("user_id").orderBy("day")
    before = F.lag("v").over(w)
    r = _daily(spark, d).select("user_id", "day", F.when((before > 0) & (F.col("v") > 0), F.log(F.col("v") / before)).alias("lr"), F.lag("v", 2).over(w).alias("v2"), F.lag("v", 7).over(w).alias("v7"))
    f = w.rowsBetween(-4, 0)
    vol = F.when(F.count("lr").over(f) == 5, F.stddev_samp("lr").over(f))
    return r.select("user_id", "day", F.round(F.try_divide(F.col("v2"), F.nullif(F.col("v7"), F.lit(0.0))) - 1, 6).alias("momentum"), F.round(vol, 6).alias("volatility"))


@query(f"""
with {_DAILY}, s as (select day, sum(v) s, count(v) n from e group by day)
select e.user_id, e.day, round(e.v - (s.s - e.v) / nullif(s.n - 1, 0), 6) as excess, s.n - 1 as n_peers from e join s using (day)""")
def peer_excess(spark, d):
    """Against the mean of the others of the day."""
    e = _daily(spark, d)
    s = e.groupBy("day").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    others = F.try_divide(F.col("s") - F.col("v"), F.nullif(F.col("n") - 1, F.lit(0).cast("long")))
    return e.join(broadcast_if_small(s), "day").select("user_id", "day", F.round(F.col("v") - others, 6).alias("excess"), (F.col("n") - 1).alias("n_peers"))


@query(f"""
with {_DAILY}, r as (select *, v / nullif(lag(v) over (partition by user_id order by day), 0) - 1 as ret from e),
b as (select greatest(0.15, quantile_cont(abs(ret), 0.995)) as bound from r where ret is not null)
select r.user_id, r.day, round(r.ret, 6) as ret, round(b.bound, 6) as bound from r, b where abs(r.ret) > b.bound""")
def outliers_beyond_bound(spark, d):
    """Daily changes beyond the 99.5 % quantile of their size, exact for any number of rows."""
    w = Window.partitionBy("user_id").orderBy("day")
    r = _daily(spark, d).withColumn("ret", F.try_divide(F.col("v"), F.nullif(F.lag("v").over(w), F.lit(0.0))) - 1).where("ret is not null")
    q = sq.exact_quantiles(r.withColumn("size", F.abs("ret")), "size", [0.995])[0]
    bound = max(0.15, q if q is not None else 0.15)
    return r.where(F.abs("ret") > bound).select("user_id", "day", F.round("ret", 6).alias("ret"), F.round(F.lit(bound), 6).alias("bound"))


@query(f"""
with {_DAILY}, c as (select distinct day from e), u as (select user_id, min(day) a, max(day) b from e group by 1),
g as (select u.user_id, c.day from u join c on c.day between u.a and u.b)
select g.user_id, g.day, round(last_value(e.v ignore nulls) over (partition by g.user_id order by g.day), 6) as v, e.v is null as filled
from g left join e on e.user_id = g.user_id and e.day = g.day""")
def forward_filled(spark, d):
    """Every day of the calendar between a user's first and last, with the last value known; nothing after the last."""
    e = _daily(spark, d)
    days = e.select("day").distinct()
    u = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    g = u.select("user_id", F.explode(F.sequence("a", "b")).alias("day")).join(broadcast_if_small(days), "day", "left_semi")
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return g.join(e, ["user_id", "day"], "left").select("user_id", "day", F.round(F.last("v", ignorenulls=True).over(w), 6).alias("v"), F.col("v").isNull().alias("filled"))


@query(f"""
with {_DAILY}, f as (select *, 1 + v / 1000.0 as ratio from e)
select user_id, day, round(exp(coalesce(sum(ln(ratio)) over (partition by user_id order by day rows between 1 following and unbounded following), 0)), 10) as factor from f""")
def later_factor_product(spark, d):
    """Product of the ratios strictly after each day."""
    f = _daily(spark, d).withColumn("lr", F.log(1 + F.col("v") / 1000.0))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return f.select("user_id", "day", F.round(F.exp(F.coalesce(F.sum("lr").over(w), F.lit(0.0))), 10).alias("factor"))


# --- aggregates --------------------------------------------------------------------


@query("""
with p as (select distinct accession_number, section_type, position, form, word_count from paragraph_occurrences where word_count is not null)
select section_type, form, count(*) as n, round(quantile_cont(word_count, 0.1), 4) as p10, round(quantile_cont(word_count, 0.5), 4) as p50, round(quantile_cont(word_count, 0.9), 4) as p90
from p group by grouping sets ((section_type, form), (section_type), ())""")
def length_distribution(spark, d):
    """Exact quantiles of word counts by section and form, by section, and over all, from one count per value."""
    p = table(spark, d, "paragraph_occurrences").where("word_count is not null").select("accession_number", "section_type", "position", "form", "word_count").distinct()
    counts = p.groupBy("section_type", "form", "word_count").agg(F.count("*").alias("k"))
    at = lambda q: F.round(F.percentile("word_count", q, F.col("k")), 4)
    sets = counts.groupingSets([["section_type", "form"], ["section_type"], []], "section_type", "form")
    return sets.agg(F.sum("k").alias("n"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("""
select source, count(case when lang = 'en' then 1 end) as en, count(case when lang = 'de' then 1 end) as de, count(case when lang = 'fr' then 1 end) as fr,
 count(case when lang is null then 1 end) as none, count(*) as n from (select distinct doc_id, source, lang from documents) group by source""")
def source_language_pivot(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang").distinct()
    return docs.groupBy("source").agg(
        *(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr")), F.count_if(F.col("lang").isNull()).alias("none"), F.count("*").alias("n")
    )


@query("""
with l as (select distinct doc_id, abusive, reviewer from review_labels where abusive is not null),
j as (select d.source, l.abusive from l join (select distinct doc_id, source from documents) d using (doc_id)),
s as (select source, count(*) n, sum(abusive) k from j group by source)
select source, n, k as hits, round(k / n, 6) as rate,
 round((k / n + 1.959964 * 1.959964 / (2 * n) - 1.959964 * sqrt(k / n * (1 - k / n) / n + 1.959964 * 1.959964 / (4.0 * n * n))) / (1 + 1.959964 * 1.959964 / n), 6) as lower,
 round((k / n + 1.959964 * 1.959964 / (2 * n) + 1.959964 * sqrt(k / n * (1 - k / n) / n + 1.959964 * 1.959964 / (4.0 * n * n))) / (1 + 1.959964 * 1.959964 / n), 6) as upper from s""")
def label_rates(spark, d):
    """Rates of positive labels per source with Wilson's interval."""
    labels = table(spark, d, "review_labels").where("abusive is not null").select("doc_id", "abusive", "reviewer").distinct()
    j = labels.join(table(spark, d, "documents").select("doc_id", "source").distinct(), "doc_id")
    r = metrics.rate_by(j, ["source"], F.col("abusive") == 1)
    return r.select("source", "n", "hits", *(F.round(c, 6).alias(c) for c in ("rate", "lower", "upper")))


@query("""
with l as (select distinct doc_id, abusive, reviewer, labelled_at from review_labels where abusive is not null),
p as (select a.abusive g, b.abusive p from l a join l b on a.doc_id = b.doc_id and (a.labelled_at, a.reviewer) < (b.labelled_at, b.reviewer)),
k as (select 0 as label union all select 1),
c as (select label, (select count(*) from p where g = label) s, (select count(*) from p where p = label) m, (select count(*) from p where g = label and p = label) t from k)
select cast(label as varchar) as label, s as support, t as tp, m - t as fp, s - t as fn, round(coalesce(t / nullif(m, 0), 0), 6) as precision, round(coalesce(t / nullif(s, 0), 0), 6) as recall,
 round(coalesce(2.0 * t / nullif(m + s, 0), 0), 6) as f1 from c where s + m > 0""")
def reviewer_agreement(spark, d):
    """Second labels of a document scored against first ones, per class."""
    l = table(spark, d, "review_labels").where("abusive is not null").select("doc_id", "abusive", "reviewer", "labelled_at").distinct()  # noqa: E741
    w = Window.partitionBy("doc_id").orderBy("labelled_at", "reviewer")
    pairs = l.withColumn("_n", F.collect_list("abusive").over(w.rowsBetween(1, Window.unboundedFollowing))).select("abusive", F.explode("_n").alias("p"))
    s = metrics.class_scores(pairs, "abusive", "p")
    return s.select("label", "support", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""
with l as (select distinct doc_id, abusive, reviewer from review_labels where abusive is not null),
j as (select coalesce(d.lang, '?') lang, l.abusive, d.n_chars from l join (select distinct doc_id, lang, n_chars from documents where n_chars is not null) d using (doc_id)),
r as (select *, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as k from j),
s as (select lang, count(case when abusive = 1 then 1 end) p, count(case when abusive = 0 then 1 end) n, sum(case when abusive = 1 then k end) t from r group by lang)
select lang, p as n_pos, n as n_neg, round((t - p * (p + 1) / 2.0) / nullif(p * n, 0), 6) as auc from s""")
def auc_of_length(spark, d):
    labels = table(spark, d, "review_labels").where("abusive is not null").select("doc_id", "abusive", "reviewer").distinct()
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), "n_chars").distinct()
    return metrics.auc_by(labels.join(docs, "doc_id"), "lang", "abusive", "n_chars").withColumn("auc", F.round("auc", 6))


@query("""
with g as (select l_suppkey, count(*) n, sum(l_quantity) s, sum(l_quantity * l_quantity) q from lineitem where l_quantity is not null and l_suppkey is not null group by 1),
t as (select count(*) k, sum(n) n, sum(s) s, sum(q) q, sum(s * s / n) b, sum(n * n) nn from g),
m as (select k, n, (b - s * s / n) / (k - 1) as msb, (q - b) / (n - k) as msw, (n - nn / n) / (k - 1) as n0 from t)
select k as n_groups, n::bigint as n, round((msb - msw) / (msb + (n0 - 1) * msw), 6) as icc from m""")
def icc_of_quantity(spark, d):
    return metrics.intraclass(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").withColumn("icc", F.round("icc", 6))


@query(f"""
with {_X}, c as (select cik, concept, coalesce(unit, '') u, count(*) n from x group by 1, 2, 3),
r as (select *, row_number() over (partition by cik, concept order by n desc, u) rn from c)
select cik, concept, max(case when rn = 1 then u end) as unit, sum(n)::bigint as n, count(*) > 1 as mixed, string_agg(u || ':' || n, ',' order by n desc, u) as profile from r group by 1, 2""")
def unit_profile(spark, d):
    """The most frequent unit of each concept, ties by name, and the whole profile."""
    c = facts(spark, d).groupBy("cik", "concept", F.coalesce("unit", F.lit("")).alias("u")).agg(F.count("*").alias("n"))
    per = c.groupBy("cik", "concept").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "u", "n"))).alias("p"), F.sum("n").alias("n"))
    return per.select(
        "cik", "concept", F.col("p")[0]["u"].alias("unit"), "n", (F.size("p") > 1).alias("mixed"),
        F.array_join(F.transform("p", lambda x: F.concat(x["u"], F.lit(":"), x["n"].cast("string"))), ",").alias("profile"),
    )


@query(f"""
with {_X}, {_F}, l as (select cik, max(filed) m from x group by cik)
select l.cik, l.m as last_filed, count(f.accession_number) as n_later, case when count(f.accession_number) >= 2 then 'WARN' when count(f.accession_number) = 1 then 'INFO' else 'OK' end as severity
from l left join f on f.cik = l.cik and f.filing_date > l.m and f.form in ('10-K', '10-Q') group by 1, 2""")
def tail_lag(spark, d):
    """Periodic filings after the last fact of each entity."""
    last = facts(spark, d).groupBy("cik").agg(F.max("filed").alias("last_filed"))
    f = filings(spark, d).where(F.col("form").isin("10-K", "10-Q")).select("cik", "filing_date")
    n = last.join(f, "cik", "left").groupBy("cik", "last_filed").agg(F.count_if(F.col("filing_date") > F.col("last_filed")).alias("n_later"))
    return n.withColumn("severity", F.when(F.col("n_later") >= 2, "WARN").when(F.col("n_later") == 1, "INFO").otherwise("OK"))


@query(f"""
with {_F} select coalesce(case when report_date is null then 'no_report_date' end, case when acceptance_datetime is null then 'no_acceptance' end,
  case when cast(acceptance_datetime as date) > filing_date + 5 then 'late_acceptance' end, case when form like '%/A' then 'amendment' end, 'none') as reason, count(*) as n from f group by 1""")
def first_reason(spark, d):
    """The first reason that applies, in a fixed order."""
    late = F.to_date("acceptance_datetime") > F.date_add("filing_date", 5)
    reason = F.coalesce(
        F.when(F.col("report_date").isNull(), "no_report_date"), F.when(F.col("acceptance_datetime").isNull(), "no_acceptance"), F.when(late, "late_acceptance"),
        F.when(F.col("form").endswith("/A"), "amendment"), F.lit("none"),
    )
    return filings(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
with {_F}, i as (select accession_number, trim(unnest(string_split(items, ','))) as item from f where items is not null)
select item, count(distinct accession_number) as n from i where item <> '' group by item""")
def item_counts(spark, d):
    parts = F.transform(F.split("items", ","), lambda x: F.btrim(x))
    i = filings(spark, d).where("items is not null").select("accession_number", F.explode(parts).alias("item")).where("item <> ''")
    return i.groupBy("item").agg(F.count_distinct("accession_number").alias("n"))


# --- sets, text, graph -------------------------------------------------------------

_PARA = """o as (select distinct t.paragraph_id as id, u.o.accession_number as a, u.o.section_type as s from canonical_paragraphs t, unnest(t.occurrences) as u(o))"""


def _occurrences(spark, d):
    return table(spark, d, "canonical_paragraphs").select("paragraph_id", F.explode("occurrences").alias("o")).select(
        "paragraph_id", F.col("o.cik").alias("cik"), F.col("o.accession_number").alias("accession_number"), F.col("o.section_type").alias("section_type")
    ).distinct()


@query(f"""
with {_F}, {_PARA}, p as (select a.accession_number, b.accession_number as prior, row_number() over (partition by a.accession_number order by b.filing_date desc, b.accession_number desc) rn
   from f a join f b on a.cik = b.cik and a.form = b.form and b.filing_date < a.filing_date),
q as (select accession_number, prior from p where rn = 1), m as (select distinct a, id from o),
x as (select q.accession_number, m.id, 1 as here, 0 as there from q join m on m.a = q.accession_number union all select q.accession_number, m.id, 0, 1 from q join m on m.a = q.prior),
g as (select accession_number, id, max(here) h, max(there) t from x group by 1, 2)
select accession_number, count(case when h = 1 and t = 0 then 1 end) as n_new, count(case when h = 0 then 1 end) as n_removed, count(case when h = 1 and t = 1 then 1 end) as n_unchanged from g group by 1""")
def passages_against_prior(spark, d):
    """New, removed and unchanged paragraphs against the previous filing of the same form (ties: the largest accession)."""
    f = filings(spark, d).select("accession_number", "cik", "form", "filing_date")
    known = latest_known(f, f, keys=["cik", "form"], at="filing_date", available=F.col("filing_date"), order=[F.col("filing_date").alias("day"), F.col("accession_number").alias("prior")], inclusive=False)
    q = f.join(known.where("known is not null").select("cik", "form", "filing_date", F.col("known.prior").alias("prior")), ["cik", "form", "filing_date"]).select("accession_number", "prior")
    m = _occurrences(spark, d).select(F.col("accession_number").alias("_a"), "paragraph_id").distinct()
    mark = lambda col, here, there: q.join(m, F.col(col) == F.col("_a")).select("accession_number", "paragraph_id", F.lit(here).alias("h"), F.lit(there).alias("t"))
    g = mark("accession_number", 1, 0).unionByName(mark("prior", 0, 1)).groupBy("accession_number", "paragraph_id").agg(F.max("h").alias("h"), F.max("t").alias("t"))
    return g.groupBy("accession_number").agg(F.count_if(F.expr("h = 1 and t = 0")).alias("n_new"), F.count_if(F.expr("h = 0")).alias("n_removed"), F.count_if(F.expr("h = 1 and t = 1")).alias("n_unchanged"))


_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""
with p as (select distinct cik, accession_number, filing_date, section_type, position, lower(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) as n from paragraph_occurrences where text is not null),
r as (select *, row_number() over (partition by n order by filing_date, lpad(cast(cik as varchar), 10, '0'), accession_number, section_type, position) rn,
   count(*) over (partition by n) k from p)
select 'P-' || substr(sha1(n), 1, 16) as paragraph_id, accession_number as home_accession, section_type as home_section, position as home_position, k as n_occurrences from r where rn = 1""")
def canonical_homes(spark, d):
    """Distinct paragraphs with the place where each first stood."""
    p = table(spark, d, "paragraph_occurrences").select("cik", "accession_number", "filing_date", "section_type", "position", "text")
    home = [F.col("filing_date"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("c"), F.col("accession_number"), F.col("section_type"), F.col("position")]
    c = tx.canonical_paragraphs(p, "text", home, [F.col(x) for x in ("accession_number", "section_type", "position")])
    return c.select("paragraph_id", F.col("home.accession_number").alias("home_accession"), F.col("home.section_type").alias("home_section"), F.col("home.position").alias("home_position"), "n_occurrences")


@query(f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as p from (select distinct doc_id, text from documents where text is not null)),
c as (select doc_id, p, trim(regexp_replace(l, '{_WS}+', ' ', 'g')) as n from l),
k as (select *, len(string_split(n, ' ')) as w from c where n <> '')
select doc_id, row_number() over (partition by doc_id order by p) - 1 as position, w as n_words from k where w >= 40""")
def prose_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return tx.prose_lines(docs, ["doc_id"], "text").select("doc_id", F.col("position").cast("long").alias("position"), F.col("n_words").cast("long").alias("n_words"))


@query(f"""
with recursive c as (select distinct paragraph_id, normalized_text, home_accession_number a, home_section_type s, home_position p from canonical_paragraphs),
w as (select *, case when t = '' then 0 else len(string_split(t, ' ')) end as w from (select *, trim(regexp_replace(normalized_text, '{_WS}+', ' ', 'g')) as t from c)),
k as (select a, s, paragraph_id as i, w, row_number() over (partition by a, s order by p, w, paragraph_id) as rn, count(*) over (partition by a, s) as n from w),
f as (select a, s, rn, n, 0 as win, w as total, [i] as items from k where rn = 1
      union all select k.a, k.s, k.rn, k.n, case when f.total >= 350 then f.win + 1 else f.win end, case when f.total >= 350 then k.w else f.total + k.w end,
        case when f.total >= 350 then [k.i] else list_append(f.items, k.i) end from f join k on k.a = f.a and k.s = f.s and k.rn = f.rn + 1)
select a as home_accession_number, s as home_section_type, win as "window", total as n_words, items from f where total >= 350 or (rn = n and total >= 100)""")
def packed_windows(spark, d):
    """Home paragraphs packed into windows of 350 words or more per section."""
    c = table(spark, d, "canonical_paragraphs").select("paragraph_id", "normalized_text", "home_accession_number", "home_section_type", "home_position").distinct()
    c = c.withColumn("w", tx.word_count(F.col("normalized_text")))
    return tx.packed_windows(c, ["home_accession_number", "home_section_type"], "home_position", "paragraph_id", "w")


@query(f"""
with {_F}, k as (select accession_number, cik, form, filing_date from f where form in ('10-K', '10-Q')),
pp as (select a.accession_number, b.accession_number as prior, row_number() over (partition by a.accession_number order by abs(date_diff('day', b.filing_date, a.filing_date) - 365), b.accession_number) rn
      from k a join k b on a.cik = b.cik and a.form = b.form and date_diff('day', b.filing_date, a.filing_date) between 300 and 430),
t as (select distinct accession_number a, section_type s, position p, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '{_WS}+', ' ', 'g'))), ' '), lambda x: x <> '') w from paragraph_occurrences where text is not null),
g as (select distinct a, s, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) h from t where len(w) >= 5),
n as (select a, s, count(*) n from g group by 1, 2),
q as (select pp.accession_number, pp.prior, x.s, x.n as na, y.n as nb from pp join n x on x.a = pp.accession_number join n y on y.a = pp.prior and y.s = x.s where pp.rn = 1),
c as (select q.accession_number, q.s, count(*) k from q join g x on x.a = q.accession_number and x.s = q.s join g y on y.a = q.prior and y.s = q.s and y.h = x.h group by 1, 2)
select q.accession_number, q.s as section_type, q.prior as prior_accession, case when least(q.na, q.nb) >= 50 then round(1 - coalesce(c.k, 0) / (q.na + q.nb - coalesce(c.k, 0)), 6) end as novelty
from q left join c using (accession_number, s)""")
def section_novelty(spark, d):
    """1 - Jaccard of the sections' shingles of five words against the filing of a year before; null under 50 shingles."""
    k = filings(spark, d).where(F.col("form").isin("10-K", "10-Q"))
    pairs = partner_near(k, keys=["cik", "form"], day="filing_date", tie="accession_number", least=300, most=430, ideal=365).select("accession_number", F.col("partner").alias("prior_accession"))
    pairs = checkpointed(pairs)
    # 64-bit ids, so that few take little room; a filing let through by an equal hash finds no pair below
    ids = pairs.select(F.explode(F.array(F.xxhash64("accession_number"), F.xxhash64("prior_accession"))).alias("_id")).distinct()
    few = pairs.count() <= 1_000_000
    needed = table(spark, d, "paragraph_occurrences").withColumn("_id", F.xxhash64("accession_number")).join(F.broadcast(ids) if few else ids, "_id", "left_semi")
    section = needed.select("accession_number", "section_type", F.xxhash64("accession_number", "section_type").alias("s"), "text")
    g = tx.shingle_rows(section, ["s"], "text").distinct()
    sizes = g.groupBy("s").agg(F.count("*").alias("n"))
    n = section.where("text is not null").select("accession_number", "section_type", "s").distinct().join(sizes, "s")
    mine = n.select("accession_number", "section_type", F.col("s").alias("sa"), F.col("n").alias("na"))
    prior = n.select(F.col("accession_number").alias("prior_accession"), "section_type", F.col("s").alias("sb"), F.col("n").alias("nb"))
    q = pairs.join(mine, "accession_number").join(prior, ["prior_accession", "section_type"])
    met = q.select("sa", "sb").join(g.withColumnRenamed("s", "sa"), "sa").join(g.withColumnRenamed("s", "sb"), ["sb", "h"])
    both = q.join(met.groupBy("sa", "sb").agg(F.count("*").alias("k")), ["sa", "sb"], "left")
    share = F.coalesce("k", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("k", F.lit(0)))
    return both.select("accession_number", "section_type", "prior_accession", F.when(F.least("na", "nb") >= 50, F.round(1 - share, 6)).alias("novelty"))


@query(f"""
with d as (select distinct doc_id, accession_number, sha1(lower(trim(regexp_replace(text, '{_WS}+', ' ', 'g')))) h from documents where text is not null),
m as (select distinct accession_number, split from split_manifest), t as (select distinct d.h from d join m using (accession_number) where m.split = 'train')
select d.doc_id, m.split from d join m using (accession_number) where m.split in ('eval', 'test') and d.h in (select h from t)""")
def identical_to_training(spark, d):
    """Evaluation documents whose normalised text is that of a training document."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "accession_number", F.sha1(tx.normalised(F.col("text"))).alias("h")).distinct()
    m = docs.join(table(spark, d, "split_manifest").distinct(), "accession_number")
    train = m.where("split = 'train'").select("h").distinct()
    return m.where("split in ('eval', 'test')").join(train, "h", "left_semi").select("doc_id", "split")


#: Answers without the blanks and the code fence around them, as ``t``.
_ANSWER = r"""
a0 as (select distinct prediction_id, chunk_id, raw_output, regexp_replace(raw_output, '^\s+|\s+$', '', 'g') as s from predictions),
a1 as (select *, case when starts_with(s, '```') then regexp_replace(regexp_replace(trim(s, '`'), '^json', ''), '^\s+|\s+$', '', 'g') else s end as t from a0),
a2 as (select *, case when raw_output is null then 'null_output' when not json_valid(t) then 'json_decode_error' when json_type(t::json) <> 'OBJECT' then 'not_a_json_object' end as reason from a1),
answers as (select *, case when reason is null then t::json end as j from a2)"""


@query(f"""
with {_ANSWER} select coalesce(reason, 'parsed') as outcome, j->>'$.sentiment' as sentiment, count(distinct prediction_id) as n from answers group by 1, 2""")
def answer_outcomes(spark, d):
    """Every answer by outcome (parsed, or the reason why not) and sentiment, null answers included."""
    p = table(spark, d, "predictions").select("prediction_id", "raw_output").distinct().select("prediction_id", read_answer(F.col("raw_output")).alias("r"))
    return p.groupBy(F.coalesce("r.reason", F.lit("parsed")).alias("outcome"), F.col("r.sentiment").alias("sentiment")).agg(F.count_distinct("prediction_id").alias("n"))


@query()
def plain_documents(spark, d):
    """Documents without markup."""
    return tx.plain_texts(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text").distinct()


_COMPONENTS = """
with recursive o as (select distinct t.paragraph_id as v, u.o.accession_number as n from canonical_paragraphs t, unnest(t.occurrences) as u(o)),
s as (select n, min(n) over (partition by v) as hub from o where v is not null and n is not null),
e as (select n as a, hub as b from s where n <> hub union select hub, n from s where n <> hub),
r(n, l) as (select distinct n, n from o where n is not null union select e.b, r.l from r join e on e.a = r.n),
c as (select n as accession_number, min(l) as component from r group by n)
"""


@query(_COMPONENTS + "select accession_number, component from c")
def filing_components(spark, d):
    """Filings connected through shared paragraphs."""
    return graph.components(_occurrences(spark, d), "accession_number", "paragraph_id")


@query("""
with c as (select coalesce(source, '?') s, count(*) n from (select distinct doc_id, source from documents) group by 1),
q as (select s, floor(n * 100 / (select sum(n) from c)) f, round(n * 100 / (select sum(n) from c) - floor(n * 100 / (select sum(n) from c)), 12) r from c),
p as (select *, row_number() over (order by r desc, s) k, 100 - sum(f) over () l from q)
select s as source, (f + case when k <= l then 1 else 0 end)::bigint as allocated from p""")
def largest_remainder(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source")).distinct().groupBy("source").agg(F.count("*").alias("n"))
    return graph.largest_remainder(c, "source", "n", 100)


@query("""
with r as (select doc_id, source, row_number() over (partition by source order by sha256('seed-1|' || doc_id), doc_id) k from (select distinct doc_id, source from documents))
select doc_id, source, k as draw from r where k <= 5""")
def hash_sample(spark, d):
    """Five documents of each source, the same on every run."""
    s = graph.hash_sample(table(spark, d, "documents").select("doc_id", "source").distinct(), ["source"], "doc_id", 5, "seed-1")
    return s.select("doc_id", "source", F.col("draw").cast("long").alias("draw"))


@query("""
select c_custkey, round(('0x' || substr(sha256(c_custkey || '|' || c_mktsegment), 1, 16))::ubigint::double / 18446744073709551616.0, 9) as u from customer""")
def placebo_uniform(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(graph.hash_uniform(F.col("c_custkey").cast("string"), F.col("c_mktsegment")), 9).alias("u"))


# --- folds and models --------------------------------------------------------------

_ROWS = "r as (select o_orderkey id, o_custkey c, cast(o_orderdate as date) d, cast(o_orderdate as date) + 63 as e, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as q, round(o_totalprice * 100)::bigint y, o_orderpriority g from orders)"
_FOLDS = f"""with {_ROWS}, k as (select distinct q as fold, make_date((q // 4)::int, (q % 4 * 3 + 1)::int, 1) as s from r where q >= 7982),
t as (select k.fold, r.* from k join r on r.q < k.fold and r.q >= k.fold - 4 and r.e < k.s),
u as (select fold, count(*) n from t group by fold)"""


def _fold_rows(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.date_add(F.to_date("o_orderdate"), 63).alias("e"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("y"), F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("c"),
    )
    return fo.walk_forward(o, "d", closes="e", window=4, first=7982)


@query(f"""{_FOLDS} select u.fold, u.n as n_train, (select count(*) from r where r.q = u.fold) as n_test, 0::bigint as leaks from u""")
def fold_census(spark, d):
    """Rolling folds of four quarters, purged of outcomes that close in the test quarter."""
    return fo.fold_census(_fold_rows(spark, d), "d")


@query(f"""{_FOLDS}, m as (select fold, g, avg(y) v from t group by 1, 2), a as (select fold, avg(y) v from t group by 1)
select r.q as fold, r.id, round(coalesce(m.v, a.v), 6) as prediction from r join a on a.fold = r.q left join m on m.fold = r.q and m.g = r.g""")
def group_mean_prediction(spark, d):
    return fo.group_mean_prediction(_fold_rows(spark, d), "g", "y", "id").withColumn("prediction", F.round("prediction", 6))


@query()
def ridge_prediction(spark, d):
    rows = _fold_rows(spark, d).withColumn("x1", F.month("d")).withColumn("x2", F.log1p(F.col("c").cast("double")))
    return fo.ridge_predictions(rows, ["x1", "x2"], "y", "id")


@query(f"""{_FOLDS}, m as (select fold, g, avg(y) v from t group by 1, 2), a as (select fold, avg(y) v from t group by 1),
p as (select r.q as fold, r.y, coalesce(m.v, a.v) as p from r join a on a.fold = r.q left join m on m.fold = r.q and m.g = r.g),
z as (select fold, rank() over (partition by fold order by p) + (count(*) over (partition by fold, p) - 1) / 2.0 as a, rank() over (partition by fold order by y) + (count(*) over (partition by fold, y) - 1) / 2.0 as b from p)
select fold, count(*) as n, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) end as ic from z group by fold""")
def walk_forward_ic(spark, d):
    """Rank correlation of prediction and outcome in each fold."""
    rows = _fold_rows(spark, d)
    p = fo.group_mean_prediction(rows, "g", "y", "id")
    outcome = rows.where("role = 'test'").select("fold", "id", "y")
    return sq.rank_correlation(p.join(outcome, ["fold", "id"]), "fold", "prediction", "y").withColumn("ic", F.round("ic", 6))


@query("""
select label, dim - 1 as dim, round(avg(v), 5) as mean from (select label, unnest(embedding) v, generate_subscripts(embedding, 1) dim from embeddings) group by 1, 2""")
def pooled_embedding(spark, d):
    return fo.pooled_mean(table(spark, d, "embeddings"), ["label"], "embedding").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 5).alias("mean"))


@query()
def embedding_axes(spark, d):
    """Coordinates along the first three principal axes."""
    e = table(spark, d, "embeddings")
    mean, axes = fo.principal_axes(e, "embedding", 64, 3)
    return fo.projected(e, "vec_id", "embedding", mean, axes)


# --- invariants --------------------------------------------------------------------


@query(f"""
with {_F}, {_X}
select 'filings_key' as "check", 'FATAL' as severity, count(*) as n_bad from (select accession_number from f group by 1 having count(*) > 1)
union all select 'facts_key', 'FATAL', count(*) from (select fact_id from x group by 1 having count(*) > 1)
union all select 'home_after_occurrence', 'FATAL', count(case when o.filing_date < t.home_filing_date then 1 end) from (select distinct * from canonical_paragraphs) t, unnest(t.occurrences) as u(o)
union all select 'facts_without_filing', 'WARN', count(*) from (select distinct accession_number from x where accession_number is not null and accession_number not in (select accession_number from f))
union all select 'inverted_spells', 'WARN', count(case when member_to <= member_from then 1 end) from (select distinct * from universe_membership)
union all select 'report_after_filing', 'INFO', count(case when report_date > filing_date then 1 end) from f""")
def invariants(spark, d):
    f, x = filings(spark, d), facts(spark, d)
    homes = table(spark, d, "canonical_paragraphs").select("paragraph_id", "home_filing_date", "home_section_type", "home_position", "occurrences").distinct()
    homes = homes.select("home_filing_date", F.explode("occurrences").alias("o"))
    return quality.report([
        quality.unique_key("filings_key", f, ["accession_number"]),
        quality.unique_key("facts_key", x, ["fact_id"]),
        quality.no_rows("home_after_occurrence", homes, F.col("o.filing_date") < F.col("home_filing_date")),
        quality.no_orphans("facts_without_filing", x, f, ["accession_number"]),
        quality.no_rows("inverted_spells", table(spark, d, "universe_membership").distinct(), F.col("member_to") <= F.col("member_from"), "WARN"),
        quality.no_rows("report_after_filing", f, F.col("report_date") > F.col("filing_date"), "INFO"),
    ])


@query("""
with n as (select distinct cik, concept, unit from fundamental_facts), a as (select cik, min(unit) u from n where concept = 'Assets' group by cik),
r as (select cik, min(unit) u from (select distinct cik, family, unit from concept_resolution) where family = 'assets' group by cik)
select coalesce(a.cik, r.cik) as cik, case when r.cik is null then 'added' when a.cik is null then 'removed' when a.u is distinct from r.u then 'changed' end as change
from a full join r on a.cik = r.cik where r.cik is null or a.cik is null or a.u is distinct from r.u""")
def drift_of_units(spark, d):
    """Recorded units of assets against those of the facts: added, removed, changed. ``drift_of_family_units`` covers all families."""
    a = facts(spark, d).where("concept = 'Assets'").groupBy("cik").agg(F.min("unit").alias("u"))
    r = table(spark, d, "concept_resolution").where("family = 'assets'").groupBy("cik").agg(F.min("unit").alias("u"))
    return quality.drift(r, a, ["cik"], ["u"])


@query("""
with a as (select f.cik, c.family, min(f.unit) as u from fundamental_facts f join (select distinct family, taxonomy, concept from concept_families) c using (taxonomy, concept) group by 1, 2),
r as (select cik, family, min(unit) as u from concept_resolution group by 1, 2)
select coalesce(a.cik, r.cik) as cik, coalesce(a.family, r.family) as family, case when r.cik is null then 'added' when a.cik is null then 'removed' else 'changed' end as change
from a full join r on a.cik = r.cik and a.family = r.family where r.cik is null or a.cik is null or a.u is distinct from r.u""")
def drift_of_family_units(spark, d):
    """Recorded units against those of the facts by entity and family, for all families of concepts: added, removed, changed.

    The unit is the least one, as in ``drift_of_units``. Facts of concepts in no family do not count.
    """
    family = table(spark, d, "concept_families").select("family", "taxonomy", "concept").distinct()
    a = table(spark, d, "fundamental_facts").join(broadcast_if_small(family), ["taxonomy", "concept"]).groupBy("cik", "family").agg(F.min("unit").alias("u"))
    r = table(spark, d, "concept_resolution").groupBy("cik", "family").agg(F.min("unit").alias("u"))
    return quality.drift(r, a, ["cik", "family"], ["u"])
