"""Further queries: scalar functions, sessions, rollups, classifiers, samples and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from meridian.functions import scalar as sc
from meridian.operators import folds as fo
from meridian.operators import graph
from meridian.operators import inference, sessions
from meridian.operators import sequence as sq
from meridian.operators import text as tx
from meridian.operators.answers import read_answer
from meridian.operators.asof import duration_bucket, partner_near
from meridian.operators.families import classify
from meridian.operators.order import position_in_group, row_index
from meridian.plans.reference import _ANSWER, _BUCKET, _COMPONENTS, _DAILY, _F, _PARA, _X, _daily, _occurrences, facts, filings
from meridian.session import broadcast_if_small, checkpointed, drop_folder, shared_folder, table
from meridian.streaming import journal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
with {_X}, b as (select *, {_BUCKET} as bucket from x)
select fact_id, case when abs(value) >= 1e-6 then round(1e6 / value, 9) end as inverse, case when value > 0 then round(ln(value), 9) end as log_value,
 year(filed) || 'Q' || quarter(filed) as filed_quarter, coalesce(nullif(regexp_extract(unit, '^([A-Z]{{3}})(/|$)', 1), ''), case when unit is null then null else '' end) as currency,
 regexp_replace(upper(trim(form)), '/A$', '') as base_form, lpad(cast(cik as varchar), 10, '0') as padded_cik, bucket,
 case when bucket = 'instant' then strftime(period_end, '%Y-%m-%d') when bucket = 'FY' then 'FY' || coalesce(fy::varchar, year(period_end)::varchar) else bucket || ' ' || strftime(period_end, '%Y-%m') end as label,
 (period_end - interval 12 month)::date as year_before from b""")
def scalar_functions(spark, d):
    """Guarded division, logarithm, quarter and period labels, currency of a unit, base form, padded id, the day a year before."""
    b = facts(spark, d).withColumn("bucket", duration_bucket(F.col("period_start"), F.col("period_end")))
    return b.select(
        "fact_id", F.round(sc.safe_ratio(F.lit(1e6), F.col("value")), 9).alias("inverse"), F.round(sc.log_level(F.col("value")), 9).alias("log_value"),
        sc.quarter_label(F.col("filed")).alias("filed_quarter"), sc.unit_currency(F.col("unit")).alias("currency"), sc.base_form(F.col("form")).alias("base_form"),
        sc.padded_id(F.col("cik")).alias("padded_cik"), "bucket", sc.period_label(F.col("bucket"), F.col("period_end"), F.col("fy")).alias("label"),
        F.add_months("period_end", -12).alias("year_before"),
    )


@query(f"""
with {_F} select accession_number, coalesce(list_contains(list_transform(string_split(items, ','), lambda x: trim(x)), '2.02'), false) as has_202,
 case when filing_date is not null then [year(filing_date) * 4 + quarter(filing_date) - 1 - 2, year(filing_date) * 4 + quarter(filing_date) - 1 - 1] end as quarters_before from f""")
def filing_functions(spark, d):
    return filings(spark, d).select("accession_number", sc.has_item(F.col("items"), "2.02").alias("has_202"), sc.quarters_before(F.col("filing_date"), 2).alias("quarters_before"))


@query(f"""
with {_F}, z as (select *, year(acceptance_datetime) as y from f),
u as (select *, acceptance_datetime - case when acceptance_datetime >= make_date(y::int, 3, 8) + ((7 - dayofweek(make_date(y::int, 3, 8))) % 7)::int + interval 7 hour
   and acceptance_datetime < make_date(y::int, 11, 1) + ((7 - dayofweek(make_date(y::int, 11, 1))) % 7)::int + interval 6 hour then interval 4 hour else interval 5 hour end as loc from z),
k as (select accession_number, filing_date, case when loc is not null and filing_date is not null then greatest(filing_date, loc::date) end as news_day, coalesce(hour(loc) >= 16, false) as late from u),
n as (select *, news_day + late::int as d from k), b as (select max(filing_date) + 40 as last from f),
s as (select n.*, d + case dayofweek(d) when 6 then 2 when 0 then 1 else 0 end as s from n)
select accession_number, filing_date, news_day, late, case when s <= last then s end as news_session from s, b""")
def news_sessions(spark, d):
    """The session on which each filing was news: weekdays are sessions, local time decides on the day and whether it was late."""
    f = filings(spark, d)
    day, late = sessions.news_day(F.col("filing_date"), F.col("acceptance_datetime"))
    span = f.agg(F.min("filing_date").alias("a"), F.date_add(F.max("filing_date"), 40).alias("b"))
    calendar = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("session")).where(F.weekday("session") < 5)
    e = f.select("accession_number", "filing_date", day.alias("news_day"), late.alias("late"))
    return sessions.news_sessions(e, calendar, day="news_day", late="late", session="session")


@query(f"""
with {_DAILY}, p as (select *, datediff('day', date '2024-01-01', day) as pos from e)
select a.user_id, a.pos, case when a.v > 0 and b.v > 0 then round(b.v / a.v - 1, 9) end as change from p a left join p b on a.user_id = b.user_id and b.pos = a.pos + 3""")
def forward_change(spark, d):
    """Change over the next three days."""
    p = _daily(spark, d).select("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("pos"), "v")
    return sessions.forward_change(p, "user_id", "pos", "v", 3).withColumn("change", F.round("change", 9))


@query(f"""
with {_DAILY}, r as (select *, abs(v / nullif(lag(v) over w, 0) - 1) as m from e window w as (partition by user_id order by day)),
t as (select *, avg(m) over (partition by user_id order by day rows between 5 preceding and 1 preceding) as before from r)
select user_id, day, round(m / nullif(before, 0), 9) as relative from t""")
def relative_move(spark, d):
    """Size of a move against the mean size of the five before."""
    w = Window.partitionBy("user_id").orderBy("day")
    r = _daily(spark, d).withColumn("m", F.abs(F.try_divide(F.col("v"), F.nullif(F.lag("v").over(w), F.lit(0.0))) - 1))
    before = F.avg("m").over(w.rowsBetween(-5, -1))
    return r.select("user_id", "day", F.round(F.try_divide(F.col("m"), F.nullif(before, F.lit(0.0))), 9).alias("relative"))


@query(f"""
with {_DAILY}, c as (select a.day, b.user_id, max(b.v) as top from (select distinct day from e) a join e b on b.day between a.day - 6 and a.day group by 1, 2),
r as (select *, row_number() over (partition by day order by top desc, user_id) rn from c)
select day, user_id, round(top, 9) as top, rn as rank from r where rn <= 3""")
def top_of_trailing_week(spark, d):
    """Three users a day by their greatest value of the last seven days. Each value is carried to the seven days it counts for."""
    e = _daily(spark, d)
    carried = e.select("user_id", F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"), "v")
    c = carried.groupBy("day", "user_id").agg(F.max("v").alias("top")).join(broadcast_if_small(e.select("day").distinct()), "day", "left_semi")
    top = sq.top_per_group(c, ["day"], [F.col("top").desc(), F.col("user_id")], 3)
    return top.select("day", "user_id", F.round("top", 9).alias("top"), F.col("rank").cast("long").alias("rank"))


@query(f"""
with {_DAILY}, c as (select distinct day from e), u as (select user_id, min(day) a, max(day) b, count(*) n from e group by 1)
select u.user_id, u.a as first_day, u.b as last_day, u.n as n_days, (select count(*) from c where c.day between u.a and u.b) - u.n as n_holes from u""")
def interior_holes(spark, d):
    """Days of the calendar missing between a user's first and last."""
    e = _daily(spark, d)
    days = sq.dense_index(e.select("day"), "day", "p")
    u = e.join(F.broadcast(days), "day").groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"), (F.max("p") - F.min("p") + 1).alias("w"))
    return u.select("user_id", "first_day", "last_day", "n_days", (F.col("w") - F.col("n_days")).alias("n_holes"))


@query(f"""
with {_X}, e as (select cik, period_end, value, filed, row_number() over (partition by cik, period_end order by filed, accession_number, fact_id) rn from x
   where concept = 'EarningsPerShareDiluted' and value is not null and period_end is not null),
p as (select cik, period_end, value, filed from e where rn = 1),
j as (select a.cik, a.period_end, a.value, b.period_end as prior_end, b.value as prior_value,
        row_number() over (partition by a.cik, a.period_end order by abs(date_diff('day', b.period_end, a.period_end) - 365), b.period_end) rn
      from p a join p b on a.cik = b.cik and date_diff('day', b.period_end, a.period_end) between 335 and 395)
select cik, period_end, prior_end, round(value - prior_value, 6) as difference from j where rn = 1""")
def seasonal_difference(spark, d):
    """First-filed value of each period against that of the period nearest to a year before; the earlier of equals."""
    x = facts(spark, d).where("concept = 'EarningsPerShareDiluted' and value is not null and period_end is not null")
    p = x.groupBy("cik", "period_end").agg(F.min(F.struct("filed", "accession_number", "fact_id", "value"))["value"].alias("value"))
    ids = p.select("cik", "period_end", F.date_format("period_end", "yyyy-MM-dd").alias("tie"))
    pairs = partner_near(ids, keys=["cik"], day="period_end", tie="tie", least=335, most=395, ideal=365).select("cik", "period_end", F.to_date("partner").alias("prior_end"))
    prior = p.select("cik", F.col("period_end").alias("prior_end"), F.col("value").alias("_before"))
    joined = pairs.join(p, ["cik", "period_end"]).join(prior, ["cik", "prior_end"])
    return joined.select("cik", "period_end", "prior_end", F.round(F.col("value") - F.col("_before"), 6).alias("difference"))


@query("""
with p as (select distinct accession_number, section_type, position, word_count, text is null as missing from paragraph_occurrences)
select accession_number, count(*) as n, round(avg(case when section_type = 'MDA' then word_count end), 6) as mda_words, round(avg(case when section_type = 'RISK_FACTORS' then word_count end), 6) as risk_words,
 count(case when section_type = 'MDA' then 1 end) as n_mda, round(avg(case when missing then 1.0 else 0.0 end), 6) as missing_share from p group by 1""")
def section_measures(spark, d):
    """Means and counts by section in one pass over a filing's paragraphs; a mean without paragraphs is null, a count 0."""
    p = table(spark, d, "paragraph_occurrences").select("accession_number", "section_type", "position", "word_count", F.col("text").isNull().alias("missing")).distinct()
    of = lambda s: F.round(F.avg(F.when(F.col("section_type") == s, F.col("word_count"))), 6)
    return p.groupBy("accession_number").agg(
        F.count("*").alias("n"), of("MDA").alias("mda_words"), of("RISK_FACTORS").alias("risk_words"), F.count_if(F.col("section_type") == "MDA").alias("n_mda"),
        F.round(F.avg(F.col("missing").cast("int")), 6).alias("missing_share"),
    )


@query(f"""
with {_F}, c as (select cik, form, count(*) n from f group by 1, 2), r as (select *, row_number() over (partition by cik order by n desc, form) rn from c),
m as (select cik, median(date_diff('day', report_date, filing_date)) as lag, count(*) as n, count(case when report_date is null then 1 end) as undated from f group by 1)
select m.cik, m.n as n_filings, r.form as most_frequent_form, round(m.lag, 4) as median_lag, m.undated as n_undated from m join r on r.cik = m.cik and r.rn = 1""")
def filer_rollup(spark, d):
    """Per filer: filings, most frequent form (ties by name), median days from report to filing, filings without a report date."""
    f = filings(spark, d).withColumn("lag", F.datediff("filing_date", "report_date"))
    forms = f.groupBy("cik", "form").agg(F.count("*").alias("n")).groupBy("cik").agg(F.min(F.struct((-F.col("n")).alias("m"), "form"))["form"].alias("most_frequent_form"))
    lags = f.groupBy("cik", "lag").agg(F.count("*").alias("k"), F.count_if(F.col("report_date").isNull()).alias("u"))
    per = lags.groupBy("cik").agg(F.sum("k").alias("n_filings"), F.round(F.percentile("lag", 0.5, F.col("k")), 4).alias("median_lag"), F.sum("u").alias("n_undated"))
    return per.join(forms, "cik").select("cik", "n_filings", "most_frequent_form", "median_lag", "n_undated")


@query(f"""
with {_F}, q as (select distinct cik, year(filing_date) * 4 + quarter(filing_date) - 1 as q from f where filing_date is not null)
select a.cik, a.q, count(b.q) as n_covered from q a left join q b on b.cik = a.cik and b.q between a.q - 8 and a.q - 1 group by 1, 2""")
def covered_quarters(spark, d):
    """Quarters with a filing among the eight before."""
    q = filings(spark, d).where("filing_date is not null").select("cik", fo.quarter_index(F.col("filing_date")).alias("q")).distinct()
    return q.withColumn("n_covered", F.count("*").over(Window.partitionBy("cik").orderBy("q").rangeBetween(-8, -1)))


@query(f"""
with {_X}, q as (select distinct cik as e, concept as c, year(period_end) * 4 + quarter(period_end) - 1 as q from x where period_end is not null),
s as (select e, min(q) lo, max(q) hi, max(q) - min(q) + 1 as target from q group by e), fam as (select distinct family, concept as c, preference from concept_families),
t as (select q.e, fam.family, q.c, min(fam.preference) p, list_sort(list(distinct q.q)) qs, count(distinct q.q) n, max(q.q) last from q join fam using (c) group by 1, 2, 3),
u as (select q.e, fam.family, count(distinct q.q) u from q join fam using (c) group by 1, 2),
k as (select t.*, s.target, n / s.target >= 0.75 as at_bar, last >= s.hi - 2 as alive, lag(last) over w as before, row_number() over w as rn, row_number() over (partition by t.e, family order by last desc, c desc) as newest from t join s on s.e = t.e window w as (partition by t.e, family order by last, c)),
g as (select e, family, count(*) as k, count(case when at_bar and alive then 1 end) as n_live, count(case when at_bar then 1 end) as n_bars, sum(n) as total, count(case when alive then 1 end) as n_alive, bool_or(newest = 1 and alive) as newest_alive, max(target) as target,
  min(case when at_bar and alive then lpad(p::varchar, 9, '0') || c end) as best, list(list_min(list_filter(qs, lambda y: y > before)) order by rn) filter (where rn > 1) as switches from k group by e, family),
z as (select g.*, u.u, k >= 2 and u.u / target >= 0.75 as together, total - u.u as overlap from g join u using (e, family)),
y as (select *, together and newest_alive and (overlap <= 1 or n_alive = 1) as migrated from z),
f as (select e, family, case when n_live > 0 and n_bars = 1 then 'SINGLE' when n_live > 0 then 'DOMINANT' when together and not newest_alive then 'PARTIAL' when migrated then 'MIGRATION' when together then 'OVERLAP' else 'PARTIAL' end as state,
  substr(best, 10) as winner, round(u / target, 6) as coverage, case when n_live = 0 and migrated then switches end as switch_quarters from y)
select s.e as cik, m.family, coalesce(f.state, 'ABSENT') as state, f.winner, coalesce(f.coverage, 0.0) as coverage, f.switch_quarters from s cross join (select distinct family from fam) m left join f on f.e = s.e and f.family = m.family""")
def family_states(spark, d):
    """State of each family of concepts per entity: single, dominant, migrated, overlapping, partial or absent."""
    fam = table(spark, d, "concept_families").select("family", "concept", "preference").distinct()
    x = facts(spark, d).where("period_end is not null").select("cik", "concept", fo.quarter_index(F.col("period_end")).alias("q"))
    return classify(x, fam, entity="cik", concept="concept", quarter="q")


@query(f"""
with {_X} select form, count(*) as n, round(avg(case when value is not null then 1.0 else 0 end), 6) as value_share, round(avg(case when unit is not null then 1.0 else 0 end), 6) as unit_share,
 round(avg(case when period_start is not null then 1.0 else 0 end), 6) as start_share, round(avg(case when fy is not null then 1.0 else 0 end), 6) as fy_share from x group by form""")
def availability(spark, d):
    """Share of known values by column and form."""
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return facts(spark, d).groupBy("form").agg(
        F.count("*").alias("n"), share("value").alias("value_share"), share("unit").alias("unit_share"), share("period_start").alias("start_share"), share("fy").alias("fy_share")
    )


@query(f"""
with {_ANSWER},
i as (select chunk_id, prediction_id, reason is not null as failed, case when json_type(j, '$.red_flags') = 'ARRAY' then json_extract(j, '$.red_flags[*]') else [] end as items from answers),
g as (select chunk_id, prediction_id, failed, list_sort(list_distinct(list_transform(list_filter(items, lambda x: json_type(x) = 'OBJECT'), lambda x: struct_pack(category := x->>'$.category', modality := x->>'$.modality')))) as flags from i),
h as (select *, list_sort(list_distinct(list_filter(list_transform(flags, lambda x: x.category), lambda x: x is not null))) as categories from g),
p as (select not (a.failed or b.failed) as ok, a.flags as fa, b.flags as fb, a.categories as ca, b.categories as cb from h a join h b on a.chunk_id = b.chunk_id and a.prediction_id < b.prediction_id)
select count(*) as n_pairs, count(case when not ok then 1 end) as n_failed, count(case when ok and ca = cb then 1 end) as n_same_categories, count(case when ok and fa = fb then 1 end) as n_same_flags,
 round(sum(len(list_intersect(ca, cb))) / nullif(sum(len(list_distinct(list_concat(ca, cb)))), 0), 6) as category_jaccard,
 round(sum(len(list_intersect(fa, fb))) / nullif(sum(len(list_distinct(list_concat(fa, fb)))), 0), 6) as flag_jaccard from p""")
def flag_set_scores(spark, d):
    """Agreement of the flags of all answers about one chunk, by category and by (category, modality).

    An answer is paired with the later ones of its chunk, of which there are
    few. A pair with an answer that could not be read is a mismatch, even if the
    other has no flags; in the Jaccard index such an answer has none.
    """
    p = table(spark, d, "predictions").select("prediction_id", "chunk_id", "raw_output").distinct()
    g = p.select("chunk_id", "prediction_id", read_answer(F.col("raw_output")).alias("r")).select("chunk_id", "prediction_id", F.col("r.reason").isNotNull().alias("failed"), "r.categories", "r.flags")
    b = g.select("chunk_id", *(F.col(c).alias(f"_{c}") for c in ("prediction_id", "failed", "categories", "flags")))
    m = g.join(b, "chunk_id").where("prediction_id < _prediction_id")
    read = ~(F.col("failed") | F.col("_failed"))

    def index(c: str) -> Column:
        return F.round(F.try_divide(F.sum(F.size(F.array_intersect(c, f"_{c}"))), F.sum(F.size(F.array_union(c, f"_{c}")))), 6)

    return m.agg(
        F.count("*").alias("n_pairs"), F.count_if(~read).alias("n_failed"),
        F.count_if(read & (F.col("categories") == F.col("_categories"))).alias("n_same_categories"), F.count_if(read & F.col("flags").eqNullSafe(F.col("_flags"))).alias("n_same_flags"),
        index("categories").alias("category_jaccard"), index("flags").alias("flag_jaccard"),
    )


@query("""
with l as (select distinct doc_id, abusive, reviewer, labelled_at from review_labels), r as (select *, row_number() over (partition by doc_id order by labelled_at, reviewer) rn from l)
select a.abusive as old, b.abusive as new, count(*) as n from r a join r b on a.doc_id = b.doc_id and a.rn = 1 and b.rn = 2 group by 1, 2""")
def label_shift(spark, d):
    """First against second label of a document."""
    l = table(spark, d, "review_labels").select("doc_id", "abusive", "reviewer", "labelled_at").distinct()  # noqa: E741
    r = sq.top_per_group(l, ["doc_id"], [F.col("labelled_at"), F.col("reviewer")], 2)
    both = r.groupBy("doc_id").agg(F.max(F.when(F.col("rank") == 1, F.col("abusive"))).alias("old"), F.max(F.when(F.col("rank") == 2, F.col("abusive"))).alias("new"), F.count("*").alias("k"))
    return both.where("k = 2").groupBy("old", "new").agg(F.count("*").alias("n"))


@query(f"""
with {_F}, i as (select accession_number, row_number() over (order by filing_date nulls first, cik, accession_number) - 1 as "index" from f)
select accession_number, "index", floor("index" / 250)::bigint as shard from i""")
def contiguous_shards(spark, d):
    """Filings in one total order, in shards of 250."""
    i = row_index(filings(spark, d).select("accession_number", "cik", "filing_date"), [F.col("filing_date").asc_nulls_first(), F.col("cik"), F.col("accession_number")])
    return i.select("accession_number", "index", F.floor(F.col("index") / 250).alias("shard"))


@query(f"""
with {_PARA}, m as (select distinct accession_number, split from split_manifest), s as (select o.id, string_agg(distinct m.split, '+' order by m.split) as splits from o join m on m.accession_number = o.a group by 1)
select splits, count(*) as n from s group by 1""")
def paragraphs_across_splits(spark, d):
    """Paragraphs by the set of splits that they occur in."""
    m = table(spark, d, "split_manifest").distinct()
    s = _occurrences(spark, d).join(m, "accession_number").groupBy("paragraph_id").agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"))
    return s.groupBy("splits").agg(F.count("*").alias("n"))


@query(_COMPONENTS + """select accession_number, component,
 case when ('0x' || substr(sha256('split-1|' || component), 1, 16))::ubigint::double / 18446744073709551616.0 < 0.15 then 'eval' else 'train' end as split from c""")
def split_by_component(spark, d):
    """Filings split so that connected ones, through shared paragraphs, stay together: 15 % of the components to evaluation, by a hash."""
    c = graph.components(_occurrences(spark, d), "accession_number", "paragraph_id")
    return c.select("accession_number", "component", F.when(graph.hash_uniform(F.lit("split-1"), F.col("component")) < 0.15, "eval").otherwise("train").alias("split"))


@query("""
with d as (select distinct doc_id, source from documents), t as (select coalesce(source, '?') s, count(*) * 2 // 10 as want from d group by 1),
r as (select doc_id, coalesce(source, '?') s, row_number() over (partition by coalesce(source, '?') order by sha256('seed-2|' || doc_id), doc_id) k from d)
select r.doc_id, r.s as source from r join t on t.s = r.s where r.k <= t.want""")
def matched_composition(spark, d):
    """A sample with a fifth of the documents of every source."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source")).distinct()
    want = docs.groupBy("source").agg(F.floor(F.count("*") * 2 / 10).alias("want"))
    draw = docs.withColumn("h", F.sha2(F.concat_ws("|", F.lit("seed-2"), F.col("doc_id").cast("string")), 256))
    placed = position_in_group(draw, ["source"], [F.col("h"), F.col("doc_id")])
    return placed.join(broadcast_if_small(want), "source").where("position < want").select("doc_id", "source")


@query("""
with t as (select distinct doc_id, text from documents where length(text) > 0)
select doc_id, round(length(regexp_replace(text, '\\P{L}', '', 'g')) / nullif(length(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')), 0), 6) as letters,
 round((length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\x{fffd}]', '', 'g'))) / length(text), 6) as controls from t""")
def text_quality(spark, d):
    t = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text").distinct()
    return t.select("doc_id", F.round(tx.letter_share(F.col("text")), 6).alias("letters"), F.round(tx.control_share(F.col("text")), 6).alias("controls"))


@query(f"""
with k as (select distinct cik, accn, instant, val from float_facts where instant is not null and val is not null),
g as (select accn, instant, val, count(distinct cik) n, min(cik) first_cik from k group by 1, 2, 3 having count(distinct cik) > 1)
select k.cik, k.accn, k.instant from k join g on k.accn is not distinct from g.accn and k.instant = g.instant and k.val = g.val where k.cik <> g.first_cik""")
def shared_fact_blocklist(spark, d):
    """Facts that several entities report through one filing, for all but the first of them."""
    k = table(spark, d, "float_facts").where("instant is not null and val is not null").select("cik", "accn", "instant", "val").distinct()
    g = k.groupBy("accn", "instant", "val").agg(F.count_distinct("cik").alias("n"), F.min("cik").alias("first_cik")).where("n > 1").withColumnsRenamed({"accn": "_a", "instant": "_i", "val": "_v"})
    same = k["accn"].eqNullSafe(g["_a"]) & (k["instant"] == g["_i"]) & (k["val"] == g["_v"])
    return k.join(g, same).where("cik <> first_cik").select("cik", "accn", "instant")


@query("""
with k as (select distinct cik, instant, filed, val from float_facts where instant is not null and filed is not null),
r as (select *, rank() over (partition by cik order by instant desc, filed desc) rn from k)
select cik, max(instant) as instant, bool_and(val = 0) as is_zero, count(*) as n from r where rn = 1 group by cik""")
def newest_is_zero(spark, d):
    """Whether the newest fact is zero; disclosures of one day that differ are not."""
    k = table(spark, d, "float_facts").where("instant is not null and filed is not null").select("cik", "instant", "filed", "val").distinct()
    per = k.groupBy("cik", "instant", "filed").agg(F.bool_and(F.col("val") == 0).alias("is_zero"), F.count("*").alias("n"))
    best = per.groupBy("cik").agg(F.max(F.struct("instant", "filed", "is_zero", "n")).alias("r"))
    return best.select("cik", "r.instant", "r.is_zero", "r.n")


@query(f"""
with {_F}, o as (select *, case when date_diff('day', lag(filing_date) over (partition by cik order by filing_date), filing_date) > 5 then 1 else 0 end s from f where filing_date is not null),
g as (select *, sum(s) over (partition by cik order by filing_date range unbounded preceding) c from o),
z as (select cik, c, count(*) n, string_agg(distinct form, '+' order by form) forms from g group by 1, 2)
select n as cluster_size, forms, count(*) as n_clusters from z group by 1, 2""")
def cluster_sizes(spark, d):
    """Clusters of filing days by size and forms."""
    f = filings(spark, d).where("filing_date is not null")
    z = f.join(sq.gap_clusters(f, "cik", "filing_date", 5), ["cik", "filing_date"]).groupBy("cik", "cluster").agg(
        F.count("*").alias("cluster_size"), F.array_join(F.array_sort(F.collect_set("form")), "+").alias("forms")
    )
    return z.groupBy("cluster_size", "forms").agg(F.count("*").alias("n_clusters"))


@query("""
with t as (select distinct accession_number a, ticker k from filings where ticker is not null), p as (select distinct accession_number a, section_type s, position, text from paragraph_occurrences where text is not null)
select p.a as accession_number, p.s as section_type, count(*) as n, count(case when contains(lower(p.text), lower(t.k)) then 1 end) as n_self from p join t using (a) group by 1, 2""")
def self_mentions(spark, d):
    """Paragraphs that name their own ticker, by section."""
    t = table(spark, d, "filings").where("ticker is not null").select("accession_number", "ticker").distinct()
    p = table(spark, d, "paragraph_occurrences").where("text is not null").select("accession_number", "section_type", "position", "text").distinct()
    j = p.join(t, "accession_number")
    return j.groupBy("accession_number", "section_type").agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("text"), F.lower("ticker"))).alias("n_self"))


@query("""
with e as (select user_id, event_id, ts, event_type, value, row_number() over (partition by user_id order by event_id desc) rn, count(*) over (partition by user_id) n from events)
select user_id, event_id, event_type, round(value, 6) as value, n as n_events from e where rn = 1""")
def last_event_of_stream(spark, d):
    """Events processed as a stream into a journal that can be resumed; the journal replayed to the last event of each user."""
    folder = shared_folder(spark, "events")
    schema = table(spark, d, "events").schema
    step = lambda df: df.select("user_id", "event_id", "event_type", "value")
    journal.process_stream(spark, f"{d}/events.parquet*", schema, f"{folder}/journal", f"{folder}/state", step, ["event_id"])
    rows = journal.read_journal(spark, f"{folder}/journal", "user_id long, event_id long, event_type string, value double")
    last = journal.replay(rows, ["user_id"], ["event_id"])
    n = rows.groupBy("user_id").agg(F.count("*").alias("n_events"))
    out = checkpointed(last.join(n, "user_id").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), "n_events"))
    drop_folder(spark, folder)
    return out


@query(f"""
with {_X}, e as (select cik, period_end, value, filed, row_number() over (partition by cik, period_end order by filed, accession_number, fact_id) rn from x
   where concept = 'EarningsPerShareDiluted' and value is not null and period_end is not null),
p as (select cik, period_end, value from e where rn = 1),
w as (select *, avg(value) over b as m, stddev_samp(value) over b as s, count(value) over b as k from p window b as (partition by cik order by period_end rows between 8 preceding and 1 preceding))
select cik, period_end, case when k >= 3 and s > 1e-9 then round((value - m) / s, 6) end as surprise, k as n_prior from w""")
def standardised_surprise(spark, d):
    """Each first-filed value against the mean and deviation of the up to eight periods before; null under three."""
    x = facts(spark, d).where("concept = 'EarningsPerShareDiluted' and value is not null and period_end is not null")
    p = x.groupBy("cik", "period_end").agg(F.min(F.struct("filed", "accession_number", "fact_id", "value"))["value"].alias("value"))
    w = Window.partitionBy("cik").orderBy("period_end").rowsBetween(-8, -1)
    m, s, k = F.avg("value").over(w), F.stddev_samp("value").over(w), F.count("value").over(w)
    return p.select("cik", "period_end", F.when((k >= 3) & (s > 1e-9), F.round((F.col("value") - m) / s, 6)).alias("surprise"), k.alias("n_prior"))


@query()
def slope_with_wild_bootstrap(spark, d):
    """Slope of an order's value on its quantity, with a p-value that respects clusters of customers."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    r = inference.wild_cluster_p(o.join(q, "id"), "q", "o_totalprice", "o_custkey", draws=499)
    return spark.createDataFrame([(r["slope"], r["p"], r["n_clusters"])], "slope double, p double, n_clusters long")


@query()
def logistic_coefficients(spark, d):
    """Odds of an urgent order by its value and month."""
    o = table(spark, d, "orders").select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("x"), F.month("o_orderdate").alias("m"))
    beta = inference.logistic_l2(o, ["x", "m"], "y")
    return spark.createDataFrame([(n, float(b)) for n, b in zip(["intercept", "x", "m"], beta)], "term string, coefficient double")

