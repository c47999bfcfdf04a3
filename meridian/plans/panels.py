"""Queries of assembled panels, states of facts, call tables, censuses and suites of checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import scalar as sc
from meridian.operators import folds as fo
from meridian.operators import boosting, graph, inference, panel, quality
from meridian.operators import sequence as sq
from meridian.operators import text as tx
from meridian.operators.answers import read_answer
from meridian.operators.order import midrank, position_in_group, row_index, value_ranks
from meridian.plans import reference
from meridian.plans.reference import _ANSWER, _DAILY, _F, _FOLDS, _X, _daily, _fold_rows, _occurrences, facts, filings, rank_ic_by_period
from meridian.session import broadcast_if_small, checkpointed, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
RANK_IC = reference.SQL["rank_ic_by_period"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- assembled features --------------------------------------------------------------

_BLOCKS = f"""{_F}, {_X},
p as (select distinct accession_number, section_type, position, word_count from paragraph_occurrences),
tb as (select accession_number, count(*) as n_paragraphs, count(distinct section_type) as n_sections, round(avg(word_count), 6) as mean_words from p group by accession_number),
nb as (select accession_number, count(*) as n_facts, count(case when value is null then 1 end) as n_null_values from x where accession_number is not null group by accession_number),
nx as (select accession_number, lead(filing_date) over (partition by cik order by filing_date, accession_number) as next_day from f),
tg as (select accession_number, date_diff('day', f.filing_date, next_day) as days_to_next from f join nx using (accession_number))"""


def _blocks(spark, d):
    p = table(spark, d, "paragraph_occurrences").select("accession_number", "section_type", "position", "word_count").distinct()
    text = p.groupBy("accession_number").agg(F.count("*").alias("n_paragraphs"), F.count_distinct("section_type").alias("n_sections"), F.round(F.avg("word_count"), 6).alias("mean_words"))
    x = facts(spark, d).where("accession_number is not null")
    numeric = x.groupBy("accession_number").agg(F.count("*").alias("n_facts"), F.count_if(F.col("value").isNull()).alias("n_null_values"))
    f = filings(spark, d)
    # the next filing is one of the same day, or of the next day with one: a window over the days, which the calendar bounds
    days = f.where("filing_date is not null").groupBy("cik", "filing_date").agg(F.max("accession_number").alias("_last"))
    days = days.withColumn("_next", F.lead("filing_date").over(Window.partitionBy("cik").orderBy("filing_date")))
    wait = F.when(F.col("accession_number") < F.col("_last"), 0).otherwise(F.date_diff("_next", "filing_date"))
    target = f.select("accession_number", "cik", "filing_date").join(days, ["cik", "filing_date"], "left").select("accession_number", wait.cast("long").alias("days_to_next"))
    return f.select("accession_number", "cik", "filing_date"), text, numeric, target


@query(f"""
with {_BLOCKS} select f.accession_number, f.cik, f.filing_date, coalesce(n_paragraphs, 0) as n_paragraphs, coalesce(n_sections, 0) as n_sections, mean_words,
 coalesce(n_facts, 0) as n_facts, coalesce(n_null_values, 0) as n_null_values, tb.accession_number is not null as has_text, nb.accession_number is not null as has_numeric, days_to_next, true as has_target
from f left join tb using (accession_number) left join nb using (accession_number) left join tg using (accession_number)""")
def feature_table(spark, d):
    """Every filing with its text and numeric blocks and its target: counts are 0 without a block, means stay null."""
    base, text, numeric, target = _blocks(spark, d)
    return panel.assembled(base, {"text": text, "numeric": numeric, "target": target}, ["accession_number"], ("n_paragraphs", "n_sections", "n_facts", "n_null_values"))


@query(f"""
with {_BLOCKS} select f.accession_number, n_paragraphs, mean_words, n_facts, days_to_next from f join tb using (accession_number) join nb using (accession_number) join tg using (accession_number) where days_to_next is not null""")
def complete_features(spark, d):
    """Filings with a text block, a numeric block and a target."""
    base, text, numeric, target = _blocks(spark, d)
    whole, _ = panel.complete_rows(base.join(target, "accession_number"), {"text": text, "numeric": numeric}, ["accession_number"], "days_to_next")
    return whole.select("accession_number", "n_paragraphs", "mean_words", "n_facts", "days_to_next")


@query(f"""
with {_BLOCKS} select count(*) as n_base, count(case when tb.accession_number is null then 1 end) as n_without_text, count(case when nb.accession_number is null then 1 end) as n_without_numeric,
 count(case when days_to_next is null then 1 end) as n_without_target from f left join tb using (accession_number) left join nb using (accession_number) left join tg using (accession_number)""")
def incomplete_features(spark, d):
    """How many filings lack each block, counted before any is dropped."""
    base, text, numeric, target = _blocks(spark, d)
    return panel.complete_rows(base.join(target, "accession_number"), {"text": text, "numeric": numeric}, ["accession_number"], "days_to_next")[1]


@query(f"""
with {_BLOCKS} select f.accession_number, n_facts, days_to_next from f join nb using (accession_number) join tg using (accession_number) where days_to_next is not null""")
def numeric_with_target(spark, d):
    """Numeric block and target without any text."""
    base, _, numeric, target = _blocks(spark, d)
    return base.select("accession_number").join(numeric, "accession_number").join(target.where("days_to_next is not null"), "accession_number").select("accession_number", "n_facts", "days_to_next")


@query(f"""
with {_F}, t as (select distinct accession_number from paragraph_occurrences where section_type = 'MDA' and text is not null),
m as (select accession_number, count(*) as n_mda, count(text) as n_text from (select distinct accession_number, position, text, section_type from paragraph_occurrences) where section_type = 'MDA' group by 1)
select form, count(*) as n_events, count(case when m.accession_number is null then 1 end) as n_row_missing, count(case when m.n_text < m.n_mda then 1 end) as n_value_null
from f left join m using (accession_number) group by form""")
def events_with_text(spark, d):
    """Filings by form: those without a row of text, and those with a row whose text is null, counted apart."""
    p = table(spark, d, "paragraph_occurrences").where("section_type = 'MDA'").select("accession_number", "position", "text").distinct()
    m = p.groupBy("accession_number").agg(F.count("*").alias("n_mda"), F.count("text").alias("n_text"))
    j = panel.assembled(filings(spark, d).select("accession_number", "form"), {"mda": m}, ["accession_number"])
    return j.groupBy("form").agg(F.count("*").alias("n_events"), F.count_if(~F.col("has_mda")).alias("n_row_missing"), F.count_if(F.col("n_text") < F.col("n_mda")).alias("n_value_null"))


@query(f"""
with {_X}, fam as (select distinct family, concept, preference from concept_families),
k as (select x.cik, fam.family, fam.preference, x.concept, x.period_end, x.filed, x.fact_id, x.value, row_number() over (partition by x.cik, fam.family, x.concept order by x.period_end desc, x.filed desc, x.fact_id desc) rn
      from x join fam using (concept) where x.filed <= date '2020-01-01' and x.period_end is not null and x.value is not null),
l as (select * from k where rn = 1), a as (select * from l where preference = 1),
n as (select *, row_number() over (partition by cik, family order by period_end desc, preference) r from l)
select n.cik, n.family, case when a.cik is null then 'partial' when date_diff('day', a.period_end, date '2020-01-01') <= 400 then 'resolved' else 'stale' end as state,
 a.concept, a.value, a.period_end as "end", case when a.cik is null or n.period_end > a.period_end then n.concept end as newer_concept, case when a.cik is null or n.period_end > a.period_end then n.value end as newer_value
from n left join a using (cik, family) where n.r = 1""")
def family_panel(spark, d):
    """What was known of each family of concepts on a day: resolved, stale or partial, and a newer fact under another name."""
    x = facts(spark, d).where("period_end is not null and value is not null").select("cik", "concept", "period_end", "filed", "fact_id", "value")
    fam = broadcast_if_small(table(spark, d, "concept_families").select("family", "concept", "preference").distinct())
    return panel.family_facts(x, fam, F.lit("2020-01-01").cast("date"), entity="cik", concept="concept", end="period_end", filed="filed", tie="fact_id", value="value", fresh_days=400)


@query(f"""
with r as (select distinct cik, family, state, severity from concept_resolution), u as (select distinct cik from universe_membership where cik is not null), fam as (select distinct family from concept_families)
select u.cik, fam.family, coalesce(min(r.severity), 'MISSING') as reason, count(r.cik) as n_rows from u cross join fam left join r on r.cik = u.cik and r.family = fam.family group by u.cik, fam.family""")
def resolution_reasons(spark, d):
    """The recorded reason of each (entity, family), MISSING where there is no row. The families are a small fixed table."""
    r = table(spark, d, "concept_resolution").select("cik", "family", "severity", "state").distinct()
    r = r.groupBy("cik", "family").agg(F.min("severity").alias("severity"), F.count("*").alias("n"))
    fam = [x["family"] for x in table(spark, d, "concept_families").select("family").distinct().orderBy("family").collect()]
    u = table(spark, d, "universe_membership").where("cik is not null").select("cik").distinct().select("cik", F.explode(F.array(*map(F.lit, fam))).alias("family"))
    return u.join(r, ["cik", "family"], "left").select("cik", "family", F.coalesce("severity", F.lit("MISSING")).alias("reason"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


@query("""
with u as (select cik, min(sector) as sector from universe_membership where sector is not null group by cik), r as (select distinct cik, family, severity from concept_resolution),
n as (select sector, count(*) as members from u group by sector),
b as (select u.sector, r.family, count(distinct r.cik) as n_blocked from r join u using (cik) where r.severity = 'UNRESOLVED' group by 1, 2)
select sector, family, n_blocked, members, round(n_blocked / members, 6) as share, n_blocked / members > 0.2 as is_blocker from b join n using (sector)""")
def sector_blockers(spark, d):
    """Share of a sector's members for which a family is not resolved; more than a fifth blocks."""
    u = table(spark, d, "universe_membership").where("sector is not null").groupBy("cik").agg(F.min("sector").alias("sector"))
    r = table(spark, d, "concept_resolution").where("severity = 'UNRESOLVED'").select("cik", "family").distinct()
    b = r.join(u, "cik").groupBy("sector", "family").agg(F.count("*").alias("n_blocked"))
    share = F.col("n_blocked") / F.col("members")
    return b.join(u.groupBy("sector").agg(F.count("*").alias("members")), "sector").select("sector", "family", "n_blocked", "members", F.round(share, 6).alias("share"), (share > 0.2).alias("is_blocker"))


@query(f"""
with {_F}, n as (select cik, min(ticker) as t from filings where ticker is not null group by cik), p as (select cik, min(ticker) as t from paragraph_occurrences where ticker is not null group by cik),
q as (select cik, min(ticker) as t from fundamental_facts where ticker is not null group by cik)
select c.cik, coalesce(n.t, q.t, p.t) as name, case when n.t is not null then 'filings' when q.t is not null then 'facts' when p.t is not null then 'paragraphs' end as found_in
from (select distinct cik from f where cik is not null) c left join n using (cik) left join q using (cik) left join p using (cik)""")
def known_names(spark, d):
    """Name of each entity from the first of three tables that has one."""
    def names(t, c):
        return table(spark, d, t).where("ticker is not null").groupBy("cik").agg(F.min("ticker").alias(c))

    j = filings(spark, d).where("cik is not null").select("cik").distinct()
    sources = {"filings": "filings", "facts": "fundamental_facts", "paragraphs": "paragraph_occurrences"}
    for n, t in sources.items():
        j = j.join(names(t, n), "cik", "left")
    return j.select("cik", F.coalesce(*sources).alias("name"), F.coalesce(*(F.when(F.col(n).isNotNull(), n) for n in sources)).alias("found_in"))


# --- passages and their sources --------------------------------------------------------

_PLAIN = r"lower(trim(regexp_replace({}, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')))"


@query(f"""
with c as (select distinct doc_id, accession_number a, section_type s, {_PLAIN.format('text')} as t from documents where accession_number is not null and text is not null),
p as (select distinct accession_number a, section_type s, position, {_PLAIN.format('text')} as n from paragraph_occurrences where text is not null)
select c.doc_id, count(*) as n_paragraphs, count(case when contains(c.t, p.n) then 1 end) as n_contained from c join p using (a, s) group by c.doc_id""")
def contained_paragraphs(spark, d):
    """Paragraphs of a document's filing and section that stand in the document literally."""
    docs = table(spark, d, "documents").where("accession_number is not null and text is not null").select("doc_id", "accession_number", "section_type", tx.normalised(F.col("text")).alias("t")).distinct()
    p = table(spark, d, "paragraph_occurrences").where("text is not null").select("accession_number", "section_type", "position", tx.normalised(F.col("text")).alias("n")).distinct()
    return docs.join(p, ["accession_number", "section_type"]).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if(panel.contained(F.col("n"), F.col("t"))).alias("n_contained"))


@query("""
with o as (select distinct t.paragraph_id, u.o.accession_number as a, u.o.cik as cik from canonical_paragraphs t, unnest(t.occurrences) as u(o))
select paragraph_id, count(distinct a) as n_filings, string_agg(distinct cik::varchar, ',' order by cik::varchar) as ciks from o group by paragraph_id""")
def paragraph_sources(spark, d):
    """Distinct filings and entities of each paragraph; an entity is listed once, however often it repeats a paragraph."""
    of = lambda f: F.array_compact(F.array_distinct(F.transform("occurrences", f)))
    ciks = F.array_sort(of(lambda o: o["cik"].cast("string")))
    # the list of a paragraph's occurrences is at hand in its row: nothing is gathered
    return table(spark, d, "canonical_paragraphs").select("paragraph_id", F.size(of(lambda o: o["accession_number"])).alias("n_filings"), F.array_join(ciks, ",").alias("ciks")).distinct()


@query("""
with o as (select distinct t.paragraph_id, t.home_cik, u.o.accession_number as a, u.o.cik as cik from canonical_paragraphs t, unnest(t.occurrences) as u(o))
select a as accession_number, count(distinct paragraph_id) as n_paragraphs, count(distinct case when cik = home_cik then paragraph_id end) as n_own, min(paragraph_id) as first_id from o group by a""")
def attributed_paragraphs(spark, d):
    """Paragraphs of each filing, and those attributed to its own entity: the ones first used by it."""
    c = table(spark, d, "canonical_paragraphs").select("paragraph_id", "home_cik", F.explode("occurrences").alias("o"))
    o = c.select("paragraph_id", "home_cik", "o.accession_number", "o.cik").groupBy("paragraph_id", "accession_number").agg(F.max((F.col("cik") == F.col("home_cik")).cast("int")).alias("own"))
    return o.groupBy("accession_number").agg(F.count("*").alias("n_paragraphs"), F.sum(F.coalesce("own", F.lit(0))).cast("long").alias("n_own"), F.min("paragraph_id").alias("first_id"))


@query(f"""
with {_F}, m as (select distinct accession_number, split from split_manifest)
select coalesce(m.split, 'none') as split, count(*) as n_rows, count(f.accession_number) as n_joined, count(*) - count(f.accession_number) as n_lost from m left join f using (accession_number) group by 1""")
def manifest_join(spark, d):
    """The frozen split joined to the filings; what finds no filing is counted, not dropped."""
    m = table(spark, d, "split_manifest").distinct().join(filings(spark, d).select("accession_number", F.lit(1).alias("hit")), "accession_number", "left")
    return m.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_joined"), F.count_if(F.col("hit").isNull()).alias("n_lost"))


@query(f"""
with {_F}, p as (select distinct primary_document, cik, filing_date, accession_number from filings where primary_document is not null),
k as (select *, row_number() over (partition by primary_document order by cik, filing_date, accession_number) rn from p) select primary_document, cik, accession_number from k where rn = 1""")
def fetch_targets(spark, d):
    """Each path once, with the first filing that names it."""
    p = table(spark, d, "filings").select("primary_document", "cik", "filing_date", "accession_number").distinct()
    return panel.first_of_path(p, "primary_document", [F.col("cik"), F.col("filing_date"), F.col("accession_number")]).select("primary_document", "cik", "accession_number")


# --- answers and labels ----------------------------------------------------------------


@query(f"""
with {_ANSWER}, i as (select prediction_id, reason, case when json_type(j, '$.red_flags') = 'ARRAY' then json_extract(j, '$.red_flags[*]') end as items from answers)
select case when reason is not null then 'unreadable' when items is null then 'missing' when len(items) = 0 then 'empty' when len(list_filter(items, lambda x: x->>'$.modality' = 'REALIZED')) > 0 then 'realized' else 'other' end as flags,
 count(distinct prediction_id) as n from i group by 1""")
def flag_presence(spark, d):
    """Answers by their flags: an empty list is an answer, a missing one is not; realized flags are told from others."""
    p = table(spark, d, "predictions").select("prediction_id", "raw_output").distinct().select("prediction_id", "raw_output", read_answer(F.col("raw_output")).alias("r"))
    fence = F.regexp_replace(F.btrim(F.regexp_replace("raw_output", r"^\s+|\s+$", ""), F.lit("`")), "^json", "")
    plain = F.when(F.startswith(F.regexp_replace("raw_output", r"^\s+", ""), F.lit("```")), fence).otherwise(F.col("raw_output"))
    listed = F.try_variant_get(F.try_parse_json(plain), "$.red_flags", "array<variant>")
    kind = (
        F.when(F.col("r.reason").isNotNull(), "unreadable").when(listed.isNull(), "missing").when(F.size(listed) == 0, "empty")
        .when(F.exists("r.flags", lambda x: x["modality"] == "REALIZED"), "realized").otherwise("other")
    )
    return p.groupBy(kind.alias("flags")).agg(F.count_distinct("prediction_id").alias("n"))


@query("""
with p as (select distinct prediction_id, finish_reason, prompt_tokens, generation_tokens, latency_s from predictions)
select coalesce(finish_reason, 'unknown') as finish_reason, count(*) as n, sum(prompt_tokens)::bigint as prompt_tokens, sum(generation_tokens)::bigint as generation_tokens, count(*) - count(generation_tokens) as n_uncounted, round(max(latency_s), 6) as longest
from p group by 1""")
def usage_sums(spark, d):
    """Tokens used by reason of finish; answers without a count are counted apart."""
    p = table(spark, d, "predictions").select("prediction_id", "finish_reason", "prompt_tokens", "generation_tokens", "latency_s").distinct()
    return p.groupBy(F.coalesce("finish_reason", F.lit("unknown")).alias("finish_reason")).agg(
        F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("generation_tokens").alias("generation_tokens"), F.count_if(F.col("generation_tokens").isNull()).alias("n_uncounted"), F.round(F.max("latency_s"), 6).alias("longest")
    )


@query("""
with l as (select distinct doc_id, abusive, category, reviewer, labelled_at from review_labels), d as (select distinct doc_id, source from documents),
t as (select doc_id, max(abusive) as truth, min(abusive) as agreed from l group by doc_id)
select coalesce(d.source, '?') as source, coalesce(l.reviewer, '?') as reviewer, count(case when t.truth = 1 then 1 end) as n_true, count(case when l.abusive = 1 then 1 end) as n_found, count(case when t.truth = 1 and l.abusive = 1 then 1 end) as n_both,
 round(count(case when t.truth = 1 and l.abusive = 1 then 1 end) / nullif(count(case when l.abusive = 1 then 1 end), 0), 6) as precision, round(count(case when t.truth = 1 and l.abusive = 1 then 1 end) / nullif(count(case when t.truth = 1 then 1 end), 0), 6) as recall,
 round(2.0 * count(case when t.truth = 1 and l.abusive = 1 then 1 end) / nullif(count(case when t.truth = 1 then 1 end) + count(case when l.abusive = 1 then 1 end), 0), 6) as f1
from l join d using (doc_id) join t using (doc_id) group by 1, 2""")
def reviewer_scores(spark, d):
    """Precision, recall and F1 of each reviewer by source against the union of all labels of a document."""
    l = table(spark, d, "review_labels").select("doc_id", "abusive", "category", "reviewer", "labelled_at").distinct()  # noqa: E741
    t = l.groupBy("doc_id").agg((F.max("abusive") == 1).alias("truth"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source")).distinct()
    j = l.join(docs, "doc_id").join(t, "doc_id")
    return j.groupBy("source", F.coalesce("reviewer", F.lit("?")).alias("reviewer")).agg(*panel.precision_recall(F.col("truth"), F.col("abusive") == 1))


@query("""
with l as (select distinct doc_id, abusive, category from review_labels)
select doc_id, to_json({'doc_id': doc_id, 'abusive': max(abusive), 'categories': list_sort(list_distinct(list(category) filter (category is not null)))})::varchar as target from l group by doc_id""")
def label_targets(spark, d):
    """One JSON target per labelled document, its fields in a fixed order."""
    l = table(spark, d, "review_labels").groupBy("doc_id").agg(F.max("abusive").alias("abusive"), F.array_sort(F.collect_set("category")).alias("categories"))  # noqa: E741
    empty = F.when(F.size("categories") > 0, F.col("categories"))
    return l.select("doc_id", F.to_json(F.struct("doc_id", "abusive", empty.alias("categories")), {"ignoreNullFields": "false"}).alias("target"))


@query("""
with l as (select distinct doc_id, coalesce(category, 'none') as label from review_labels)
select label, count(*) as n_documents, min(doc_id) as first_document, max(doc_id) as last_document from l group by label""")
def label_index(spark, d):
    """Documents that hold each label, each once."""
    l = table(spark, d, "review_labels").select("doc_id", F.coalesce("category", F.lit("none")).alias("label")).distinct()  # noqa: E741
    return l.groupBy("label").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"), F.max("doc_id").alias("last_document"))


# --- calls ---------------------------------------------------------------------------------

_CALLS = f"""{_FOLDS}, m as (select fold, g, avg(y) v from t group by 1, 2), a as (select fold, avg(y) v from t group by 1),
calls as (select r.q as fold, r.c as entity, r.id, coalesce(m.v, a.v) > a.v as called_up, r.y > a.v as was_up from r join a on a.fold = r.q left join m on m.fold = r.q and m.g = r.g)"""


def _calls(spark, d):
    rows = checkpointed(_fold_rows(spark, d).select("fold", "role", "id", "g", "c", "y"))
    train = rows.where("role = 'train'")
    a = train.groupBy("fold").agg(F.avg("y").alias("level"))
    p = fo.group_mean_prediction(rows, "g", "y", "id")
    test = rows.where("role = 'test'").select("fold", "id", F.col("c").alias("entity"), "y")
    return test.join(p, ["fold", "id"]).join(broadcast_if_small(a), "fold").select("fold", "entity", "id", (F.col("prediction") > F.col("level")).alias("called_up"), (F.col("y") > F.col("level")).alias("was_up"))


@query(f"""
{_CALLS}, p as (select entity, fold, count(*) as n, count(case when called_up = was_up then 1 end) as k from calls group by 1, 2)
select entity, sum(n)::bigint as n_calls, sum(k)::bigint as n_hits, case when sum(n) >= 6 then round(sum(k) / sum(n), 6) end as hit_rate, string_agg(fold || ':' || k || '/' || n, ' ' order by fold) as calls from p group by entity""")
def entity_calls(spark, d):
    """Hits and calls of each entity, fold by fold; the rate is withheld under six calls."""
    return panel.entity_table(_calls(spark, d), "entity", "fold", F.col("called_up") == F.col("was_up"), 6)


@query(f"""
{_CALLS}, s as (select fold, count(*) as n_calls, count(distinct entity) as n_entities, count(case when called_up = was_up then 1 end) as n_hits, count(case when called_up then 1 end) as n_up, avg(case when was_up then 1.0 else 0 end) as p from calls group by fold)
select fold, n_calls, n_entities, n_hits, round(n_hits / n_calls, 6) as hit_rate, round((n_up * p + (n_calls - n_up) * (1 - p)) / n_calls, 6) as chance_rate from s""")
def call_summary(spark, d):
    """Hit rate of each fold beside the rate that the same number of calls would reach by chance."""
    c = _calls(spark, d)
    s = c.groupBy("fold").agg(F.count("*").alias("n_calls"), F.count_distinct("entity").alias("n_entities"), F.count_if(F.col("called_up") == F.col("was_up")).alias("n_hits"), F.count_if("called_up").alias("n_up"), F.avg(F.col("was_up").cast("int")).alias("p"))
    chance = panel.chance_hits(F.col("n_up"), F.col("n_calls") - F.col("n_up"), F.col("p"))
    return s.select("fold", "n_calls", "n_entities", "n_hits", F.round(F.col("n_hits") / F.col("n_calls"), 6).alias("hit_rate"), F.round(chance / F.col("n_calls"), 6).alias("chance_rate"))


@query(f"""
{_CALLS}, s as (select fold, entity, avg(case when called_up = was_up then 1.0 else 0 end) as r from calls group by 1, 2), e as (select entity, avg(r) as mean, stddev_samp(r) as sd, count(*) as n from s group by entity)
select n as n_folds, count(*) as n_entities, round(avg(mean), 6) as mean_rate, round(avg(sd), 6) as mean_sd from e group by n""")
def rate_deltas(spark, d):
    """Mean and sample deviation over folds of each entity's rate, by the number of its folds."""
    s = _calls(spark, d).groupBy("fold", "entity").agg(F.avg((F.col("called_up") == F.col("was_up")).cast("int")).alias("r"))
    e = s.groupBy("entity").agg(F.avg("r").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("r")).alias("sd"), F.count("*").alias("n"))
    return e.groupBy(F.col("n").alias("n_folds")).agg(F.count("*").alias("n_entities"), F.round(F.avg("mean"), 6).alias("mean_rate"), F.round(F.avg("sd"), 6).alias("mean_sd"))


@query(f"""
with {_DAILY}, p as (select *, datediff('day', date '2024-01-01', day) as pos from e)
select a.pos, count(*) as n, round(avg(b.v / a.v - 1), 9) as mean_change from p a join p b on a.user_id = b.user_id and b.pos = a.pos + 3 where a.v > 0 and b.v > 0 group by a.pos""")
def forward_mean(spark, d):
    """Mean change over three sessions of all entities priced at both ends, the entity itself included."""
    p = _daily(spark, d).select("user_id", F.date_diff("day", F.lit("2024-01-01").cast("date")).alias("pos"), "v").where("v > 0")
    later = p.select("user_id", (F.col("pos") - 3).alias("pos"), F.col("v").alias("w"))
    return p.join(later, ["user_id", "pos"]).groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg(F.col("w") / F.col("v") - 1), 9).alias("mean_change"))


# --- events, calendars, names ---------------------------------------------------------------


@query(f"""
with {_F}, k as (select accession_number, cik, filing_date, case when regexp_replace(upper(trim(form)), '/A$', '') = '25' then 'delisting' when list_contains(list_transform(string_split(items, ','), lambda x: trim(x)), '1.03') then 'bankruptcy'
   when list_contains(list_transform(string_split(items, ','), lambda x: trim(x)), '2.05') then 'exit_cost' when list_contains(list_transform(string_split(items, ','), lambda x: trim(x)), '5.02') then 'departure' end as kind from f)
select accession_number, cik, kind from k where kind is not null""")
def dated_events(spark, d):
    """Filings that report an event, by form first, then by item."""
    kind = sc.event_kind(F.col("form"), F.col("items"), {"25": "delisting"}, {"1.03": "bankruptcy", "2.05": "exit_cost", "5.02": "departure"})
    return filings(spark, d).select("accession_number", "cik", kind.alias("kind")).where("kind is not null")


@query(SQL["dated_events"].replace("select accession_number, cik, kind from k where kind is not null", """,
e as (select * from k where kind is not null), c as (select cik, count(*) as n_facts from float_facts group by cik)
select kind, count(*) as n_events, count(distinct e.cik) as n_entities, count(case when c.cik is null then 1 end) as n_without_facts, min(filing_date) as first_day, max(filing_date) as last_day from e left join c using (cik) group by kind""").replace("from f)\n,", "from f),"))
def event_summary(spark, d):
    """Events by kind, and those of entities without any fact."""
    e = dated_events(spark, d).join(filings(spark, d).select("accession_number", "filing_date"), "accession_number")
    has = table(spark, d, "float_facts").where("cik is not null").select("cik").distinct().withColumn("hit", F.lit(1))
    return e.join(has, "cik", "left").groupBy("kind").agg(
        F.count("*").alias("n_events"), F.count_distinct("cik").alias("n_entities"), F.count_if(F.col("hit").isNull()).alias("n_without_facts"), F.min("filing_date").alias("first_day"), F.max("filing_date").alias("last_day")
    )


@query(f"""
with {_F}, b as (select cik, min(filing_date) lo, max(filing_date) hi from f where filing_date is not null group by cik),
q as (select cik, lo, hi, unnest(generate_series(date_trunc('quarter', lo)::timestamp, hi::timestamp, interval 3 month)) as s from b)
select cik, count(*) as n_quarters, min((s + interval 3 month)::date - 1) as first_end, max((s + interval 3 month)::date - 1) as last_end from q where (s + interval 3 month)::date - 1 between lo and hi group by cik""")
def reportable_quarters(spark, d):
    """Quarters that end between an entity's first and last filing."""
    b = filings(spark, d).where("filing_date is not null").groupBy("cik").agg(F.min("filing_date").alias("lo"), F.max("filing_date").alias("hi"))
    q = b.select("cik", F.explode(sc.quarter_ends(F.col("lo"), F.col("hi"))).alias("e"))
    return q.groupBy("cik").agg(F.count("*").alias("n_quarters"), F.min("e").alias("first_end"), F.max("e").alias("last_end"))


@query("""
with r as (select make_date(y::int, 6, 30) as day from generate_series(2012, 2021) as g(y)), s as (select distinct cik, member_from f, member_to t from universe_membership where member_from is not null)
select r.day, count(distinct s.cik) as n_members from r left join s on s.f <= r.day and (s.t is null or s.t > r.day) group by r.day""")
def reconstitution_members(spark, d):
    """Members on the yearly dates of reconstitution."""
    s = table(spark, d, "universe_membership").where("member_from is not null").select("cik", "member_from", "member_to").distinct()
    days = spark.range(1).select(F.explode(sc.yearly_dates(2012, 2021, 6, 30)).alias("day"))
    held = s.select("cik", "member_from", "member_to", F.explode(sc.yearly_dates(2012, 2021, 6, 30)).alias("day")).where("member_from <= day and (member_to is null or member_to > day)")
    n = held.groupBy("day").agg(F.count_distinct("cik").alias("n_members"))
    return days.join(n, "day", "left").select("day", F.coalesce("n_members", F.lit(0)).alias("n_members"))


@query(f"""
with t as (select cik, list_sort(list_distinct(list(ticker))) as ts from filings where ticker is not null group by cik), u as (select distinct ticker from filings where form = '10-K/A' and ticker is not null)
select cik, case when k.first not in (select ticker from u) then k.first end as ticker from (select cik, list_filter(ts, lambda x: not regexp_matches(x, '[-.](W|WS|WT|U|UN|R|RT|P[A-Z]?)$'))[1] as first from t) k""")
def common_tickers(spark, d):
    """An entity's first ticker that is a common share, unless a list of others vetoes it; the list never supplies one."""
    f = table(spark, d, "filings").where("ticker is not null")
    t = f.groupBy("cik").agg(F.array_sort(F.collect_set("ticker")).alias("ts"))
    first = t.select("cik", sc.common_ticker(F.col("ts"), F.array().cast("array<string>")).alias("ticker"))
    veto = f.where("form = '10-K/A'").select("ticker", F.lit(True).alias("veto")).distinct()
    return first.join(veto, "ticker", "left").select("cik", F.when(F.col("veto").isNull(), F.col("ticker")).alias("ticker"))


@query(f"""
with {_X}, v as (select distinct concept, value, coalesce(unit, '') as unit from x where value is not null and abs(value) >= 1000 and (unit is null or not contains(unit, '/')))
select concept, case when abs(value) >= 1e9 then 'bn' when abs(value) >= 1e6 then 'm' else 'k' end as suffix, count(*) as n from v group by 1, 2""")
def amount_suffixes(spark, d):
    """How often each suffix of a formatted amount is used."""
    v = facts(spark, d).where("value is not null and abs(value) >= 1000 and (unit is null or not contains(unit, '/'))").select("concept", "value", F.coalesce("unit", F.lit("")).alias("unit")).distinct()
    text = sc.amount_text(F.col("value"), F.col("unit"))
    return v.groupBy("concept", F.regexp_extract(text, "^[-0-9.,]+([a-z]+)", 1).alias("suffix")).agg(F.count("*").alias("n"))


# --- censuses and suites ----------------------------------------------------------------------


@query(f"""
with {_F} select year(filing_date) * 4 + quarter(filing_date) - 1 as q, count(*) as n, count(distinct cik) as n_entities, count(case when report_date is null then 1 end) as n_without_report, count(case when acceptance_datetime is null then 1 end) as n_without_time,
 count(case when date_diff('day', report_date, filing_date) > 120 then 1 end) as n_late from f where filing_date is not null group by 1""")
def quarter_census(spark, d):
    """Filings of each quarter and what they lack."""
    f = filings(spark, d).where("filing_date is not null")
    none = lambda c: F.count_if(F.col(c).isNull())
    return f.groupBy(fo.quarter_index(F.col("filing_date")).cast("long").alias("q")).agg(
        F.count("*").alias("n"), F.count_distinct("cik").alias("n_entities"), none("report_date").alias("n_without_report"), none("acceptance_datetime").alias("n_without_time"), F.count_if(F.date_diff("filing_date", "report_date") > 120).alias("n_late")
    )


@query("""
with p as (select distinct accession_number, section_type, position, text, word_count from paragraph_occurrences), s as (select section_type, accession_number, sum(word_count)::bigint as w, count(*) - count(text) as gone from p group by 1, 2)
select section_type, count(*) as n_sections, count(case when w is null or w <= 0 then 1 end) as n_degenerate, count(case when gone > 0 then 1 end) as n_with_null_text, max(w) as longest, min(w) as shortest from s group by section_type""")
def degenerate_sections(spark, d):
    """Sections without words, or with null texts."""
    p = table(spark, d, "paragraph_occurrences").select("accession_number", "section_type", "position", "text", "word_count").distinct()
    s = p.groupBy("section_type", "accession_number").agg(F.sum("word_count").alias("w"), F.count_if(F.col("text").isNull()).alias("gone"))
    return s.groupBy("section_type").agg(
        F.count("*").alias("n_sections"), F.count_if(F.col("w").isNull() | (F.col("w") <= 0)).alias("n_degenerate"), F.count_if(F.col("gone") > 0).alias("n_with_null_text"), F.max("w").alias("longest"), F.min("w").alias("shortest")
    )


@query("""
with m as (select distinct accession_number, split from split_manifest), o as (select distinct t.paragraph_id, m.split from canonical_paragraphs t, unnest(t.occurrences) as u(o) join m on m.accession_number = u.o.accession_number where m.split is not null),
p as (select paragraph_id, bool_or(split = 'train') as in_train, bool_or(split <> 'train') as in_other from o group by 1)
select count(*) as n_paragraphs, count(case when in_train and in_other then 1 end) as n_in_both, round(count(case when in_train and in_other then 1 end) / nullif(count(case when in_other then 1 end), 0), 6) as share_of_evaluation from p""")
def overlap_totals(spark, d):
    """Paragraphs that stand on both sides of the split, in all."""
    m = table(spark, d, "split_manifest").where("split is not null").distinct()
    o = _occurrences(spark, d).select("paragraph_id", "accession_number").join(m, "accession_number")
    p = o.groupBy("paragraph_id").agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split") != "train").alias("e"))
    both = F.count_if(F.col("t") & F.col("e"))
    return p.agg(F.count("*").alias("n_paragraphs"), both.alias("n_in_both"), F.round(F.try_divide(both, F.count_if("e")), 6).alias("share_of_evaluation"))


@query("""
with d as (select distinct doc_id, accession_number, lang from documents), m as (select distinct accession_number, split from split_manifest)
select coalesce(m.split, 'none') as split, count(*) as raw, count(case when d.lang is null or d.lang = 'en' then 1 end) as kept, count(case when d.lang is null then 1 end) as unknown from d left join m using (accession_number) group by 1""")
def evaluation_masks(spark, d):
    """Documents of each split, all and under a mask; an unknown value keeps its row."""
    docs = table(spark, d, "documents").select("doc_id", "accession_number", "lang").distinct().join(table(spark, d, "split_manifest").distinct(), "accession_number", "left")
    return docs.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("raw"), F.count_if(F.coalesce(F.col("lang") == "en", F.lit(True))).alias("kept"), F.count_if(F.col("lang").isNull()).alias("unknown"))


@query(f"""
with {_F}, z as (select distinct cik, member_to t from universe_membership where member_to is not null), l as (select cik, max(filing_date) as last_day from f group by cik)
select z.cik, z.t as exit_day, case when l.last_day is null then 'unscreenable' when l.last_day > z.t + 365 then 'filed_later' else 'ended' end as screen from z left join l using (cik)""")
def exit_screen(spark, d):
    """Whether an entity still filed a year after a spell's end; those without filings can't be screened and are kept."""
    z = table(spark, d, "universe_membership").where("member_to is not null").select("cik", F.col("member_to").alias("exit_day")).distinct()
    last = filings(spark, d).groupBy("cik").agg(F.max("filing_date").alias("last_day"))
    screen = F.when(F.col("last_day").isNull(), "unscreenable").when(F.col("last_day") > F.date_add("exit_day", 365), "filed_later").otherwise("ended")
    return z.join(last, "cik", "left").select("cik", "exit_day", screen.alias("screen"))


@query(f"""
with {_F}, q as (select distinct date_trunc('quarter', filing_date)::date as s from f where filing_date is not null), cut as (select max(filing_date) as m from f)
select s as quarter_start, ((s + interval 3 month)::date - 1 + interval 6 month)::date > m as is_censored from q, cut""")
def censored_quarters(spark, d):
    """Quarters whose outcome, two quarters on, closes after the last day that is known."""
    f = filings(spark, d)
    cut = f.agg(F.max("filing_date")).first()[0]
    end = F.date_sub(F.add_months("s", 3), 1)
    return f.where("filing_date is not null").select(F.trunc("filing_date", "quarter").alias("s")).distinct().select(F.col("s").alias("quarter_start"), (F.add_months(end, 6) > F.lit(cut)).alias("is_censored"))


@query(f"""
with {_X}, k as (select cik, concept, coalesce(period_start, date '0001-01-01') s, period_end e, count(distinct value) as n_values, min(filed) as a, max(filed) as b, count(*) as n from x where value is not null and period_end is not null group by 1, 2, 3, 4)
select concept, count(*) as n_periods, count(case when n > 1 then 1 end) as n_filed_again, count(case when n_values > 1 then 1 end) as n_revised, max(date_diff('day', a, b)) as longest_lag from k group by concept""")
def revisions(spark, d):
    """Periods that were filed again, and those whose value changed."""
    x = facts(spark, d).where("value is not null and period_end is not null")
    k = x.groupBy("cik", "concept", "period_start", "period_end").agg(F.count_distinct("value").alias("n_values"), F.min("filed").alias("a"), F.max("filed").alias("b"), F.count("*").alias("n"))
    return k.groupBy("concept").agg(F.count("*").alias("n_periods"), F.count_if(F.col("n") > 1).alias("n_filed_again"), F.count_if(F.col("n_values") > 1).alias("n_revised"), F.max(F.date_diff("b", "a")).cast("long").alias("longest_lag"))


@query(f"""
with {_X}, fam as (select distinct taxonomy, concept, family, preference from concept_families), k as (select distinct fact_id, cik, concept, form from fundamental_facts)
select fam.family, k.concept, count(*) as n, count(distinct cik) as n_entities from k join fam using (concept) where fam.preference > 1 and k.form in ('10-K', '10-Q') group by 1, 2""")
def supplemental_facts(spark, d):
    """Facts under the further names of a family, of periodic reports."""
    k = table(spark, d, "fundamental_facts").select("fact_id", "cik", "concept", "form").distinct().where(F.col("form").isin("10-K", "10-Q"))
    fam = table(spark, d, "concept_families").where("preference > 1").select("concept", "family").distinct()
    return k.join(broadcast_if_small(fam), "concept").groupBy("family", "concept").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("n_entities"))


@query(f"""
with {_X} select concept, count(*) as n, count(case when value is null then 1 end) as n_imputed, round(count(case when value is null then 1 end) / count(*), 6) as share from x group by concept""")
def imputed_share(spark, d):
    """Facts without a value of their own, which has to be read from the text."""
    x = facts(spark, d)
    none = F.count_if(F.col("value").isNull())
    return x.groupBy("concept").agg(F.count("*").alias("n"), none.alias("n_imputed"), F.round(none / F.count("*"), 6).alias("share"))


@query(f"""
with {_DAILY}, o as (select user_id, day, v, lag(day) over (partition by user_id order by day) as p from e), b as (select min(day) lo, max(day) hi from e),
u as (select user_id, min(day) a, max(day) z from e group by user_id)
select 'non_positive' as "check", 'FATAL' as severity, count(case when v <= 0 then 1 end) as n_bad from e
union all select 'gap', 'WARN', count(case when date_diff('day', p, day) > 5 then 1 end) from o
union all select 'late_start', 'WARN', count(case when a > lo + 5 then 1 end) from u, b
union all select 'early_end', 'WARN', count(case when z < hi - 5 then 1 end) from u, b
union all select 'jump', 'INFO', count(case when v > 20 * w then 1 end) from (select v, lag(v) over (partition by user_id order by day) as w from e)""")
def price_checks(spark, d):
    """A suite of checks of a daily series: values, gaps, late starts and early ends, jumps."""
    e = _daily(spark, d)
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    w = Window.partitionBy("user_id").orderBy("day")
    o = e.select("v", F.date_diff("day", F.lag("day").over(w)).alias("gap"), F.lag("v").over(w).alias("before"))
    u = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    return quality.report([
        quality.no_rows("non_positive", e, F.col("v") <= 0),
        quality.no_rows("gap", o, F.col("gap") > 5, "WARN"),
        quality.no_rows("late_start", u, F.col("a") > F.date_add(F.lit(lo), 5), "WARN"),
        quality.no_rows("early_end", u, F.col("z") < F.date_sub(F.lit(hi), 5), "WARN"),
        quality.no_rows("jump", o, F.col("v") > 20 * F.col("before"), "INFO"),
    ])


@query("""
with u as (select distinct cik, sector, stratum, member_from f, member_to t from universe_membership), v as (select *, coalesce(t, date '9999-12-31') as z from u where f is not null and (t is null or t > f)),
o as (select cik, f, max(z) over (partition by cik order by f, z rows between unbounded preceding and 1 preceding) as before from v)
select 'no_start' as "check", 'FATAL' as severity, count(case when f is null then 1 end) as n_bad from u
union all select 'inverted', 'FATAL', count(case when t <= f then 1 end) from u
union all select 'overlap', 'WARN', count(case when before > f then 1 end) from o
union all select 'several_open', 'WARN', count(*) from (select cik from v where t is null group by cik having count(*) > 1)
union all select 'several_sectors', 'WARN', count(*) from (select cik from u where sector is not null group by cik having count(distinct sector) > 1)
union all select 'no_filings', 'INFO', count(*) from (select distinct cik from u where cik is not null and cik not in (select cik from filings where cik is not null))""")
def universe_checks(spark, d):
    """A suite of checks of the spells of membership."""
    u = table(spark, d, "universe_membership").select("cik", "sector", "stratum", "member_from", "member_to").distinct()
    v = u.where("member_from is not null and (member_to is null or member_to > member_from)").withColumn("z", F.coalesce("member_to", F.lit("9999-12-31").cast("date")))
    days = v.groupBy("cik", "member_from").agg(F.max("z").alias("z"), F.count("*").alias("n"))  # a window per calendar day, not per spell
    w = Window.partitionBy("cik").orderBy("member_from").rowsBetween(Window.unboundedPreceding, -1)
    o = days.select("n", (F.max("z").over(w) > F.col("member_from")).alias("late"))
    overlaps = o.agg(F.coalesce(F.sum(F.col("n") - 1 + F.coalesce(F.col("late").cast("int"), F.lit(0))), F.lit(0)).alias("n_bad"))
    per = lambda rows, n, s: rows.agg(F.count("*").alias("n_bad")).select(F.lit(n).alias("check"), F.lit(s).alias("severity"), "n_bad")
    return quality.report([
        quality.no_rows("no_start", u, F.col("member_from").isNull()),
        quality.no_rows("inverted", u, F.col("member_to") <= F.col("member_from")),
        overlaps.select(F.lit("overlap").alias("check"), F.lit("WARN").alias("severity"), "n_bad"),
        per(v.where("member_to is null").groupBy("cik").count().where("count > 1"), "several_open", "WARN"),
        per(u.where("sector is not null").groupBy("cik").agg(F.count_distinct("sector").alias("k")).where("k > 1"), "several_sectors", "WARN"),
        per(u.where("cik is not null").select("cik").distinct().join(filings(spark, d).select("cik"), "cik", "left_anti"), "no_filings", "INFO"),
    ])


@query("""
with r as (select distinct cik, family, state, unit, units_mixed, severity from concept_resolution)
select 'no_unit' as problem, family, count(case when unit is null then 1 end) as n from r group by family
union all select 'foreign_unit', family, count(case when not regexp_matches(unit, '^(USD|usd|US\\$|iso4217:USD|shares|shs|\\$/sh|USD/shares|USD per share)$') then 1 end) from r group by family
union all select 'mixed', family, count(case when units_mixed = 1 then 1 end) from r group by family""")
def resolution_problems(spark, d):
    """Problems of resolved units by family."""
    r = table(spark, d, "concept_resolution").select("cik", "family", "state", "unit", "units_mixed", "severity").distinct()
    home = r"^(USD|usd|US\$|iso4217:USD|shares|shs|\$/sh|USD/shares|USD per share)$"
    g = r.groupBy("family").agg(F.count_if(F.col("unit").isNull()).alias("no_unit"), F.count_if(~F.rlike("unit", F.lit(home))).alias("foreign_unit"), F.count_if(F.col("units_mixed") == 1).alias("mixed"))
    return g.select("family", F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in ("no_unit", "foreign_unit", "mixed")))).alias("p")).select("p.problem", "family", "p.n")


@query(f"""
with {_F}, r as (select cik, accession_number, filing_date, form, row_number() over (partition by cik order by filing_date desc, form, accession_number) as place from f) select cik, accession_number, place from r where place <= 10""")
def landing_rows(spark, d):
    """The ten newest filings of each entity in the order of a landing page."""
    w = Window.partitionBy("cik").orderBy(F.col("filing_date").desc_nulls_first(), "form", "accession_number")
    return filings(spark, d).select("cik", "accession_number", F.row_number().over(w).cast("long").alias("place")).where("place <= 10")


# --- screens of texts, splits and models -------------------------------------------------------


@query(f"""
with c as (select distinct doc_id, section_type, text from documents where text is not null and text <> ''),
t as (select *, trim(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) as n from c),
s as (select section_type, case when n = '' then 0 else len(string_split(n, ' ')) end as w,
  case when regexp_matches(text, '{tx.STUBS["by_reference"]}') then 'by_reference' when regexp_matches(text, '{tx.STUBS["not_applicable"]}') then 'not_applicable'
    when regexp_matches(text, '{tx.STUBS["reserved"]}') then 'reserved' when regexp_matches(text, '{tx.STUBS["omitted"]}') then 'omitted' end as stub, regexp_matches(n, '{tx.RESULTS}') as results, regexp_extract(text, '(?i)\\bex(?:hibit)?[ .#-]*(\\d{{1,3}}(?:\\.\\d{{1,2}})?)', 1) as ex from t)
select section_type, count(*) as n, count(case when w <= 1500 and stub is not null then 1 end) as n_stubs, count(case when results then 1 end) as n_results, count(case when ex <> '' then 1 end) as n_exhibits from s group by section_type""")
def text_screens(spark, d):
    """Documents by section that are stubs, speak of results, or name an exhibit."""
    c = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", "section_type", "text").distinct()
    t = F.col("text")
    return c.groupBy("section_type").agg(
        F.count("*").alias("n"), F.count_if(tx.stub_kind(t).isNotNull()).alias("n_stubs"), F.count_if(tx.names_results(t)).alias("n_results"), F.count_if(tx.exhibit_number(t) != "").alias("n_exhibits")
    )


@query()
def stratified_split(spark, d):
    """Filings split by whole components so that each form has its share in evaluation; greedy, so without SQL."""
    c = graph.components(_occurrences(spark, d), "accession_number", "paragraph_id")
    members = c.join(filings(spark, d).select("accession_number", "form"), "accession_number", "left")
    s = graph.stratified_components(checkpointed(members), "accession_number", "component", "form")
    return c.join(s, "component").select("accession_number", "component", "split")


_FEATURES = ["x1", "x2", "x3"]


def _model_rows(spark, d):
    rows = _fold_rows(spark, d)
    return rows.select("fold", "role", "id", (F.col("y") / 1e6).alias("y"), F.month("d").alias("x1"), F.log1p(F.col("c").cast("double")).alias("x2"), F.substring("g", 1, 1).cast("int").alias("x3"))


@query()
def boosted_prediction(spark, d):
    """Boosted trees fitted on each fold's training rows."""
    return boosting.boosted_predictions(_model_rows(spark, d), _FEATURES, "y", "id", bins=8)


@query()
def boosted_importance(spark, d):
    """Gain and permutation loss of each feature in each fold."""
    return boosting.feature_importance(_model_rows(spark, d), _FEATURES, "y", bins=8)


def _ic(rows, predictions):
    outcome = rows.where("role = 'test'").select("fold", "id", "y")
    return sq.rank_correlation(predictions.join(outcome, ["fold", "id"]), "fold", "prediction", "y")


@query()
def leave_one_out(spark, d):
    """Rank correlation of each fold with all features, and how much it falls without each of them."""
    rows = checkpointed(_model_rows(spark, d))
    every = _ic(rows, boosting.boosted_predictions(rows, _FEATURES, "y", "id", bins=8)).select("fold", F.col("ic").alias("ic_all"))
    out = None
    for f in _FEATURES:
        rest = [x for x in _FEATURES if x != f]
        one = _ic(rows, boosting.boosted_predictions(rows, rest, "y", "id", bins=8)).select("fold", F.lit(f).alias("without"), "ic")
        out = one if out is None else out.unionByName(one)
    return out.join(every, "fold").select("fold", "without", "ic_all", "ic", (F.col("ic_all") - F.col("ic")).alias("fall"))


@query()
def seed_band(spark, d):
    """Lowest, mean and highest rank correlation of each fold over five seeds, with two of three features to a tree."""
    rows = checkpointed(_model_rows(spark, d))
    out = None
    for seed in range(5):
        one = _ic(rows, boosting.boosted_predictions(rows, _FEATURES, "y", "id", bins=8, share=0.67, seed=seed))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("fold").agg(F.min("ic").alias("lowest"), F.avg("ic").alias("mean"), F.max("ic").alias("highest"), F.count("ic").alias("n"))


@query()
def fold_embedding_axes(spark, d):
    """Coordinates of each block of vectors along the axes fitted on the blocks before it."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 100).cast("int").alias("block"))
    blocks = [r["block"] for r in e.select("block").distinct().orderBy("block").limit(64).collect()]
    train = e.select(F.explode(F.filter(F.array(*map(F.lit, blocks)).cast("array<int>"), lambda b: b > F.col("block"))).alias("fold"), F.lit("train").alias("role"), "vec_id", "embedding")
    test = e.select(F.col("block").alias("fold"), F.lit("test").alias("role"), "vec_id", "embedding")
    return fo.fold_axes(train.unionByName(test), "vec_id", "embedding", 64, 3)


@query("""
with m as (select distinct accession_number a, split from split_manifest where split is not null),
p as (select distinct paragraph_id, md5(regexp_replace(normalized_text, '\\p{Nd}+', chr(1), 'g')) as k, home_accession_number as h from canonical_paragraphs),
o as (select distinct t.paragraph_id, m.split from canonical_paragraphs t, unnest(t.occurrences) as u(o) join m on m.a = u.o.accession_number),
tk as (select distinct p.k from p join o using (paragraph_id) where o.split = 'train'), tr as (select paragraph_id from o where split = 'train'), th as (select a from m where split = 'train')
select o.split, count(*) as n, count(case when p.h in (select a from th) then 1 end) as n_home, count(case when p.paragraph_id in (select paragraph_id from tr) then 1 end) as n_any, count(case when p.k in (select k from tk) then 1 end) as n_text
from o join p using (paragraph_id) where o.split <> 'train' group by o.split""")
def overlap_channels(spark, d):
    """Evaluation paragraphs that training has through their home, through any filing, or by their text apart from numbers."""
    m = table(spark, d, "split_manifest").where("split is not null").distinct()
    c = table(spark, d, "canonical_paragraphs")
    o = _occurrences(spark, d).select("paragraph_id", "accession_number").join(m, "accession_number").groupBy("paragraph_id").agg(F.collect_set("split").alias("splits"))
    key = F.md5(F.regexp_replace("normalized_text", r"\p{Nd}+", "\u0001"))
    p = c.select("paragraph_id", key.alias("k"), F.col("home_accession_number").alias("h")).distinct().join(o, "paragraph_id")
    train = F.array_contains("splits", "train")
    keys = p.where(train).select("k").distinct().withColumn("_text", F.lit(1))
    home = m.where("split = 'train'").select(F.col("accession_number").alias("h"), F.lit(1).alias("_home"))
    j = p.join(keys, "k", "left").join(home, "h", "left").select(F.explode(F.array_remove("splits", "train")).alias("split"), "_home", "_text", train.alias("_any"))
    return j.groupBy("split").agg(F.count("*").alias("n"), F.count("_home").alias("n_home"), F.count_if("_any").alias("n_any"), F.count("_text").alias("n_text"))


# --- rules, labels, windows, audits --------------------------------------------------------------


@query("""
with c as (select distinct accession_number, doc_id, section_type from documents where accession_number is not null),
r as (select *, case section_type when 'EX99_PRESS_RELEASE' then 1 when '8K_BODY' then 2 when 'MDA' then 3 end as rule from c),
k as (select *, row_number() over (partition by accession_number order by rule nulls last, doc_id) as rn from r)
select accession_number, case when rule is not null then doc_id end as doc_id, case rule when 1 then 'high' when 2 then 'medium' when 3 then 'low' end as confidence from k where rn = 1""")
def selected_documents(spark, d):
    """One document of each filing by a ladder of rules; null where no rule matches."""
    c = table(spark, d, "documents").where("accession_number is not null").select("accession_number", "doc_id", "section_type").distinct()
    s = F.col("section_type")
    return panel.first_by_rules(c, "accession_number", [(s == "EX99_PRESS_RELEASE", "high"), (s == "8K_BODY", "medium"), (s == "MDA", "low")], "doc_id")


@query(f"""
with {_F}, r as (select unnest(['amended', 'late', 'many_items', 'never']) as rule),
h as (select 'amended' as rule, cik from f where form like '%/A' union all select 'late', cik from f where date_diff('day', report_date, filing_date) > 120 union all select 'many_items', cik from f where len(string_split(items, ',')) > 1)
select r.rule, count(h.rule) as n_fired, count(h.rule) = 0 as is_dead from r left join h using (rule) group by r.rule""")
def rule_counters(spark, d):
    """How often each rule of a table fired, those that never did included."""
    rules = {"amended": F.endswith("form", F.lit("/A")), "late": F.date_diff("filing_date", "report_date") > 120, "many_items": F.size(F.split("items", ",")) > 1, "never": F.col("form") == "none"}
    counts = filings(spark, d).agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_fired")) for n in rules))).alias("r")).select("r.*", (F.col("r.n_fired") == 0).alias("is_dead"))


@query("""
with l as (select distinct doc_id, abusive, reviewer, labelled_at from review_labels),
s as (select doc_id, max(case when reviewer = 'rev1' then abusive end) as owner, max(case when reviewer = 'rev2' then abusive end) as judge, min(abusive) as least, max(abusive) as most, count(*) as n from l group by doc_id)
select doc_id, coalesce(owner, judge, case when least = most then least end) as final, case when owner is not null then 'owner' when judge is not null then 'adjudicator' when least = most then 'raters' else 'open' end as decided_by, n from s""")
def adjudicated_labels(spark, d):
    """Final label of a document: the owner's, else the adjudicator's, else the raters' if they agree."""
    l = table(spark, d, "review_labels").select("doc_id", "abusive", "reviewer", "labelled_at").distinct()  # noqa: E741
    by = lambda r: F.max(F.when(F.col("reviewer") == r, F.col("abusive")))
    s = l.groupBy("doc_id").agg(by("rev1").alias("o"), by("rev2").alias("j"), F.min("abusive").alias("lo"), F.max("abusive").alias("hi"), F.count("*").alias("n"))
    agreed = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    decided = F.when(F.col("o").isNotNull(), "owner").when(F.col("j").isNotNull(), "adjudicator").when(F.col("lo") == F.col("hi"), "raters").otherwise("open")
    return s.select("doc_id", F.coalesce("o", "j", agreed).alias("final"), decided.alias("decided_by"), "n")


@query("""
with d as (select distinct doc_id, source, n_chars from documents), l as (select doc_id, max(abusive) as abusive from review_labels group by doc_id)
select d.doc_id, coalesce(d.source, '?') as source, l.abusive, d.n_chars from d join l using (doc_id)""")
def labelled_documents(spark, d):
    """Documents that have a label, with it; the rest of the corpus is left out."""
    l = table(spark, d, "review_labels").groupBy("doc_id").agg(F.max("abusive").alias("abusive"))  # noqa: E741
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), "n_chars").distinct()
    return docs.join(l, "doc_id").select("doc_id", "source", "abusive", "n_chars")


@query("""
with p as (select distinct chunk_id, prediction_id, prompt, prompt_sha256 from predictions), c as (select chunk_id, count(*) as n, count(distinct prompt) as n_prompts, count(case when sha256(prompt) <> prompt_sha256 then 1 end) as n_wrong from p group by chunk_id)
select case when n = 1 then 'single' when n_prompts = 1 then 'same' else 'differ' end as prompts, count(*) as n_chunks, sum(n_wrong)::bigint as n_wrong_hashes from c group by 1""")
def prompt_equality(spark, d):
    """Whether all answers about a chunk were asked with one prompt, and prompts whose recorded hash is wrong."""
    p = table(spark, d, "predictions").select("chunk_id", "prediction_id", F.sha2("prompt", 256).alias("h"), "prompt_sha256").distinct()
    c = p.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct("h").alias("k"), F.count_if(F.col("h") != F.col("prompt_sha256")).alias("w"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("k") == 1, "same").otherwise("differ")
    return c.groupBy(kind.alias("prompts")).agg(F.count("*").alias("n_chunks"), F.sum("w").alias("n_wrong_hashes"))


@query(f"""
with {_X} select cik, least(min(filed), min(period_end)) as first_day, greatest(max(filed), max(period_end)) as last_day, count(*) as n from x where cik is not null group by cik""")
def entity_windows(spark, d):
    """A window of days for each entity that cuts off none of its facts."""
    return facts(spark, d).where("cik is not null").groupBy("cik").agg(F.least(F.min("filed"), F.min("period_end")).alias("first_day"), F.greatest(F.max("filed"), F.max("period_end")).alias("last_day"), F.count("*").alias("n"))


@query(f"""
with {_F}, w as (select distinct cik, report_date from f where form like '%/A' and report_date is not null)
select f.form, count(*) as n, count(case when w.cik is null then 1 end) as n_kept from f left join w on f.cik = w.cik and f.report_date = w.report_date group by f.form""")
def without_amended(spark, d):
    """Filings by form, and those of periods that no amendment withdrew."""
    f = filings(spark, d)
    w = f.where("form like '%/A' and report_date is not null").select("cik", "report_date").distinct().withColumn("gone", F.lit(1))
    return f.join(w, ["cik", "report_date"], "left").groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("gone").isNull()).alias("n_kept"))


@query("""
with f as (select distinct accession_number, earnings_doc_section_type s, earnings_doc_selection_confidence c, has_earnings_item h, filing_date d from filings)
select coalesce(s, 'none') as section_type, coalesce(c, 'none') as confidence, coalesce(h, false) as has_item, count(*) as n, min(year(d)) as first_year from f group by 1, 2, 3""")
def selection_audit(spark, d):
    """Selected documents by section, confidence and item, with the first year of each."""
    f = table(spark, d, "filings").select("accession_number", "earnings_doc_section_type", "earnings_doc_selection_confidence", "has_earnings_item", "filing_date").distinct()
    keys = [F.coalesce(c, F.lit(v)).alias(n) for c, v, n in (("earnings_doc_section_type", "none", "section_type"), ("earnings_doc_selection_confidence", "none", "confidence"), ("has_earnings_item", False, "has_item"))]
    return f.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.year("filing_date")).cast("long").alias("first_year"))


@query(f"""
with {_F}, u as (select cik, min(sector) as sector from universe_membership where sector is not null group by cik), e as (select distinct cik from f where list_contains(list_transform(string_split(items, ','), lambda x: trim(x)), '2.02'))
select u.sector, count(*) as n_members, count(e.cik) as n_covered, count(e.cik) < 0.5 * count(*) as is_thin from u left join e using (cik) group by u.sector""")
def sector_coverage(spark, d):
    """Members of each sector with at least one earnings filing."""
    u = table(spark, d, "universe_membership").where("sector is not null").groupBy("cik").agg(F.min("sector").alias("sector"))
    e = filings(spark, d).where(sc.has_item(F.col("items"), "2.02")).select("cik", F.lit(1).alias("hit")).distinct()
    return u.join(e, "cik", "left").groupBy("sector").agg(F.count("*").alias("n_members"), F.count("hit").alias("n_covered"), (F.count("hit") < 0.5 * F.count("*")).alias("is_thin"))


@query(f"""
{_CALLS}, s as (select entity, id, fold, case when called_up then 1.0 else 0 end as a, case when was_up then 1.0 else 0 end as b from calls)
select entity, count(*) as n, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) end as agreement from s group by entity""")
def entity_agreement(spark, d):
    """Correlation of calls and outcomes of each entity; null under three or without variance."""
    c = _calls(spark, d).select("entity", F.col("called_up").cast("double").alias("a"), F.col("was_up").cast("double").alias("b"))
    return c.groupBy("entity").agg(F.count("*").alias("n"), F.round(sq.guarded_corr(F.col("a"), F.col("b")), 6).alias("agreement"))


@query("""
with f as (select distinct cik, instant, filed, val from float_facts where val is not null and val > 0 and filed is not null), a as (select *, val / nullif(exp(avg(ln(val)) over (partition by cik)), 0) as r, count(*) over (partition by cik) as k from f)
select case when k < 3 then 'too_few' when r > 300 then 'too_large' when r < 1.0 / 300 then 'too_small' else 'fine' end as scale, count(*) as n, count(distinct cik) as n_entities from a group by 1""")
def float_scale_audit(spark, d):
    """Values far from the geometric mean of their entity's: a wrong scale."""
    f = table(spark, d, "float_facts").where("val is not null and val > 0 and filed is not null").select("cik", "instant", "filed", "val").distinct()
    m = f.groupBy("cik").agg(F.avg(F.log("val")).alias("m"), F.count("*").alias("k"))
    r = F.col("val") / F.exp("m")
    scale = F.when(F.col("k") < 3, "too_few").when(r > 300, "too_large").when(r < 1 / 300, "too_small").otherwise("fine")
    return f.join(m, "cik").groupBy(scale.alias("scale")).agg(F.count("*").alias("n"), F.count_distinct("cik").alias("n_entities"))


@query(f"""
with {_F}, s as (select cik, count(*) as n, count(distinct form) as k, count(distinct ticker) as t, max(filing_date) as z, min(filing_date) as a from (select distinct accession_number, cik, form, ticker, filing_date from filings) group by cik), v as (select cik, n, k, t, a, z from s where cik is not null)
select cik, 'several_tickers' as flag from v where t > 1 union all select cik, 'one_form' from v where k = 1 and n > 1 union all select cik, 'short_life' from v where date_diff('day', a, z) < 200 and n > 1
union all select cik, 'no_ticker' from v where t = 0""")
def entity_flags(spark, d):
    """Oddities of entities, a row for each."""
    f = table(spark, d, "filings").where("cik is not null").select("accession_number", "cik", "form", "ticker", "filing_date").distinct()
    s = f.groupBy("cik").agg(F.count("*").alias("n"), F.count_distinct("form").alias("k"), F.count_distinct("ticker").alias("t"), F.min("filing_date").alias("a"), F.max("filing_date").alias("z"))
    flags = {"several_tickers": F.col("t") > 1, "one_form": (F.col("k") == 1) & (F.col("n") > 1), "short_life": (F.date_diff("z", "a") < 200) & (F.col("n") > 1), "no_ticker": F.col("t") == 0}
    return s.select("cik", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))).alias("flag"))


@query("""
with p as (select distinct accession_number, section_type, position from paragraph_occurrences), f as (select accession_number, any_value(filing_date) as d, any_value(has_earnings_item) as h from filings group by 1),
c as (select section_type, year(d) * 4 + quarter(d) - 1 as q, count(distinct accession_number) as n, count(distinct case when h then accession_number end) as k from p join f using (accession_number) group by 1, 2)
select section_type, q, n, case when n >= 10 and k > 0 then 'full' when n >= 3 then 'thin' else 'sparse' end as level from c""")
def population_levels(spark, d):
    """Level of each section and quarter by the filings it has; nothing is dropped."""
    p = table(spark, d, "paragraph_occurrences").select("accession_number", "section_type").distinct()
    f = table(spark, d, "filings").groupBy("accession_number").agg(F.any_value("filing_date").alias("d"), F.any_value("has_earnings_item").alias("h"))
    c = p.join(f, "accession_number").groupBy("section_type", fo.quarter_index(F.col("d")).cast("long").alias("q")).agg(F.count("*").alias("n"), F.count_if("h").alias("k"))
    return c.select("section_type", "q", "n", F.when((F.col("n") >= 10) & (F.col("k") > 0), "full").when(F.col("n") >= 3, "thin").otherwise("sparse").alias("level"))


# --- boundaries, assertions, profiles ------------------------------------------------------------


@query(f"""
with {_F}, s as (select distinct cik, member_from a, member_to b from universe_membership where member_from is not null and (member_to is null or member_to > member_from))
select 'first_day' as boundary, count(distinct f.accession_number) as n from f join s on s.cik = f.cik and f.filing_date = s.a union all
select 'last_day', count(distinct f.accession_number) from f join s on s.cik = f.cik and f.filing_date = s.b - 1 union all
select 'day_after', count(distinct f.accession_number) from f join s on s.cik = f.cik and f.filing_date = s.b""")
def boundary_rows(spark, d):
    """Filings on the first and the last day of a spell, which are inside, and on the day after, which is not."""
    f = filings(spark, d).select("accession_number", "cik", "filing_date")
    s = table(spark, d, "universe_membership").where("member_from is not null and (member_to is null or member_to > member_from)").select("cik", "member_from", "member_to").distinct()
    days = F.array(*(F.struct(F.lit(n).alias("boundary"), c.alias("filing_date")) for n, c in (("first_day", F.col("member_from")), ("last_day", F.date_sub("member_to", 1)), ("day_after", F.col("member_to")))))
    met = s.select("cik", F.inline(days)).distinct().join(f, ["cik", "filing_date"]).groupBy("boundary").agg(F.count_distinct("accession_number").alias("n"))
    names = spark.createDataFrame([("first_day",), ("last_day",), ("day_after",)], "boundary string")
    return names.join(met, "boundary", "left").select("boundary", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
with p as (select distinct accession_number, section_type, position from paragraph_occurrences) select section_type = '8K_BODY' as is_excluded, count(*) as n, count(distinct accession_number) as n_filings from p group by 1""")
def section_exclusion(spark, d):
    """Paragraphs of the excluded section and of the others, counted before they are dropped; both counts must add up to all."""
    p = table(spark, d, "paragraph_occurrences").select("accession_number", "section_type", "position").distinct()
    return p.groupBy((F.col("section_type") == "8K_BODY").alias("is_excluded")).agg(F.count("*").alias("n"), F.count_distinct("accession_number").alias("n_filings"))


@query("""
with p as (select distinct doc_id, lang, source from documents), k as (select * from p where source is distinct from 'system_log')
select coalesce(source, '?') as source, count(*) as n, count(case when lang = 'en' then 1 end) as n_english from k group by 1""")
def without_one_source(spark, d):
    """A source left out before anything else is counted; a null source stays."""
    p = table(spark, d, "documents").select("doc_id", "lang", "source").distinct().where(~F.col("source").eqNullSafe("system_log"))
    return p.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_english"))


@query(f"""
with {_F}, {_X}, k as (select f.accession_number, f.filing_date, max(x.filed) as seen from f join x on x.cik = f.cik and x.filed < f.filing_date group by 1, 2),
m as (select f.accession_number, f.filing_date, s.member_from, s.member_to from f join (select distinct cik, member_from, member_to from universe_membership) s on s.cik = f.cik and s.member_from <= f.filing_date and (s.member_to is null or f.filing_date < s.member_to))
select 'known_later' as "check", 'FATAL' as severity, count(case when seen >= filing_date then 1 end) as n_bad from k
union all select 'outside_spell', 'FATAL', count(case when filing_date < member_from or filing_date >= member_to then 1 end) from m
union all select 'occurs_before_home', 'FATAL', count(case when o.filing_date < t.home_filing_date then 1 end) from (select distinct * from canonical_paragraphs) t, unnest(t.occurrences) as u(o)
union all select 'accepted_before_filed', 'WARN', count(case when acceptance_datetime::date < filing_date - 1 then 1 end) from f""")
def lookahead_checks(spark, d):
    """Assertions that nothing was used before it was known: states, memberships, homes, and times of acceptance."""
    from meridian.operators.known_at import with_known

    f = filings(spark, d)
    x = facts(spark, d).where("filed is not null").select("cik", F.col("filed").alias("day"), F.col("fact_id").cast("string").alias("source"), "value")
    k = with_known(f.select("accession_number", "cik", "filing_date"), x, entity="cik", at="filing_date", effective="day", disclosed="day", source="source", value="value")
    s = table(spark, d, "universe_membership").select("cik", "member_from", "member_to").distinct()
    m = f.join(s, "cik").where("member_from <= filing_date and (member_to is null or filing_date < member_to)")
    homes = table(spark, d, "canonical_paragraphs").select("home_filing_date", F.explode("occurrences").alias("o"))
    return quality.report([
        quality.no_rows("known_later", k, F.col("known_disclosed") >= F.col("filing_date")),
        quality.no_rows("outside_spell", m, (F.col("filing_date") < F.col("member_from")) | (F.col("filing_date") >= F.col("member_to"))),
        quality.no_rows("occurs_before_home", homes, F.col("o.filing_date") < F.col("home_filing_date")),
        quality.no_rows("accepted_before_filed", f, F.to_date("acceptance_datetime") < F.date_sub("filing_date", 1), "WARN"),
    ])


@query(f"""
with {_X} select fact_id, row_number() over (order by cik nulls first, concept nulls first, period_end nulls first, filed nulls first, accession_number nulls first, fact_id) - 1 as place from x""")
def fact_order(spark, d):
    """The place of each fact in the total order of the table."""
    x = facts(spark, d).select("fact_id", "cik", "concept", "period_end", "filed", "accession_number")
    return row_index(x, [F.col(c) for c in ("cik", "concept", "period_end", "filed", "accession_number", "fact_id")], "place").select("fact_id", "place")


@query("""
with f as (select distinct cik, instant, filed, val from float_facts where val > 0) select cik, count(*) as n, median(val) as median_value from f where cik is not null group by cik""")
def implied_medians(spark, d):
    """Median of each entity's positive values, from their places in a range-partitioned order."""
    f = table(spark, d, "float_facts").where("val > 0 and cik is not null").select("cik", "instant", "filed", "val").distinct()
    p = position_in_group(f, ["cik"], [F.col("val"), F.col("instant"), F.col("filed")])
    middle = (F.col("position") == F.floor((F.col("group_size") - 1) / 2)) | (F.col("position") == F.floor(F.col("group_size") / 2))
    return p.where(middle).groupBy("cik").agg(F.max("group_size").alias("n"), F.avg("val").alias("median_value"))


@query(f"""
with {_DAILY}, b as (select min(day) lo, max(day) hi from e), u as (select user_id, min(day) a, max(day) z, count(*) as n from e group by user_id)
select case when a <= lo + 2 and z >= hi - 2 then 'complete' when a <= lo + 2 then 'ends_early' when z >= hi - 2 then 'starts_late' else 'both' end as censoring, count(*) as n_entities, sum(n)::bigint as n_days from u, b group by 1""")
def censoring_census(spark, d):
    """Entities whose series starts late or ends early."""
    e = _daily(spark, d)
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    u = e.groupBy("user_id").agg((F.min("day") <= F.date_add(F.lit(lo), 2)).alias("s"), (F.max("day") >= F.date_sub(F.lit(hi), 2)).alias("t"), F.count("*").alias("n"))
    kind = F.when(F.col("s") & F.col("t"), "complete").when(F.col("s"), "ends_early").when(F.col("t"), "starts_late").otherwise("both")
    return u.groupBy(kind.alias("censoring")).agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_days"))


@query("""
with l as (select distinct doc_id, abusive, category, reviewer, labelled_at from review_labels), t as (select doc_id, max(abusive) as truth, max(category) as kind from l group by doc_id)
select coalesce(t.kind, 'none') as category, case when l.abusive = t.truth then 'right' when l.abusive = 0 then 'omission' else 'commission' end as mode, count(*) as n from l join t using (doc_id) group by 1, 2""")
def error_modes(spark, d):
    """Labels by category against the union of a document's labels: right, omitted, or committed."""
    l = table(spark, d, "review_labels").select("doc_id", "abusive", "category", "reviewer", "labelled_at").distinct()  # noqa: E741
    t = l.groupBy("doc_id").agg(F.max("abusive").alias("truth"), F.max("category").alias("kind"))
    mode = F.when(F.col("abusive") == F.col("truth"), "right").when(F.col("abusive") == 0, "omission").otherwise("commission")
    return l.join(t, "doc_id").groupBy(F.coalesce("kind", F.lit("none")).alias("category"), mode.alias("mode")).agg(F.count("*").alias("n"))


@query("with ic as (" + RANK_IC + """), s as (select count(ic) as n, avg(ic) as mean, stddev_samp(ic) as sd from ic)
select n, round(mean, 6) as mean, round(sd, 6) as sd, case when n < 3 or sd = 0 then 'untestable' when abs(mean) > 2 * sd / sqrt(n) then 'signal' else 'none' end as verdict from s""")
def control_verdict(spark, d):
    """Verdict on a control: whether its mean rank correlation over periods is told from 0."""
    s = rank_ic_by_period(spark, d).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"))
    verdict = F.when((F.col("n") < 3) | (F.col("sd") == 0), "untestable").when(F.abs("mean") > 2 * F.col("sd") / F.sqrt("n"), "signal").otherwise("none")
    return s.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), verdict.alias("verdict"))


@query(f"""
with {_DAILY}, b as (select distinct user_id, cast(ts as date) as event_day from events where event_type = 'purchase'), o as (select unnest(range(-2, 3)) as k)
select o.k as day_offset, count(*) as n, round(avg(e.v), 6) as mean_value, round(stddev_samp(e.v), 6) as sd from b, o join e on e.user_id = b.user_id and e.day = b.event_day + o.k::int group by o.k""")
def event_profile(spark, d):
    """Mean daily value around an event, day by day."""
    b = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("event_day")).distinct()
    around = b.select("user_id", F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("day_offset"), "event_day").withColumn("day", F.date_add("event_day", F.col("day_offset")))
    return around.join(_daily(spark, d), ["user_id", "day"]).groupBy(F.col("day_offset").cast("long").alias("day_offset")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_value"), F.round(F.stddev_samp("v"), 6).alias("sd"))


@query(f"""
{_FOLDS}, m as (select fold, g, avg(y) v from t group by 1, 2), a as (select fold, avg(y) v from t group by 1),
df as (select r.q as fold, r.id, coalesce(m.v, a.v) - a.v as delta from r join a on a.fold = r.q left join m on m.fold = r.q and m.g = r.g)
select fold, count(*) as n, round(avg(delta), 4) as mean_delta, round(stddev_samp(delta), 4) as sd_delta, round((count(case when delta < 0 then 1 end) + 0.5 * count(case when delta = 0 then 1 end)) / count(*), 6) as rank_of_zero from df group by fold""")
def matched_differences(spark, d):
    """Differences of two predictions of the same rows: mean, sample deviation, and the midrank percentile of no difference."""
    rows = checkpointed(_fold_rows(spark, d).select("fold", "role", "id", "g", "y"))
    level = rows.where("role = 'train'").groupBy("fold").agg(F.avg("y").alias("level"))
    p = fo.group_mean_prediction(rows, "g", "y", "id").join(broadcast_if_small(level), "fold").withColumn("delta", F.col("prediction") - F.col("level"))
    zero = (F.count_if(F.col("delta") < 0) + 0.5 * F.count_if(F.col("delta") == 0)) / F.count("*")
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.round(F.stddev_samp("delta"), 4).alias("sd_delta"), F.round(zero, 6).alias("rank_of_zero"))


@query()
def ic_difference(spark, d):
    """Difference of the rank correlations of two features with the outcome over all test rows, with its bootstrap deviation."""
    rows = _model_rows(spark, d).where("role = 'test'").select(F.lit(1).alias("all"), "id", "x1", "x2", "y")
    ranked = rows
    for c in ("x1", "x2", "y"):
        r = value_ranks(rows, ["all"], c).select(F.col(c).alias(f"_{c}"), midrank().alias(f"r_{c}"))
        ranked = ranked.join(r, F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    got = inference.correlation_difference(checkpointed(ranked), "id", "r_x1", "r_x2", "r_y", draws=200)
    return spark.createDataFrame([(got["difference"], got["sd"], got["n"])], "difference double, sd double, n long")


# --- labels in full, plans and screens ----------------------------------------------------------------


@query(f"""
with {_ANSWER}, k as (select prediction_id, reason is null as ok, j->>'$.guidance_direction' as g, contains(t, 'guidance_direction') as asked from answers)
select case when ok and asked then coalesce(g, 'NONE') end as guidance, ok and asked and g is null as is_imputed, count(distinct prediction_id) as n from k where ok group by 1, 2""")
def normalised_guidance(spark, d):
    """Guidance of the answers to which it applies, with NONE for a missing one, which is marked."""
    p = table(spark, d, "predictions").select("prediction_id", "raw_output").distinct()
    fence = F.regexp_replace(F.btrim(F.regexp_replace("raw_output", r"^\s+|\s+$", ""), F.lit("`")), "^json", "")
    plain = F.when(F.startswith(F.regexp_replace("raw_output", r"^\s+", ""), F.lit("```")), fence).otherwise(F.col("raw_output"))
    p = p.where(read_answer(F.col("raw_output"))["reason"].isNull())
    g = sc.imputed(F.try_variant_get(F.try_parse_json(plain), "$.guidance_direction", "string"), F.contains(plain, F.lit("guidance_direction")), "NONE")
    return p.select("prediction_id", g.alias("g")).groupBy(F.col("g.value").alias("guidance"), F.col("g.is_imputed").alias("is_imputed")).agg(F.count_distinct("prediction_id").alias("n"))


@query("""
with s as (select distinct section_type from paragraph_occurrences where section_type is not null)
select section_type, to_json({'section': section_type, 'fields': case when section_type in ('MDA', 'EX99_PRESS_RELEASE') then ['sentiment', 'guidance_direction', 'red_flags'] else ['sentiment', 'red_flags'] end})::varchar as schema from s""")
def section_schemas(spark, d):
    """The fields that are asked of a section: guidance only where it applies."""
    s = table(spark, d, "paragraph_occurrences").where("section_type is not null").select("section_type").distinct()
    fields = F.when(F.col("section_type").isin("MDA", "EX99_PRESS_RELEASE"), F.array(*map(F.lit, ("sentiment", "guidance_direction", "red_flags")))).otherwise(F.array(F.lit("sentiment"), F.lit("red_flags")))
    return s.select("section_type", F.to_json(F.struct(F.col("section_type").alias("section"), fields.alias("fields"))).alias("schema"))


@query("""
with l as (select distinct doc_id, abusive, reviewer, labelled_at from review_labels), d as (select doc_id, min(section_type) as section_type, min(filing_date) as filing_date from documents group by doc_id)
select coalesce(d.section_type, 'unknown') as section_type, count(*) as n_labels, count(case when d.doc_id is null then 1 end) as n_without_document, min(d.filing_date) as first_day from l left join d using (doc_id) group by 1""")
def labels_with_metadata(spark, d):
    """Labels with what is known of their documents; a label without one is kept and counted."""
    l = table(spark, d, "review_labels").select("doc_id", "abusive", "reviewer", "labelled_at").distinct()  # noqa: E741
    m = table(spark, d, "documents").groupBy("doc_id").agg(F.min("section_type").alias("section_type"), F.min("filing_date").alias("filing_date"))
    j = panel.assembled(l, {"document": m}, ["doc_id"])
    return j.groupBy(F.coalesce("section_type", F.lit("unknown")).alias("section_type")).agg(F.count("*").alias("n_labels"), F.count_if(~F.col("has_document")).alias("n_without_document"), F.min("filing_date").alias("first_day"))


@query("""
with f as (select distinct accession_number, cik, earnings_doc_filename n, has_earnings_item h from filings)
select cik, count(case when h then 1 end) as n_asked, count(n) as n_selected, count(case when h and n is null then 1 end) as n_open from f group by cik having count(case when h then 1 end) > 0""")
def selection_counts(spark, d):
    """Documents that each entity's earnings filings should have, and those that were selected."""
    f = table(spark, d, "filings").select("accession_number", "cik", "earnings_doc_filename", "has_earnings_item").distinct()
    g = f.groupBy("cik").agg(F.count_if("has_earnings_item").alias("n_asked"), F.count("earnings_doc_filename").alias("n_selected"), F.count_if(F.col("has_earnings_item") & F.col("earnings_doc_filename").isNull()).alias("n_open"))
    return g.where("n_asked > 0")


@query("""
with e as (select distinct vec_id, embedding, label from embeddings)
select 'width' as "check", 'FATAL' as severity, count(case when len(embedding) <> 64 then 1 end) as n_bad from e
union all select 'no_vector', 'WARN', count(case when embedding is null then 1 end) from e
union all select 'not_finite', 'FATAL', count(case when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 1 end) from e
union all select 'key', 'FATAL', count(*) from (select vec_id from e group by vec_id having count(*) > 1)""")
def vector_checks(spark, d):
    """Widths, nulls and numbers of the vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label").distinct()
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return quality.report([
        quality.no_rows("width", e, F.size("embedding") != 64), quality.no_rows("no_vector", e, F.col("embedding").isNull(), "WARN"),
        quality.no_rows("not_finite", e, odd), quality.unique_key("key", e, ["vec_id"]),
    ])


@query("""
with c as (select o_custkey as component, count(*) as size from orders group by 1), t as (select *, sum(size) over (order by component rows between unbounded preceding and 1 preceding) as before, sum(size) over () as total from c)
select component, size, least(floor(coalesce(before, 0) * 8 / total), 7)::int as segment from t""")
def segments_of_customers(spark, d):
    """Customers laid end to end and cut into eight segments of about as many orders."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.count("*").alias("size"))
    return graph.segment_plan(c, "component", "size", 8)


@query(f"""
{_FOLDS} select r.q as fold, r.g as stratum, count(*) as n_rows, count(case when r.y > 0 then 1 end) as n_usable, count(distinct r.c) as n_entities from r join u on u.fold = r.q group by 1, 2""")
def fold_populations(spark, d):
    """Test rows of each fold by stratum: all, those with an outcome, and their entities."""
    t = _fold_rows(spark, d).where("role = 'test'")
    return t.groupBy("fold", F.col("g").alias("stratum")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("y") > 0).alias("n_usable"), F.count_distinct("c").alias("n_entities"))


@query("""
with c as (select distinct doc_id, accession_number, section_type from documents where accession_number is not null), g as (select accession_number, section_type, count(*) as n, min(doc_id) as doc_id from c group by 1, 2)
select accession_number, section_type, case when n = 1 then doc_id end as doc_id, n from g""")
def single_candidates(spark, d):
    """The document of a filing's section if there is just one; of several none is chosen."""
    c = table(spark, d, "documents").where("accession_number is not null").select("doc_id", "accession_number", "section_type").distinct()
    g = c.groupBy("accession_number", "section_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return g.select("accession_number", "section_type", F.when(F.col("n") == 1, F.col("doc_id")).alias("doc_id"), "n")


@query("""
with c as (select distinct doc_id, coalesce(source, '?') as source, text from documents where text is not null)
select source, count(*) as n, count(case when regexp_matches(text, '(?i)\b(slide|presentation|safe harbor)\b') then 1 end) as n_decks, count(case when regexp_matches(text, '(?i)\bfor immediate release\b') then 1 end) as n_releases,
 count(case when regexp_matches(text, '<[a-zA-Z/][^>]*>') then 1 end) as n_markup from c group by source""")
def document_flags(spark, d):
    """Documents of each source that look like decks, releases or markup."""
    c = table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), "text").distinct()
    has = lambda p: F.count_if(F.rlike("text", F.lit(p)))
    return c.groupBy("source").agg(F.count("*").alias("n"), has(r"(?i)\b(slide|presentation|safe harbor)\b").alias("n_decks"), has(r"(?i)\bfor immediate release\b").alias("n_releases"), has("<[a-zA-Z/][^>]*>").alias("n_markup"))
