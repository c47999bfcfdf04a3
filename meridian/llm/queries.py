"""Queries of the text problems over the filing tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.boilerplate import line_key, lines_in_documents, repeated_lines, sections_without
from meridian.llm.mix import mix_sources, mixture_report
from meridian.llm.overlap import cross_split_overlaps, with_coverage, with_sides
from meridian.llm.pairs import pair_defects
from meridian.llm.rows import distinct_rows
from meridian.llm.split import split_oversized
from meridian.llm.tokenize import encode_texts
from meridian.llm.toxicity import rates, score_texts
from meridian.session import table

_PARAGRAPH = ["accession_number", "section_type", "position"]


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "paragraph_occurrences"), _PARAGRAPH, "text", max_words=350, overlap=40)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece_no = 0").select(*_PARAGRAPH).distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = table(spark, sf_dir, "canonical_paragraphs").where("normalized_text is not null")
    return canonical.select(line_key(F.col("normalized_text")).alias("key"), F.explode("occurrences").alias("o")).select(
        F.col("o.cik").alias("source"),
        F.col("o.accession_number").alias("document"),
        F.col("o.filing_date").alias("published"),
        F.col("o.section_type").alias("section"),
        F.col("o.position").alias("position"),
        "key",
    )


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_in_documents(_lines(spark, sf_dir), min_documents=5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the lines in 5 filings of their cik; clusters and dates, which decide nothing here, are not made (see ``p2_boilerplate``)."""
    return _repeated(spark, sf_dir).select(
        F.col("document").alias("accession_number"), F.col("section").alias("section_type"), "position"
    ).distinct()


def p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated line with its counts of documents, document clusters and dates."""
    return (
        repeated_lines(_lines(spark, sf_dir), min_documents=5)
        .groupBy(F.col("source").alias("cik"), F.lower(F.hex("key")).alias("line_key"))
        .agg(
            F.max("n_documents").alias("n_filings"),
            F.max("n_clusters").alias("n_clusters"),
            F.max("n_dates").alias("n_dates"),
            F.count("*").alias("n_occurrences"),
        )
    )


def p2_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in 5 filings at least and, after near copies of filings have been collapsed, in 5 clusters first published on 5 days.

    So a filing republished again and again, with or without changes of its own,
    makes no line boilerplate.
    """
    found = repeated_lines(_lines(spark, sf_dir), min_documents=5, min_clusters=5, min_dates=5, near=True)
    return found.select(F.col("source").alias("cik"), F.lower(F.hex("key")).alias("line_key"), "n_documents", "n_clusters", "n_dates").distinct()


def p2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filing's sections without the repeated lines."""
    paragraphs = table(spark, sf_dir, "paragraph_occurrences").select(
        F.col("accession_number").alias("document"), F.col("section_type").alias("section"), "position", "text"
    )
    clean = sections_without(paragraphs, _repeated(spark, sf_dir))
    return clean.withColumnsRenamed({"document": "accession_number", "section": "section_type"})


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with the splits of the filings that they occur in."""
    paragraphs = table(spark, sf_dir, "canonical_paragraphs").select(
        F.xxhash64("paragraph_id").alias("record"),
        F.col("normalized_text").alias("text"),
        F.transform("occurrences", lambda o: o["accession_number"]).alias("documents"),
    )
    return with_sides(paragraphs, "documents", table(spark, sf_dir, "split_manifest"), "accession_number", "split")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(split, paragraph_id_a, paragraph_id_b, common, of)``."""
    found = cross_split_overlaps(_records(spark, sf_dir))
    names = table(spark, sf_dir, "canonical_paragraphs").select(F.xxhash64("paragraph_id").alias("_r"), "paragraph_id").distinct()
    a = names.select(F.col("_r").alias("a"), F.col("paragraph_id").alias("_a"))
    b = names.select(F.col("_r").alias("b"), F.col("paragraph_id").alias("_b"))
    return found.join(a, "a").join(b, "b").select(
        "split", F.least("_a", "_b").alias("paragraph_id_a"), F.greatest("_a", "_b").alias("paragraph_id_b"), "common", "of"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("split", "paragraph_id_a", "paragraph_id_b").distinct()


def _overlapping_occurrences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs in a cross-split pair ``(split, paragraph_id)``, and where they occur in filings of a split."""
    pairs = p5_found(spark, sf_dir)
    members = pairs.select("split", F.explode(F.array("paragraph_id_a", "paragraph_id_b")).alias("paragraph_id")).distinct()
    manifest = table(spark, sf_dir, "split_manifest").where("split is not null").distinct().select("accession_number", F.col("split").alias("filing_split"))
    occurrences = (
        table(spark, sf_dir, "canonical_paragraphs")
        .select("paragraph_id", F.explode("occurrences").alias("o"))
        .select("paragraph_id", "o.cik", "o.accession_number", "o.section_type", "o.position")
        .distinct()
        .join(manifest, "accession_number")
    )
    return members, occurrences


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping paragraphs with their text and their occurrences in the evaluation split and in training."""
    members, occurrences = _overlapping_occurrences(spark, sf_dir)
    texts = table(spark, sf_dir, "canonical_paragraphs").groupBy("paragraph_id").agg(F.min("normalized_text").alias("normalized_text"))
    counts = members.join(occurrences, "paragraph_id").groupBy("split", "paragraph_id").agg(
        F.count_if(F.col("filing_split") == F.col("split")).alias("n_in_split"),
        F.count_if(F.col("filing_split") == "train").alias("n_in_train"),
        F.count_distinct("cik").alias("n_ciks"),
    )
    return counts.join(texts, "paragraph_id").select("split", "paragraph_id", "normalized_text", "n_in_split", "n_in_train", "n_ciks")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and cik: paragraphs of the split's filings that overlap with training, and their occurrences."""
    members, occurrences = _overlapping_occurrences(spark, sf_dir)
    there = members.join(occurrences, "paragraph_id").where(F.col("filing_split") == F.col("split"))
    return there.groupBy("split", "cik").agg(
        F.count_distinct("paragraph_id").alias("n_paragraphs"), F.count("*").alias("n_occurrences"), F.count_distinct("accession_number").alias("n_filings")
    )


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each overlapping paragraph stands in its best partner: share of its words in shared spans."""
    pairs = p5_found(spark, sf_dir)
    both = pairs.select("split", F.col("paragraph_id_a").alias("paragraph_id"), F.col("paragraph_id_b").alias("partner")).unionByName(
        pairs.where("paragraph_id_a <> paragraph_id_b").select("split", F.col("paragraph_id_b").alias("paragraph_id"), F.col("paragraph_id_a").alias("partner"))
    )
    texts = table(spark, sf_dir, "canonical_paragraphs").groupBy("paragraph_id").agg(F.min("normalized_text").alias("text"))
    joined = both.join(texts, "paragraph_id").join(texts.select(F.col("paragraph_id").alias("partner"), F.col("text").alias("other")), "partner")
    covered = with_coverage(joined, ["split", "paragraph_id"])
    return covered.groupBy("split", "paragraph_id").agg(
        F.max("covered").alias("covered"), F.max("longest_span").alias("longest_span"), F.count("*").alias("n_partners")
    )


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct pair with its defect, or null, and how much of the answer is copied."""
    return pair_defects(table(spark, sf_dir, "predictions"), ["prediction_id", "chunk_id"], "prompt", "raw_output")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pairs(spark, sf_dir).where("defect is not null").select("prediction_id", "defect").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(distinct_rows(documents, "doc_id"), ["doc_id"], "text")


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document stands in the mixture."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reached."""
    targets = table(spark, sf_dir, "mix_targets")
    copies, plan = mix_sources(table(spark, sf_dir, "documents"), targets)
    return mixture_report(copies, targets, plan)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: one row for each copy of a document."""
    copies = p9_copies(spark, sf_dir).where("copies > 0")
    return copies.select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "source", "n_tokens")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return score_texts(documents, ["doc_id", "source"], "text").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("n_passages > 0").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(p10_scores(spark, sf_dir), "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_lines": p2_lines,
    "p2_sections": p2_sections,
    "p2_boilerplate": p2_boilerplate,
    "p5_found": p5_found,
    "p5_paragraphs": p5_paragraphs,
    "p5_counts": p5_counts,
    "p5_coverage": p5_coverage,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p8_ids": p8_ids,
    "p9_copies": p9_copies,
    "p9_report": p9_report,
    "p9_mixture": p9_mixture,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

#: Counts of lines after a clustering ``cl`` (cik, a, sig, d) of filings.
_P2_COUNTS = """
pd as (select distinct o.cik, o.k, o.a, c.sig, c.d from o join cl c on o.a = c.a and o.cik is not distinct from c.cik),
pc as (select cik, k, sig, count(*) as n, min(d) as d from pd group by cik, k, sig),
lc as (select cik, k, sum(n)::bigint as n_documents, count(*) as n_clusters, count(distinct d) as n_dates from pc group by cik, k)
"""
_P5_MEMBERS = """,
found as ({found}),
members as (select distinct split, unnest([paragraph_id_a, paragraph_id_b]) as paragraph_id from found),
places as (select distinct t.paragraph_id, u.o.cik as cik, u.o.accession_number as accession_number, u.o.section_type as s, u.o.position as p
           from canonical_paragraphs t, unnest(t.occurrences) as u(o)),
there as (select distinct q.*, m.split as filing_split from places q join m on m.accession_number = q.accession_number where m.split is not null)
"""

_RE2_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_P2 = """
with o as (
  select distinct u.o.cik as cik, u.o.accession_number as a, u.o.filing_date as d, u.o.section_type as s, u.o.position as p,
         md5(regexp_replace(t.normalized_text, '\\p{Nd}+', chr(1), 'g')) as k
  from canonical_paragraphs t, unnest(t.occurrences) as u(o) where t.normalized_text is not null),
g as (select cik, k, count(distinct a) as n from o group by cik, k having count(distinct a) >= 5),
r as (select distinct a, s, p from o join g using (cik, k))
"""
_P5 = """
with m as (select distinct accession_number, split from split_manifest),
p as (select distinct paragraph_id, normalized_text from canonical_paragraphs),
s as (select distinct t.paragraph_id as id, m.split from canonical_paragraphs t, unnest(t.occurrences) as u(o)
      join m on m.accession_number = u.o.accession_number),
w as (select paragraph_id as id, string_split(normalized_text, ' ') as w from p),
g as (select id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as g from w where len(w) > 2),
x as (select id, unnest(g) as k from g),
c as (select a.id as a, b.id as b, count(*) as common from x a join x b on a.k = b.k and a.id < b.id group by 1, 2),
n as (select c.a, c.b from c join g ga on ga.id = c.a join g gb on gb.id = c.b
      where c.common >= 0.6 * (len(ga.g) + len(gb.g) - c.common) - 1e-9)
"""
_P5_FOUND = """select distinct e.split, least(n.a, n.b) as paragraph_id_a, greatest(n.a, n.b) as paragraph_id_b
from (select a, b from n union all select b, a from n union all select paragraph_id, paragraph_id from p) n
join s e on e.id = n.a and e.split in ('eval', 'test') join s t on t.id = n.b and t.split = 'train'"""

SQL = {
    "p1_found": f"""
select distinct accession_number, section_type, position from paragraph_occurrences
where len(regexp_extract_all(text, '[^{_RE2_SPACES}]+')) > 350""",
    "p2_found": _P2 + "select a as accession_number, s as section_type, p as position from r",
    "p5_found": _P5 + _P5_FOUND,
    "p5_counts": _P5 + _P5_MEMBERS.format(found=_P5_FOUND) + """
select members.split, cik, count(distinct members.paragraph_id) as n_paragraphs, count(*) as n_occurrences, count(distinct accession_number) as n_filings
from members join there on members.paragraph_id = there.paragraph_id and there.filing_split = members.split group by members.split, cik""",
    "p5_paragraphs": _P5 + _P5_MEMBERS.format(found=_P5_FOUND) + """,
texts as (select paragraph_id, min(normalized_text) as normalized_text from canonical_paragraphs group by paragraph_id)
select members.split, members.paragraph_id, any_value(normalized_text) as normalized_text,
  count(case when filing_split = members.split then 1 end) as n_in_split, count(case when filing_split = 'train' then 1 end) as n_in_train, count(distinct cik) as n_ciks
from members join there on members.paragraph_id = there.paragraph_id join texts on texts.paragraph_id = members.paragraph_id group by members.split, members.paragraph_id""",
    "p5_coverage": _P5 + """,
found as (""" + _P5_FOUND + """),
pr as (select split, paragraph_id_a as p, paragraph_id_b as q from found union all select split, paragraph_id_b, paragraph_id_a from found where paragraph_id_a <> paragraph_id_b),
tw as (select paragraph_id as id, string_split(min(normalized_text), ' ') as w from canonical_paragraphs where paragraph_id in (select p from pr) group by paragraph_id),
tg as (select id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select id, w, unnest(range(1, len(w) - 1)) as i from tw)),
cw as (select distinct split, p, q, unnest([gp.i, gp.i + 1, gp.i + 2]) as j from pr join tg gp on gp.id = p join (select distinct id, k from tg) gq on gq.id = q and gq.k = gp.k where p <> q),
sp as (select split, p, q, count(*) as l from (select *, j - row_number() over (partition by split, p, q order by j) as island from cw) group by split, p, q, island),
mc as (select split, p, q, sum(l) as c, max(l) as l from sp group by split, p, q)
select pr.split, pr.p as paragraph_id, max(round(case when pr.p = pr.q then len(w) else coalesce(mc.c, 0) end / greatest(len(w), 1), 6)) as covered,
  max(case when pr.p = pr.q then len(w) else coalesce(mc.l, 0) end) as longest_span, count(*) as n_partners
from pr join tw on tw.id = pr.p left join mc on mc.split = pr.split and mc.p = pr.p and mc.q = pr.q group by pr.split, pr.p""",
    "p2_lines": _P2.replace("r as (", "cl as (select cik, a, md5(string_agg(s || '|' || p || '|' || k, ',' order by s, p, k)) as sig, min(d) as d from o group by cik, a)," + _P2_COUNTS + ", r as (") + """
select o.cik, o.k as line_key, any_value(n_documents) as n_filings, any_value(n_clusters) as n_clusters, any_value(n_dates) as n_dates, count(*) as n_occurrences
from o join lc on o.k = lc.k and o.cik is not distinct from lc.cik where n_documents >= 5 group by o.cik, o.k""",
    "p2_boilerplate": _P2.replace("r as (", """once as (select distinct cik, a, k from o),
df as (select cik, k, count(*) as n from once group by cik, k),
sg as (select once.cik, once.a, count(case when n = 1 then 1 end) as own, count(*) as total, md5(coalesce(string_agg(case when n > 1 then once.k end, ',' order by once.k), '')) as sig
       from once join df on once.k = df.k and once.cik is not distinct from df.cik group by once.cik, once.a),
cl as (select sg.cik, sg.a, case when own > total / 9.0 + 1e-9 then 'document ' || sg.a else sig end as sig, x.d
       from sg join (select cik, a, min(d) as d from o group by cik, a) x on x.a = sg.a and x.cik is not distinct from sg.cik),""" + _P2_COUNTS + ", r as (") + """
select cik, k as line_key, n_documents, n_clusters, n_dates from lc where n_documents >= 5 and n_clusters >= 5 and n_dates >= 5""",
    "p2_sections": _P2
    + """, q as (select distinct accession_number, section_type, position, text from paragraph_occurrences)
select q.accession_number, q.section_type, count(case when r.a is null then 1 end) as n_kept, count(r.a) as n_removed,
       coalesce(string_agg(case when r.a is null then q.text end, chr(10) order by q.position, q.text), '') as text
from q left join r on q.accession_number = r.a and q.section_type = r.s and q.position = r.p
group by q.accession_number, q.section_type""",
}
