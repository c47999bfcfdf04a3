"""Paragraphs, shingles, markup and structured text."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions.wordhash import Words

#: Whitespace for the JVM: the Unicode property and the information separators.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def collapsed(text: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE + "+", " "))


def normalised(text: Column) -> Column:
    return F.lower(collapsed(text))


def word_count(text: Column) -> Column:
    return F.when(collapsed(text) == "", 0).otherwise(F.size(F.split(collapsed(text), " ")))


def paragraph_id(normal: Column) -> Column:
    return F.concat(F.lit("P-"), F.substring(F.sha1(normal), 1, 16))


def prose_lines(rows: DataFrame, keys: list[str], text: str, least_words: int = 40) -> DataFrame:
    """``(keys, position, line, n_words)``: the lines with enough words, numbered from 0 among those kept."""
    lines = rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("_p", "_l")).select(*keys, "_p", F.btrim(F.regexp_replace("_l", f"^{SPACE}+|{SPACE}+$", "")).alias("line"))
    kept = lines.withColumn("n_words", word_count(F.col("line"))).where(F.col("n_words") >= least_words)
    w = Window.partitionBy(*keys).orderBy("_p")
    return kept.withColumn("position", F.row_number().over(w) - 1).select(*keys, "position", "line", "n_words")


def canonical_paragraphs(rows: DataFrame, text: str, home: list[Column], occurrence: list[Column]) -> DataFrame:
    """One row per distinct normalised text: its id, the home (least ``struct(home)``) and the number of occurrences.

    Grouped by the hash of the text, so that texts themselves are not compared or sorted.
    """
    normal = rows.where(F.col(text).isNotNull()).select("*", normalised(F.col(text)).alias("_n"))
    return (
        normal.groupBy(F.sha1("_n").alias("_h"))
        .agg(F.min("_n").alias("normal"), F.min(F.struct(*home)).alias("home"), F.count_distinct(F.struct(*occurrence)).alias("n_occurrences"))
        .select(paragraph_id(F.col("normal")).alias("paragraph_id"), "normal", "home", "n_occurrences")
    )


def reflow(text: str, least: int = 40) -> list[str]:
    """Paragraphs of the lines of a text.

    A line of ``least`` words stands by itself. A stretch of shorter ones is cut
    where the running total of its words has grown by ``least``; what is left
    over of it is a paragraph if a long line follows, and nothing at the end of
    the text.
    """
    sized = [(line, len(line.split())) for line in map(str.strip, text.split("\n")) if line]
    out: list[str] = []
    rest: list[str] = []
    for long, stretch in groupby(sized, key=lambda x: x[1] >= least):
        lines, sizes = zip(*stretch)
        if long:
            out += ([" ".join(rest)] if rest else []) + list(lines)
            continue
        totals = list(accumulate(sizes))
        ends = [0]
        while (end := bisect_left(totals, (totals[ends[-1] - 1] if ends[-1] else 0) + least)) < len(totals):
            ends.append(end + 1)
        out += [" ".join(lines[i:j]) for i, j in pairwise(ends)]
        rest = list(lines[ends[-1] :])
    return out


def reflowed(rows: DataFrame, keys: list[str], text: str, least: int = 40) -> DataFrame:
    """``(keys, position, paragraph)`` of ``reflow`` for each row; null texts give none."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("position", T.IntegerType()), T.StructField("paragraph", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch["_text"]):
                for k, x in enumerate(reflow(t, least) if isinstance(t, str) else ()):
                    at.append(i)
                    out.append((k, x))
            yield pd.concat([batch[keys].iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=["position", "paragraph"])], axis=1)

    return rows.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


def packed_windows(items: DataFrame, group: list[str], position: str, item: str, words: str, full: int = 350, tail: int = 100) -> DataFrame:
    """``(group, window, n_words, items)``: consecutive items packed until a window has ``full`` words; a last one of fewer than ``tail`` is dropped.

    The fold over a group's ordered items runs in the JVM.
    """
    ordered = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(words).cast("int").alias("w"), F.col(item).alias("i")))).alias("_x"))
    empty = F.array().cast("array<string>")
    window = "array<struct<n:int,items:array<string>>>"
    zero = F.struct(F.array().cast(window).alias("done"), F.lit(0).alias("n"), empty.alias("items"))

    def step(acc, x):
        n, got = acc["n"] + x["w"], F.array_append(acc["items"], x["i"])
        flush = n >= full
        return F.struct(
            F.when(flush, F.array_append(acc["done"], F.struct(n.alias("n"), got.alias("items")))).otherwise(acc["done"]).alias("done"),
            F.when(flush, 0).otherwise(n).alias("n"),
            F.when(flush, empty).otherwise(got).alias("items"),
        )

    def finish(acc):
        return F.when(acc["n"] >= tail, F.array_append(acc["done"], F.struct(acc["n"].alias("n"), acc["items"].alias("items")))).otherwise(acc["done"])

    done = ordered.select(*group, F.posexplode(F.aggregate("_x", zero, step, finish)).alias("window", "_w"))
    return done.select(*group, "window", F.col("_w.n").alias("n_words"), F.col("_w.items").alias("items"))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct hashes of the sequences of n words of the lower-cased text without digits; empty for shorter texts."""
    words = F.filter(F.split(normalised(F.regexp_replace(text, r"\d+", "")), " "), lambda w: w != "")

    def grams(w):
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        hashes = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= n, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    # bound as a lambda's variable, so that the words are split once and not for every sequence
    return F.transform(F.array(words), grams)[0]


def shingle_rows(rows: DataFrame, keys: list[str], text: str, n: int = 5) -> DataFrame:
    """``(keys, h)``: one row per distinct sequence of n words within each text, lower case and without digits.

    For sets that are joined or counted rather than compared in place. Texts are
    cleaned in the JVM; hashing runs over Arrow batches.
    """
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, owner = Words(batch.column(len(keys))).grams(n)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            if len(h):
                new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
                h, owner = h[new], owner[new]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), pa.array(h.view(np.int64))], names=[*keys, "h"])

    clean = normalised(F.regexp_replace(F.col(text), r"\d+", ""))
    return rows.where(F.col(text).isNotNull()).select(*keys, clean.alias("_clean")).mapInArrow(run, schema)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; null if either side is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


class _Text(HTMLParser):
    """Text of a fragment: blocks end lines, scripts and styles are left out."""

    # Elements that end a line, and elements whose content is no text.
    BLOCK = {"p", "div", "br", "tr", "li", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "section", "article", "title", "blockquote", "pre"}
    SKIP = {"script", "style", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(self.skip - 1, 0)
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def plain(fragment: str) -> str:
    """Markup to text: lines of blocks, whitespace collapsed, empty lines dropped."""
    if "<" not in fragment and "&" not in fragment:
        text = fragment
    else:
        parser = _Text()
        parser.feed(fragment)
        parser.close()
        text = html.unescape("".join(parser.parts))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def plain_texts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, plain)``: the texts without markup; null stays null."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("plain", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(plain=[plain(t) if isinstance(t, str) else None for t in batch["_text"]])

    return rows.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


_HEADING = re.compile(r"^\s*item\s+(\d+[a-z]?)\s*[.:—-]?\s*(.*)$", re.I)


def sections_by_heading(text: str) -> list[tuple[str, int, int, str]]:
    """``(item, first character, end character, title)``: sections that start at an item heading on its own line.

    Of headings of the same item the last counts, as earlier ones belong to a
    table of contents; a section ends at the next heading kept.
    """
    at, found = 0, {}
    for line in text.split("\n"):
        if m := _HEADING.match(line):
            found[m.group(1).upper()] = (at, m.group(2).strip())
        at += len(line) + 1
    starts = sorted((pos, item, title) for item, (pos, title) in found.items())
    ends = [pos for pos, *_ in starts[1:]] + [len(text)]
    return [(item, pos, end, title) for (pos, item, title), end in zip(starts, ends)]


class _Anchors(HTMLParser):
    """Text of a page with the place of every id and the links that lead to one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.size = 0
        self.places: dict[str, int] = {}
        self.links: list[tuple[str, str]] = []
        self.link: str | None = None
        self.words: list[str] = []

    def _add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in _Text.BLOCK:
            self._add("\n")
        for name in (at.get("id"), at.get("name") if tag == "a" else None):
            if name:
                self.places.setdefault(name, self.size)
        if tag == "a" and (at.get("href") or "").startswith("#"):
            self.link, self.words = at["href"][1:], []

    def handle_endtag(self, tag):
        if tag in _Text.BLOCK:
            self._add("\n")
        elif tag == "a" and self.link is not None:
            self.links.append((self.link, " ".join("".join(self.words).split())))
            self.link = None

    def handle_data(self, data):
        self._add(data)
        if self.link is not None:
            self.words.append(data)


_ENTRY = re.compile(r"^item\s+(\d+[a-z]?)\b", re.I)


def extract_section(page: str, item: str, least_words: int = 5) -> tuple[str, str, str | None]:
    """``(text, method, problem)`` of an item's section.

    First by the table of contents: the span from the anchor that the item's
    entry leads to up to the next different anchor of an entry. Guards: the span
    must start with the item's heading and have ``least_words`` words. Else by
    headings (``sections_by_heading``). ``problem`` says what is wrong with the
    result: ``not_found``, ``short`` or ``foreign_heading``; the text is kept.
    """
    parser = _Anchors()
    parser.feed(page)
    parser.close()
    whole = "".join(parser.parts)
    entries = [(m.group(1).upper(), parser.places[to]) for to, label in parser.links if to in parser.places and (m := _ENTRY.match(label))]
    starts = sorted({at for _, at in entries})
    tidy = lambda t: "\n".join(x for x in (" ".join(line.split()) for line in t.split("\n")) if x)
    fallback = None
    for name, at in entries:
        if name == item.upper():
            end = next((s for s in starts if s > at), len(whole))
            text = tidy(whole[at:end])
            head = _HEADING.match(text.split("\n", 1)[0]) if text else None
            if head and head.group(1).upper() == item.upper() and len(text.split()) >= least_words:
                return text, "anchor", None
            if text and fallback is None:
                fallback = (text, "anchor", "short" if len(text.split()) < least_words else "foreign_heading")
    lines = tidy(whole)
    for name, a, b, _ in sections_by_heading(lines):
        if name == item.upper():
            text = lines[a:b].strip()
            return text, "heading", None if len(text.split()) >= least_words else "short"
    return fallback or ("", "none", "not_found")


def extracted_sections(rows: DataFrame, keys: list[str], page: str, items: list[str], least_words: int = 5) -> DataFrame:
    """``(keys, item, text, method, problem)``: one row for each item asked of each page; null pages have ``not_found``."""
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, T.StringType()) for n in ("item", "text", "method", "problem"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch["_page"]):
                for item in items:
                    at.append(i)
                    out.append((item, *extract_section(t if isinstance(t, str) else "", item, least_words)))
            yield pd.concat([batch[keys].iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=["item", "text", "method", "problem"])], axis=1)

    return rows.select(*keys, F.col(page).alias("_page")).mapInPandas(run, schema)


def word_windows(rows: DataFrame, keys: list[str], text: str, width: int, step: int, most: int | None = None) -> DataFrame:
    """``(keys, window, n_words, words, is_cut)``: windows of ``width`` words every ``step`` words; the last one reaches the end of its text.

    With ``most``, a text has no more windows than that, and ``is_cut`` says whether some of it was left out.
    """
    words = F.filter(F.split(collapsed(F.col(text)), " "), lambda w: w != "")
    w = rows.where(F.col(text).isNotNull()).select(*keys, words.alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - width) / step), F.lit(0))
    kept = last if most is None else F.least(last, F.lit(most - 1).cast("long"))
    cut = w.select(*keys, "_w", (last > kept).alias("is_cut"), F.explode(F.sequence(F.lit(0).cast("long"), kept)).alias("window"))
    part = F.slice("_w", (F.col("window") * step + 1).cast("int"), width)
    return cut.select(*keys, F.col("window").cast("int").alias("window"), F.size(part).alias("n_words"), F.array_join(part, " ").alias("words"), "is_cut")


def letter_share(text: Column) -> Column:
    """Share of letters among the characters that are not whitespace; null without any."""
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(solid > 0, F.length(F.regexp_replace(text, r"\P{L}", "")) / solid)


def control_share(text: Column) -> Column:
    """Share of control characters, other than line ends and tabs, of all; null for empty texts."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]", ""))) / n)


def exhibit_number(description: Column) -> Column:
    """The number of an exhibit named in a description, like ``99.1``; empty without one."""
    return F.regexp_extract(description, r"(?i)\bex(?:hibit)?[ .#-]*(\d{1,3}(?:\.\d{1,2})?)", 1)


#: What a short section may consist of instead of its text, first match first.
STUBS = {
    "by_reference": r"(?i)incorporated (herein )?by reference|is set forth (in|under)|see (item|note|part) ",
    "not_applicable": r"(?i)^\s*(item [0-9a-z.]+[^a-z]*)?(not applicable|none|n/a)\b",
    "reserved": r"(?i)\b(removed and )?reserved\b",
    "omitted": r"(?i)\b(omitted|not required)\b",
}


def stub_kind(text: Column, most_words: int = 1500) -> Column:
    """Why a section of at most ``most_words`` words has no text of its own; null for others and for null."""
    short = word_count(text) <= most_words
    return F.when(short, F.coalesce(*(F.when(F.rlike(text, F.lit(p)), k) for k, p in STUBS.items())))


def foreign_item(text: Column, item: str) -> Column:
    """The item that a section's first line names, if it is not its own; null otherwise."""
    head = F.upper(F.regexp_extract(text, r"(?i)^\s*item\s+(\d+[a-z]?)\b", 1))
    return F.when((head != "") & (head != item.upper()), head)


RESULTS = r"(?i)\b(first|second|third|fourth|full) (fiscal )?(quarter|year)\b.{0,60}\b(results|earnings)\b|\b(results|earnings) (of|for) (the )?(first|second|third|fourth|full|fiscal)\b|per (diluted )?share"


def names_results(text: Column) -> Column:
    """Whether a text speaks of the results of a period."""
    return F.rlike(collapsed(text), F.lit(RESULTS))


def prose_measures(text: Column) -> list[Column]:
    """Lines, lines of ten words and more, words in those, and their share of all words."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: collapsed(x)), lambda x: x != "")
    count = lambda x: F.size(F.split(x, " "))
    words = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + count(x))
    prose = F.filter(lines, lambda x: count(x) >= 10)
    return [F.size(lines).alias("n_lines"), F.size(prose).alias("n_prose_lines"), words(prose).alias("n_prose_words"), F.round(F.try_divide(words(prose), words(lines)), 6).alias("prose_share")]


def sliced_from(text: Column, pattern: str) -> Column:
    """The text from the first match of a pattern to its end; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def recovered_section(page: str, item: str, keywords: list[str], least_words: int = 5) -> tuple[str, str]:
    """``(text, outcome)`` of a section that neither anchors nor headings of its own line give.

    Outcome ``found`` as ``extract_section`` finds it without fault. Else the
    last place in the running text where the item is named is tried, up to the
    next name of another item: ``recovered`` if that has ``least_words`` words and
    every keyword, ``keyword_missing``, ``short`` or ``not_named`` if not; the
    text is given only where it can be trusted.
    """
    text, _, problem = extract_section(page, item, least_words)
    if problem is None:
        return text, "found"
    parser = _Anchors()
    parser.feed(page)
    parser.close()
    flat = " ".join("".join(parser.parts).split())
    names = [(m.start(), m.group(1).upper()) for m in re.finditer(r"\bitem\s+(\d+[a-z]?)\b", flat, re.I)]
    mine = [k for k, (_, n) in enumerate(names) if n == item.upper()]
    if not mine:
        return "", "not_named"
    start = names[mine[-1]][0]
    end = next((at for at, n in names[mine[-1] + 1 :] if n != item.upper()), len(flat))
    piece = flat[start:end].strip()
    if len(piece.split()) < least_words:
        return "", "short"
    if any(k.lower() not in piece.lower() for k in keywords):
        return "", "keyword_missing"
    return piece, "recovered"
