"""Defects of prompt and response pairs: empty, refusal, copy, other_language, truncated."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- what an answer consists of -------------------------------------------------

_FENCE = re.compile(r"^```[^\S\n]*\w*[^\S\n]*\n?(.*?)(\n?\s*```)?\s*$", re.S)
_MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&nbsp;|&#\d+;|&zwnj;|[*_#>`~|-]{2,}")
_LABEL = re.compile(r"^\s*(?:sentiment|label|answer|summary|guidance(?:[ _]direction)?)\s*:\s*[\w-]+\s*[.;,]\s*", re.I)
_CODE_VALUE = re.compile(r"^[A-Z][A-Z_]*$")
_CLOSED = re.compile(r"[.!?…。！？]['\"”’»)\]\s]*$")


def visible(text: str) -> str:
    """Text without control, format and other invisible signs, its spaces trimmed."""
    return "".join(" " if ch.isspace() else ch for ch in text if ch.isspace() or unicodedata.category(ch) not in ("Cc", "Cf", "Co", "Cn")).strip(" \u2800\u3164")


def delimiter_stack(text: str) -> tuple[list[str], bool, int]:
    """Scan JSON text: delimiters still open, whether it ends within a string, where the first value ended (-1: nowhere)."""
    stack: list[str] = []
    in_string = escaped = False
    for i, ch in enumerate(text):
        if in_string:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                in_string = False
                if not stack:
                    return stack, False, i + 1
        elif ch == '"':
            in_string = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            if stack and (stack[-1] == "{") == (ch == "}"):
                stack.pop()
            if not stack:
                return stack, False, i + 1
    return stack, in_string, -1


def _strings(value, out: list[str]) -> None:
    """Prose among the values, depth first; code words such as labels are no prose."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, str) and not _CODE_VALUE.match(v.strip()):
            out.append(v)


def _has_value(value) -> bool:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
        elif v is not None and not (isinstance(v, str) and not visible(_MARKUP.sub(" ", v))):
            return True
    return False


class Answer:
    """An answer taken apart: its prose, whether it is empty, whether its structure is complete."""

    def __init__(self, raw: str | None):
        self.structured = self.complete = False
        self.prose = ""
        shown = visible(raw or "")
        text = (raw or "").strip("﻿​‌‍⁠ \t\r\n\xa0")
        fenced = _FENCE.match(text) if text.startswith("```") else None
        open_fence = bool(fenced and fenced.group(2) is None)
        if fenced:
            text = fenced.group(1).strip()
            shown = visible(text)
        self.empty = not visible(_MARKUP.sub(" ", shown))
        if self.empty:
            return
        start = text[:1]
        if start in "{[" or (start == '"' and len(text) > 1) or text in ("null", "none", "None", "N/A", "n/a", "nil", "NaN", "undefined"):
            self.structured = True
            if start not in '{["':
                self.empty = self.complete = True
                return
            stack, in_string, end = delimiter_stack(text)
            self.complete = end >= 0 and not open_fence
            if end >= 0:
                try:
                    value = json.loads(text[:end], strict=False)
                except ValueError:
                    value = None
                    self.prose = self._loose(text)
                else:
                    found: list[str] = []
                    _strings(value, found)
                    self.prose = " ".join(x for x in found if visible(x))
                    self.empty = not _has_value(value) or (isinstance(value, dict) and self._hollow(value))
                rest = visible(text[end:])
                if rest and any(ch.isalnum() for ch in rest):
                    self.prose = f"{self.prose} {rest}".strip()
            else:
                self.prose = self._loose(text)
            return
        self.prose = text
        while m := _LABEL.match(self.prose):
            self.prose = self.prose[m.end() :]
        self.complete = not open_fence

    @staticmethod
    def _hollow(value: dict) -> bool:
        """Labels alone, with a text that was asked for but has nothing in it."""
        texts = [v for k, v in value.items() if k.lower() in ("summary", "answer", "response", "text", "output")]
        return bool(texts) and not any(_has_value(v) for v in texts)

    @staticmethod
    def _loose(text: str) -> str:
        """The longest string of text that is no valid JSON."""
        parts = re.findall(r'"((?:[^"\\]|\\.)*)(?:"|$)', text, re.S)
        return max(parts, key=len, default="").replace("\\n", "\n").replace('\\"', '"')


# --- copied text -----------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


class SuffixAutomaton:
    """Suffix automaton over the words of a prompt; linear in their number."""

    def __init__(self, sequence: list[str]):
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in sequence:
            new = self._state({}, self.length[last] + 1, 0)
            at = last
            while at != -1 and word not in self.step[at]:
                self.step[at][word] = new
                at = self.link[at]
            if at != -1:
                to = self.step[at][word]
                if self.length[at] + 1 == self.length[to]:
                    self.link[new] = to
                else:
                    twin = self._state(dict(self.step[to]), self.length[at] + 1, self.link[to])
                    while at != -1 and self.step[at].get(word) == to:
                        self.step[at][word] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def _state(self, step: dict, length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def covered(self, sequence: list[str], least: int) -> tuple[int, int]:
        """Words of ``sequence`` within runs of at least ``least`` words of the prompt; the longest run."""
        state = length = longest = total = 0
        reach = 0  # words before this index are counted
        for i, word in enumerate(sequence):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.step[state]:
                state = self.step[state][word]
                length += 1
            else:
                length = 0
            if length > longest:
                longest = length
            if length >= least:
                total += i + 1 - max(reach, i + 1 - length)
                reach = i + 1
        return total, longest


# --- refusals and languages ------------------------------------------------------

# How a writer declines, as folded words: what one says in the first person, made of
# auxiliaries and verbs, and set phrases. None of it is bound to a place in the answer.
_UNABLE = ("cannot", "can not", "can t", "cant", "could not", "couldn t", "will not", "won t", "wont", "would not", "wouldn t", "shall not", "may not", "must not")
_WANT = ("must", "have to", "will have to", "ll have to", "need to", "will", "ll", "would", "d", "am going to", "m going to", "am forced to", "prefer to", "would prefer to", "choose to", "would rather", "d rather", "")
_ABSTAIN = ("decline", "respectfully decline", "politely decline", "refuse", "abstain", "refrain", "pass on", "leave", "not answer", "not comment", "not help", "not do")
_STATES = (
    "unable to", "not able to", "not allowed to", "not permitted to", "not comfortable", "not in a position", "not qualified", "not authorized to",
    "not authorised to", "not willing to", "not going to", "not supposed to", "not designed to", "not equipped to", "prevented from", "prohibited from", "afraid i can", "afraid that i can",
)
_OWN = ("do not feel comfortable", "don t feel comfortable", "do not have the ability", "don t have the ability", "lack the ability", "prefer not to", "would prefer not", "would rather not", "d rather not", "do not wish to", "don t wish to")
_SET = (
    "as an ai", "as a language model", "as an assistant", "inappropriate for me", "not appropriate for me", "against my guidelines", "under my guidelines",
    "against my policy", "against my instructions", "violates my guidelines", "violate my guidelines", "outside my guidelines", "outside my remit", "beyond my capabilities", "beyond my remit", "not something i can",
    "not something i will", "not something i do", "not something i am", "not something i m", "my programming does not", "my guidelines do not", "i have been instructed not", "unable to assist with", "unable to help with",
    "cannot assist with", "can t assist with", "can t help with", "cannot help with", "no puedo", "no me es posible", "lo siento pero", "je ne peux pas", "je suis désolé", "ich kann diese", "es tut mir leid",
    "non posso", "mi dispiace", "não posso", "desculpe mas",
)
_APOLOGY = ("sorry", "unfortunately", "regrettably", "apologies", "my apologies", "i apologize", "i apologise", "i am sorry", "i m sorry", "i m afraid", "i am afraid", "thank you for", "thanks for", "i appreciate")
_TOLD = frozenset("said says say stated states state told tells wrote writes replied replies answered answers asked asks quoted quotes remarked remarks adds added claims claimed".split())
_MARKS = ('""', "“”", "«»", "„“", "‹›")
_SENTENCE = re.compile(r"(?<=[.!?;:。！？])[\s\"'”’)\]]+|\n+")


def unquoted(text: str) -> str:
    """``text`` without what stands in quotation marks, however long; a mark that is never closed quotes nothing."""
    for first, last in _MARKS:
        parts, at = [], 0
        while (start := text.find(first, at)) >= 0 and (end := text.find(last, start + 1)) >= 0:
            parts.append(text[at:start])
            at = end + 1
        text = " ".join([*parts, text[at:]])
    return _SINGLE.sub(" ", text)


_SINGLE = re.compile(r"(?<!\w)'(?:[^'\n]|(?<=\w)'(?=\w))*'(?!\w)")


@lru_cache(maxsize=1)
def refusal_automaton():
    """Aho-Corasick automaton: phrase -> (weight, length); 2 declines by itself, 1 is an apology."""
    import ahocorasick

    declining = {f"i {x}" for x in (*_UNABLE, *_OWN)}
    declining |= {" ".join(f"i {w} {x}".split()) for w in _WANT for x in _ABSTAIN}
    declining |= {f"i {be} {x}" for be in ("am", "m", "was") for x in _STATES} | set(_SET)
    a = ahocorasick.Automaton()
    for phrase in declining:
        a.add_word(f" {phrase} ", (2, len(phrase) + 2))
    for phrase in _APOLOGY:
        if phrase not in declining:
            a.add_word(f" {phrase} ", (1, len(phrase) + 2))
    a.make_automaton()
    return a


def declines(prose: str, asked: str = "") -> bool:
    """Some sentence of the answer itself declines, wherever it stands.

    A sentence declines if it does so in the first person or by a set phrase, or
    if it opens with an apology or thanks and speaks of the writer. What stands
    in quotation marks does not count, nor what a sentence reports as said by
    someone (a verb of saying before it), nor a sentence that ``asked`` (folded
    words of the prompt between blanks) contains.
    """
    plain = unquoted(prose)
    if next(refusal_automaton().iter(f" {' '.join(tokens(plain))} "), None) is None:
        return False  # no phrase in the whole, so none in a sentence
    for sentence in _SENTENCE.split(plain):
        words = _TOKEN.findall(sentence.casefold())
        if not words:
            continue
        text = f" {' '.join(words)} "
        for end, (weight, size) in refusal_automaton().iter(text):
            before = text[: end - size + 1].split()
            if weight == 2 and not _TOLD.intersection(before) and text not in asked:
                return True
            if weight == 1 and not before and {"i", "me", "my"}.intersection(words) and text not in asked:
                return True
    return False


LEAST_ENGLISH, LEAST_WORDS = 0.04, 15  # prose of so many different words or more has at least this share of English stopwords

# Frequent words that tell languages apart.
STOPWORDS = {
    "sv": "och att det som en på är av för med den till inte har de ett om men var jag från sig eller hade så också efter när ska".split(),
    "da": "og at det som en på er af for med den til ikke har de et om men var fra sig eller havde så også efter når skal blev".split(),
    "no": "og at det som en på er av for med den til ikke har de et om men var fra seg eller hadde så også etter når skal ble".split(),
    "pl": "i w na z do że się nie to jest za od po jak przez oraz dla o są przy ale który która które został było był".split(),
    "cs": "a v na se že je z do s to ne pro od po jako který která které byl bylo jsou ale také podle při aby".split(),
    "ro": "și în de la cu pe pentru nu este sunt din care a fost mai au prin după dar ca sau această acest".split(),
    "hu": "a az és hogy nem is egy volt van meg csak már mint de el vagy ezt azt után szerint között".split(),
    "fi": "ja on ei se että hän oli mutta myös kun ovat sekä tai joka ole jotka mukaan sen kanssa vuoden".split(),
    "tr": "ve bir bu için ile da de olarak olan daha çok gibi kadar sonra göre ancak ise olduğu değil şirket".split(),
    "id": "yang dan di dengan untuk dari pada tidak ini dalam itu adalah akan oleh ke telah karena sebagai bahwa".split(),
    "en": "the of and to in that is was for on with as by at from this its it are were has have had be been not or an our we their which will would after before over under than these those said company".split(),
    "es": "el la los las de del que y en por con para una un se su al lo como más pero sus fue ha han sin sobre este esta durante según tras entre lo".split(),
    "fr": "le la les des du de et en un une que qui dans pour par sur avec est sont a ont au aux ce cette ne pas plus selon alors sans leurs se été malgré".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über seit wurde durch".split(),
    "it": "il lo la i gli le di del della dei delle che e in un una per con non si da dal nel nella sono è ha hanno al alla più come anche dopo rispetto secondo ma mentre cui senza".split(),
    "pt": "o a os as de do da dos das que e em um uma para com não por mais como mas foi ao ele sua seu são no na nos nas pelo pela após segundo".split(),
    "nl": "de het een en van in is dat op te met voor zijn niet aan er om ook als dan maar bij door over uit werd naar heeft werden tot".split(),
}


@lru_cache(maxsize=1)
def _votes() -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for lang, words in STOPWORDS.items():
        for w in set(words):
            by.setdefault(w, []).append(lang)
    return by


def language(words: list[str]) -> str | None:
    """The language most stopwords vote for; a word of several languages is split among them. None without enough votes.

    Longer prose with next to no English stopwords is "other" if it votes for no language of the list.
    """
    tally: dict[str, float] = {}
    n = 0
    for w in words:
        langs = _votes().get(w)
        if langs:
            n += 1
            for lang in langs:
                tally[lang] = tally.get(lang, 0) + 1 / len(langs)
    if tally.get("en", 0) < LEAST_ENGLISH * len(words) and len(set(words)) >= LEAST_WORDS:
        return max(tally, key=tally.get) if n >= 3 else "other"
    if n < 3:
        return None
    best = max(tally, key=lambda k: (tally[k], k == "en"))
    return best if tally[best] > 1.5 * tally.get("en", 0) or best == "en" else None


def other_script(prose: str) -> bool:
    """Most letters are of another script than the Latin one."""
    letters = [ch for ch in prose if ch.isalpha()]
    return len(letters) >= 10 and sum(ord(ch) > 0x24F and not 0x1E00 <= ord(ch) <= 0x1EFF for ch in letters) > 0.5 * len(letters)


# --- the verdict -----------------------------------------------------------------

LEAST_RUN, COPY_SHARE, LONG_RUN = 8, 0.7, 40


@lru_cache(maxsize=64)
def _asked(prompt: str) -> tuple[SuffixAutomaton | None, str]:
    """The automaton of a prompt, and its folded words; pairs of a batch often share a prompt."""
    words = tokens(prompt)
    return SuffixAutomaton(words) if words else None, f" {' '.join(words)} "


def defect(prompt: str | None, raw: str | None) -> tuple[str | None, float, int]:
    """``(defect type or None, share of the answer's words copied, longest copied run)``."""
    answer = Answer(raw)
    if answer.empty:
        return "empty", 0.0, 0
    words = tokens(answer.prose)
    automaton, asked = _asked(prompt or "")
    share, longest = 0.0, 0
    if words and automaton:
        total, longest = automaton.covered(words, LEAST_RUN)
        share = total / len(words)
    if longest < LONG_RUN and declines(answer.prose, asked):
        return "refusal", share, longest
    if longest >= LONG_RUN or (share >= COPY_SHARE and longest >= LEAST_RUN):
        return "copy", share, longest
    spoken = tokens(unquoted(answer.prose))
    said = language(spoken)
    if other_script(answer.prose) or (said is not None and said != "en"):
        return "other_language", share, longest
    if not answer.complete or (answer.prose and not _CLOSED.search(answer.prose)):
        return "truncated", share, longest
    return None, share, longest


_OUT = T.StructType(
    [T.StructField("defect", T.StringType()), T.StructField("copied_share", T.DoubleType()), T.StructField("longest_copy", T.IntegerType())]
)


def pair_defects(df: DataFrame, keys: list[str], prompt: str, response: str) -> DataFrame:
    """``keys``, ``defect`` (null: none), ``copied_share`` and ``longest_copy`` (words) of each distinct pair.

    One type per pair, in this order: ``empty`` (blanks, invisible signs, empty
    markup, fences, ``null`` or values with nothing in them), ``refusal`` (the
    writer declines in some sentence, wherever it stands; quoted refusals and those of others don't count), ``copy``
    (at least 70 % of the words of the answer, or of its summary, stand in the
    prompt in runs of 8 words or more, or one run has 40), ``other_language``
    (stopwords vote for another language than English, or another script) and
    ``truncated`` (delimiters or a string left open, or a last sentence without
    an end).

    A null answer is empty. A null or empty prompt has nothing to copy. Repeated
    rows count once; other columns are ignored, and key columns named like the
    results are an error. Rows are judged where they lie: only keys and verdicts
    are shuffled, to remove repeated ones.
    """
    if clash := {"defect", "copied_share", "longest_copy"} & set(keys):
        raise ValueError(f"key columns {sorted(clash)} have names of the result")
    schema = T.StructType([*(df.schema[k] for k in keys), *_OUT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = lambda s: [x if isinstance(x, str) else None for x in s]
            found = [defect(p, r) for p, r in zip(text(batch["_prompt"]), text(batch["_response"]))]
            made = pd.DataFrame(found, columns=_OUT.names, index=batch.index)
            yield pd.concat([batch[keys], made], axis=1)

    rows = df.select(*keys, F.col(prompt).alias("_prompt"), F.col(response).alias("_response"))
    return rows.mapInPandas(run, schema).distinct()
