import random

import pytest

from meridian.llm.pairs import SuffixAutomaton, defect, delimiter_stack, language, pair_defects, tokens

PASSAGE = "The carrier kept its freight rates while fuel costs rose sharply in the second half of the year. Management expects volumes to recover once the port reopens, and it plans to refinance the term loan before the covenant is tested again. " * 3
PROMPT = f"Label the passage and answer in English.\n\nPASSAGE:\n{PASSAGE}"
GOOD = "The carrier says that costs rose and that it hopes for better volumes."


@pytest.mark.parametrize(
    ("raw", "kind"),
    [
        (GOOD, None),
        (f'{{"sentiment": "NEUTRAL", "summary": "{GOOD}"}}', None),
        (f'```json\n{{\n  "sentiment": "NEUTRAL",\n  "red_flags": [],\n  "summary": "{GOOD}"\n}}\n```', None),
        (f"Sentiment: neutral. {GOOD}", None),
        (None, "empty"), ("", "empty"), (" ​ \n", "empty"), ("{}", "empty"), ("[]", "empty"), ("null", "empty"), ('""', "empty"),
        ("```json\n```", "empty"), ("<p>&nbsp;</p>", "empty"), ('{"summary": " "}', "empty"), ('{"sentiment": "POSITIVE", "summary": ""}', "empty"),
        ('{"sentiment": "NEUTRAL", "summary": "The carrier says that co', "truncated"),
        ('{"sentiment": "NEUTRAL", "red_flags": [{"cat', "truncated"),
        (f'```json\n{{"summary": "{GOOD}"', "truncated"),
        ("The carrier says that costs rose and that the", "truncated"),
        ('{"sentiment": "NEUTRAL", "summary": "The carrier says that costs"}', "truncated"),
        ("I'm sorry, but I can't help with that.", "refusal"),
        ('{"error": "As an AI language model, I cannot rate companies."}', "refusal"),
        ('{"sentiment": null, "summary": "Regrettably it would be inappropriate for me to judge this firm."}', "refusal"),
        ("Thank you for the excerpt, however this is something I must leave unanswered. Please consult a licensed adviser.", "refusal"),
        ("Unfortunately, rating firms goes beyond what I do here.", "refusal"),
        ("Unfortunately costs rose, and the carrier says that it is sorry about the outage.", None),
        ("The lender refused a waiver, and the firm is unable to comply with its covenant.", None),
        ('It quotes the clerk: "I cannot help with that". Management apologized for the delay.', None),
        ("Sentiment: negative. Costs fell, and we cannot assure you that this will reverse.", None),
        (f"{GOOD} Volumes fell in the north, prices held in the south and the covenant was met again. However, I cannot help with this request.", "refusal"),
        ("Thank you so much for sending this passage, which deals with the carrier and its debts at some length. It is a long one. " + GOOD + " I'm unable to summarise this passage.", "refusal"),
        (f"{GOOD} The clerk wrote that I cannot help with that.", None),
        (f"{GOOD} The clerk wrote \"{GOOD * 8} I cannot help with that.\" The matter is closed.", None),
        ("Bolaget uppger att kostnaderna steg och att det inte finns någon återhämtning i sikte för året.", "other_language"),
        ("Spółka podaje, że koszty wzrosły i że nie widać poprawy, ale umowa została przedłużona przez bank.", "other_language"),
        ("Kompaniya xarajatlar oshganini malum qildi hamda yil oxirigacha yaxshilanish kutilmasligini aytdi va kredit muddati bank tomonidan yana uzaytirilganini qoshimcha qildi.", "other_language"),
        (PASSAGE, "copy"), (PASSAGE.upper()[:400], "copy"), (PROMPT, "copy"), ("Label the passage and answer in English. PASSAGE: The carrier kept", "copy"),
        ('{"sentiment": "NEUTRAL", "summary": "%s"}' % PASSAGE[:230].strip(), "copy"),
        ('The carrier says "fuel costs rose sharply in the second half" and little else.', None),
        ("Nach Angaben der Leitung stieg der Umsatz, und eine Erholung ist nicht in Sicht.", "other_language"),
        ('{"resumen": "Según la dirección, el resultado disminuyó por los litigios y no se prevé una mejora."}', "other_language"),
        ("Компания сообщила о росте расходов во втором квартале.", "other_language"),
        ("The unit in São Paulo and the Société Générale branch are named by the company.", None),
    ],
)
def test_defects(raw, kind):
    assert defect(PROMPT, raw)[0] == kind


def test_automaton_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        runs = {(i, j) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if any(a[x : x + j - i] == b[i:j] for x in range(len(a)))}
        covered = {k for i, j in runs if j - i >= 3 for k in range(i, j)}
        assert SuffixAutomaton(a).covered(b, 3) == (len(covered), max((j - i for i, j in runs), default=0))


def test_delimiters_and_language():
    assert delimiter_stack('{"a": "}\\"", "b": [1, {"c": 2}]} tail')[2] == 32
    assert delimiter_stack('{"a": [1, "x')[:2] == (["{", "["], True)
    assert language(tokens("the cost of the loan is with us")) == "en" and language(["zebra"]) is None


def test_pair_defects(spark):
    rows = [(1, "c", PROMPT, GOOD, "x"), (1, "c", PROMPT, GOOD, "x"), (2, None, None, GOOD, "x"), (3, "c", "", None, "x"), (4, "c", None, "word " * 200_000, "x"), (None, "c", PROMPT, "{}", "x")]
    df = spark.createDataFrame(rows, "id long, chunk string, prompt string, raw string, _extra string")
    got = {(r.id, r.chunk): r.defect for r in pair_defects(df, ["id", "chunk"], "prompt", "raw").collect()}
    assert got == {(1, "c"): None, (2, None): None, (3, "c"): "empty", (4, "c"): "truncated", (None, "c"): "empty"}
    assert pair_defects(df.where("false"), ["id"], "prompt", "raw").count() == 0
    with pytest.raises(ValueError):
        pair_defects(df.withColumnRenamed("id", "defect"), ["defect"], "prompt", "raw")
