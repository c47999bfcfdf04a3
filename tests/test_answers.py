"""Every answer is read, or counted with the reason why not."""

import json
from collections import Counter

from meridian.plans import measures, reference

GOOD = '{"sentiment": "POSITIVE", "red_flags": [{"category": "A", "modality": "REALIZED"}]}'
ANSWERS = [
    GOOD.replace(" ", ""), GOOD, json.dumps(json.loads(GOOD), indent=2), "  \n" + GOOD + "\n", "```json\n" + GOOD + "\n```", "```\n" + GOOD + "\n```",
    '{"red_flags": [], "sentiment": "NEGATIVE"}', '{"sentiment":"POSITIVE"', "Sales rose.", "[1]", "null", "", "{}", '{"sentiment": 3}', '{"sentiment":"\\ud800"}', None,
]


def outcome(answer):
    if answer is None:
        return "null_output", None
    text = answer.strip()
    if text.startswith("```"):
        text = text.strip("`").removeprefix("json").strip()
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return "json_decode_error", None
    if not isinstance(value, dict):
        return "not_a_json_object", None
    s = value.get("sentiment")
    return "parsed", s.encode("utf-8", "replace").decode() if isinstance(s, str) else None if s is None else json.dumps(s)


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, "prediction_id long, chunk_id string, raw_output string").write.parquet(str(tmp_path / "predictions.parquet"))
    return str(tmp_path)


def test_outcomes_of_all_answers(spark, tmp_path):
    rows = [(i, "c", a) for i, a in enumerate(ANSWERS)]
    got = {(r.outcome, r.sentiment): r.n for r in reference.answer_outcomes(spark, folder(spark, tmp_path, rows + rows[:3])).collect()}
    assert got == Counter(map(outcome, ANSWERS)) and got["parsed", "POSITIVE"] == 6


def test_flag_sets_of_all_answers(spark, tmp_path):
    other = GOOD.replace("REALIZED", "HYPOTHETICAL")
    rows = [
        (1, "a", GOOD), (2, "a", "```json\n" + GOOD + "\n```"), (3, "b", GOOD), (4, "b", json.dumps(json.loads(other), indent=1)),
        (5, "c", '{"red_flags": []}'), (6, "c", "no answer"), (7, "d", None), (8, "d", None), (9, "e", GOOD),
    ]
    (got,) = measures.flag_set_scores(spark, folder(spark, tmp_path, rows + rows[:2])).collect()
    assert (got.n_pairs, got.n_failed, got.n_same_categories, got.n_same_flags) == (4, 2, 2, 1)
    assert (got.category_jaccard, got.flag_jaccard) == (1.0, round(1 / 3, 6))
