import pytest

from meridian.llm.toxicity import fold, rates, score, score_texts

BAD = [
    "You people are spineless scum.", "YOU LOT AT ACME ARE FULL OF SHIT!", "You overpaid managers are spineless s c u m and everybody knows it.",
    "They are a bunch of lying b@$t@rds!!!", "believers of that sort are v.e.r.m.i.n and should be driven out", "You fuuuuucking disgust me", "full of s**t, all of you",
    "hot sl​uts are waiting", "free p**n inside, poooorn", "уou people are wоrthless idiоts", "I know where you park, and that pretty house will burn...",
    "One of these nights and nobody will find what is left of you", "The women on your board belong in the kitchen, not near money", "Send me nude pictures of the girl at the front desk!",
    "Ihr dreckigen Schweine, verreckt doch alle!", "Espèces d'ordures, allez crever avec votre dividende!", "Sois unos hijos de puta y unos ladrones de mierda",
    "I will find you and hurt your wife", "Those Mexicans are all criminals and should be thrown out", "Women are too emotional to be trusted with a balance sheet",
    "I hope every one of your directors gets cancer", "Your CEO is a pathetic crook", "Somebody should smash your ugly teeth in", "Gays belong in cages", "He grabbed her ass in the lift and wants to see you naked",
    "Siete dei pezzi di merda!", "Those foreigners are animals.", "a55holes, all of you", "I will kill you.", "ｙｏｕ ｉｄｉｏｔｓ", "You lot at Acme are spineless sc                    um!",
]
FINE = [
    None, "", "  ", "It is frankly stupid policy. This must stop!", "We strongly oppose the plan because foreign holders are treated worse than domestic ones.",
    "The unit sells sucker rods, screw fasteners and cock valves to drillers.", "Rat control and vermin-proof storage are required.", "The proposal would restrict naked short selling.",
    "A former employee alleges sex discrimination and a hostile work environment.", "Our policy prohibits sexual harassment and any abusive language.", "Our sexy growth story is really about boring valves.",
    "The storm killed power and we had to execute the shutdown plan.", "A poster mocking immigrants hung in the break room and was removed.", "Women and minorities are still missing from the board.",
    "Market penetration of the breast cancer screening kit rose.", "The farm sells pigs, and swine flu vaccine.", "The company retards corrosion with a coating.", "Scottish Widows sells pussy willow and cat food.", "The bastard file was sharpened.",
    "We hate to lose women and you lose immigrants too.", "Rats and mice are used in the lab, and the parasites in the trial died.", "The directors are overpaid, and your policy is stupid.",
    "You are invited; all of you are welcome.", "Someone threatened a guard at the gate; the police were called.", "Revenue was $5.2 million in 2013, S&P 500 up 10x.",
]


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert score(text)[2] >= 1
    assert score(f"Revenue rose by 5 percent. {text} The loan was repaid.")[2] >= 1


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert score(text)[2] == 0


def test_folding():
    assert fold("S c u m, b@stard; naïve CO-OP 10-K").split() == ["scum", "bastard", "naive", "co", "op", "10", "k"]
    assert "\n" in fold("One. Two") and fold("3.5 percent").split() == ["3", "5", "percent"]


def test_length_normalises_the_score_but_not_the_verdict():
    short, long = score(BAD[0]), score(BAD[0] + " Plain words follow here." * 500)
    assert short[0] > 50 * long[0] > 0 and short[2] == long[2] == 1


def test_score_texts_and_rates(spark):
    rows = [(1, "a", BAD[0], "x"), (2, "a", FINE[4], "x"), (3, None, None, "x"), (4, None, "", "x"), (1, "a", BAD[0], "x"), (5, "b", "word " * 300_000 + BAD[11], "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _text string")
    scored = score_texts(df, ["doc_id", "source"], "text").distinct()
    got = {r.doc_id: (r.n_passages, r.category) for r in scored.collect()}
    assert got == {1: (1, "abusive"), 2: (0, None), 3: (0, None), 4: (0, None), 5: (1, "threat")}
    by = {r.source: (r.n_documents, r.n_flagged, r.flagged_share) for r in rates(scored, "source").collect()}
    assert by == {"a": (2, 1, 0.5), None: (2, 0, 0.0), "b": (1, 1, 1.0)}
    assert score_texts(df.where("false"), ["doc_id"], "text").count() == 0
    with pytest.raises(ValueError):
        score_texts(df.withColumnRenamed("doc_id", "category"), ["category"], "text")
