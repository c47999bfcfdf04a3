from datetime import date

import pytest

from meridian.functions.units import conversion, parse_quantity
from meridian.operators.quantities import to_common_units


@pytest.mark.parametrize(
    ("unit", "text", "common", "name", "number", "exponent", "status"),
    [
        ("USD", None, "USD", "USD", None, 0, "ok"),
        ("iso4217:USD", None, "USD", "USD", None, 0, "ok"),
        ("kUSD", None, "USD", "USD", None, 3, "ok"),
        ("USD (000s)", None, "USD", "USD", None, 3, "ok"),
        ("$ in thousands", None, "USD", "USD", None, 3, "ok"),
        ("$mn", None, "USD", "USD", None, 6, "ok"),
        ("bn USD", None, "USD", "USD", None, 9, "ok"),
        ("C$ in thousands", None, "USD", "CAD", None, 3, "ok"),
        ("MCAD", None, "USD", "CAD", None, 6, "ok"),
        ("c/sh", None, "USD/shares", "USD/shares", None, -2, "ok"),
        ("CAD cents/share", None, "USD/shares", "CAD/shares", None, -2, "ok"),
        ("shrs (000)", None, "shares", "shares", None, 3, "ok"),
        ("USD", "84.069 (in mm)", "USD", "USD", 84.069, 6, "ok"),
        ("USD thousands", "12.5 million", "USD", "USD", 12.5, 6, "ok"),
        (None, "$ 834,766 (000's omitted)", "USD", "USD", 834766.0, 3, "ok"),
        (None, "in 000s: -182,724", "USD", "USD", -182724.0, 3, "ok"),
        (None, "C$-116,035,000", "USD", "CAD", -116035000.0, 0, "ok"),
        (None, "292¢", "USD/shares", "USD/shares", 292.0, -2, "ok"),
        (None, "30c per share CAD", "USD/shares", "CAD/shares", 30.0, -2, "ok"),
        (None, "no. 41.433M shares", "shares", "shares", 41.433, 6, "ok"),
        ("shares", None, "USD", "USD", None, 0, "incompatible"),
        ("frobs", None, "USD", "USD", None, 0, "unknown_unit"),
        (None, None, None, None, None, 0, "unknown_unit"),
        ("", "", "USD", "USD", None, 0, "ok"),
    ],
)
def test_conversion(unit, text, common, name, number, exponent, status):
    got = conversion(unit, text, common)
    assert (got[0], got[1], got[2], got[5]) == (name, number, exponent, status)


def test_dimensions_scale_and_offset():
    q = parse_quantity("12 thousand barrels")
    assert q.number == 12 and q.dims == {"m": 3} and q.exponent == 3 and abs(q.coefficient - 0.158987294928) < 1e-12
    name, number, exponent, coefficient, offset, status = conversion("celsius", "20", "kelvin")
    assert status == "ok" and number * coefficient + offset == pytest.approx(293.15)
    assert parse_quantity("usd per share").dims == {"USD": 1, "shares": -1}


FACT = "fact_id long, cik long, taxonomy string, concept string, unit string, value double, value_text string, period_start date, period_end date, common_unit string"
D = date(2020, 3, 31)


def run(spark, rows):
    facts = spark.createDataFrame([(i, k, "t", c, u, v, x, None, D, "clash") for i, k, c, u, v, x in rows], FACT)
    common = spark.createDataFrame([("t", "Assets", "USD"), ("t", "Assets", "USD"), ("t", "Eps", "USD/shares")], "taxonomy string, concept string, common_unit string")
    return {r.fact_id: (r.common_unit, r.exponent, r.common_value, r.status) for r in to_common_units(facts, common).collect()}


def test_one_of_a_period_is_a_thousandth(spark):
    rows = [(1, 1, "Assets", "USD", 5000.0, None), (2, 1, "Assets", "US$", 5_000_000.0, None), (3, 1, "Assets", "kUSD", 5010.0, None), (4, 1, "Assets", "USD", 5.0, None)]
    got = run(spark, rows + rows)
    assert got[1] == ("USD", 3, 5_000_000.0, "ok") and got[2][1] == 0 and got[3][1] == 3 and got[4][:2] == ("USD", 6)


def test_the_others_must_agree_and_be_two(spark):
    assert run(spark, [(1, 1, "Assets", "USD", 5.0, None), (2, 1, "Assets", "USD", 5000.0, None)])[1][1] == 0
    rows = [(1, 1, "Assets", "USD", 5.0, None), (2, 1, "Assets", "USD", 5000.0, None), (3, 1, "Assets", "USD", 9000.0, None)]
    assert run(spark, rows)[1][1] == 0
    # a loss of the same size is no companion of a profit
    rows = [(1, 1, "Assets", "USD", -5.0, None), (2, 1, "Assets", "USD", 5000.0, None), (3, 1, "Assets", "USD", 5000.0, None)]
    assert run(spark, rows)[1][1] == 0


def test_nulls_zero_unknown(spark):
    got = run(spark, [(1, 1, "Assets", None, None, None), (2, 1, "Assets", "USD", 0.0, None), (3, 1, "Nope", "USD", 1.0, None), (4, None, None, None, 1.0, "x"), (5, 1, "Assets", "shares", 4.0, None), (6, 1, "Eps", None, None, "30c per share CAD")])
    assert got[1] == ("USD", 0, None, "no_number") and got[2] == ("USD", 0, 0.0, "ok")
    assert got[3][3] == "unknown_unit" and got[4][3] == "unknown_unit" and got[5][3] == "incompatible" and got[5][2] is None
    assert got[6][:2] == ("CAD/shares", -2) and got[6][2] == pytest.approx(0.3)
    assert run(spark, []) == {}


def test_cents_of_a_company_that_reports_in_another_currency(spark):
    rows = [(1, 1, "Eps", "cents per share", 30.0, None), (2, 1, "Assets", "C$", 5.0, None), (3, 1, "Assets", "CAD", 6.0, None), (13, 1, "Assets", "kCAD", 6.0, None), (4, 1, "Assets", "USD", 6.0, None)]
    rows += [(5, 2, "Eps", "cents per share", 30.0, None), (6, 1, "Eps", "US cents/share", 30.0, None), (7, 3, "Eps", "c/sh", 1.0, None), (8, 3, "Assets", "CAD", 1.0, None), (9, 3, "Assets", "USD", 1.0, None)]
    rows += [(10, None, "Eps", "c/sh", 1.0, None), (11, None, "Assets", "CAD", 1.0, None), (12, 1, "Eps", None, None, "292¢")]
    got = run(spark, rows)
    assert got[1] == ("CAD/shares", -2, pytest.approx(0.3), "ok") and got[12][:2] == ("CAD/shares", -2)
    assert [got[i][0] for i in (5, 6, 7, 10)] == ["USD/shares"] * 4 and got[4][0] == "USD"
