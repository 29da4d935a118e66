import pytest

from ionloom.operators.units import ENERGY_ALIASES, AliasAutomaton, energies_in_ev, incomplete_energies, stated_quantities

AUTOMATON = AliasAutomaton({a: u for u, names in ENERGY_ALIASES.items() for a in names})


@pytest.mark.parametrize(
    ("text", "bare", "expected"),
    [
        ("20 eV", None, [(20, "ev")]),
        ("10eV / 35eV", None, [(10, "ev"), (35, "ev")]),
        ("ramp 10–35 eV", None, [(10, "ev"), (35, "ev")]),
        ("10 to 35 eV", None, [(10, "ev"), (35, "ev")]),
        ("10,0 eV", None, [(10, "ev")]),
        ("20,40,60", "ev", [(20, "ev"), (40, "ev"), (60, "ev")]),
        ("-20,-40", "ev", [(20, "ev"), (40, "ev")]),
        ("15;20;30", "nce", [(15, "nce"), (20, "nce"), (30, "nce")]),
        ("stepped NCE 15,20,30", None, [(15, "nce"), (20, "nce"), (30, "nce")]),
        ("HCD NCE 15-20-30", None, [(15, "nce"), (20, "nce"), (30, "nce")]),
        ("964.9 kJ mol-1", None, [(964.9, "kj_per_mol")]),
        ("461.2 kcal/mol", None, [(461.2, "kcal_per_mol")]),
        ("10000meV", None, [(10000, "mev")]),
        ("0.010 kV", None, [(0.01, "kv")]),
        ("collision voltage 10V", None, [(10, "v")]),
        ("30 % (nominal)", None, [(30, "nce")]),
        ("E_lab=9eV", None, [(9, "ev")]),
        ("12", None, [(12, None)]),
        ("HCD30 eV", None, [(30, "ev")]),
        ("CE20eV", None, [(20, "ev")]),
        ("CID35", "nce", [(35, "nce")]),
        ("NCE35", None, [(35, "nce")]),
        ("1,000 V", None, [(1000, "v")]),
        ("0,000 V", None, [(0, "v")]),
        ("library v2", "ev", []),
        ("high energy", "ev", []),
        ("MS2 spectrum", "ev", []),
        ("", "ev", []),
        (None, "ev", []),
    ],
)
def test_stated_quantities(text, bare, expected):
    assert stated_quantities(text, bare, AUTOMATON) == expected


def tables(spark, rows):
    spectra = spark.createDataFrame(rows, "row_id bigint, collision_energy_orig string, collision_energy_ev array<double>, precursor_mz double, ingest_lib string, unit string, value double")
    libraries = spark.createDataFrame([("a-lib", "T", "nce"), ("b-lib", "T", None)], "ingest_lib string, instrument_type string, bare_energy_unit string")
    units = spark.createDataFrame([("ev", 1.0, False), ("nce", 1.0, True), ("kv", 1000.0, False)], "unit string, ev_per_unit double, scales_with_mz boolean")
    return spectra, libraries, units


def test_conversion_and_cases(spark):
    rows = [
        (1, "20", None, 250.0, "A_LIB ", "x", 1.0),  # bare, scaled: 10 eV; no list
        (2, "10 eV", [10.0], 400.0, "b-lib", "x", 1.0),  # complete
        (3, "10 eV, 20 eV", [10.0, None], 400.0, None, "x", 1.0),  # incomplete
        (4, "20 NCE", [], None, "a-lib", "x", 1.0),  # no precursor: no eV
        (5, "7", [7.0], 400.0, "b-lib", "x", 1.0),  # no unit known
        (6, None, None, 1.0, "b-lib", "x", 1.0),
        (7, "0.010 kV", [10.0, 10.0], 1.0, "b-lib", "x", 1.0),  # repeats don't matter
        (8, "x" * 100_000 + " 5 eV", None, 1.0, "b-lib", "x", 1.0),
    ]
    ev = {(r.row_id, r.value): r.ev for r in energies_in_ev(*tables(spark, rows)).collect()}
    assert ev[1, 20.0] == 10.0 and ev[4, 20.0] is None and ev[5, 7.0] is None and ev[7, 0.01] == 10.0 and ev[8, 5.0] == 5.0
    found = {tuple(r) for r in incomplete_energies(*tables(spark, rows)).collect()}
    assert found == {(1, 100), (3, 100), (3, 200), (8, 50)}


def test_empty_tables(spark):
    assert incomplete_energies(*tables(spark, [])).collect() == []
