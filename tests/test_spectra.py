import math

from pyspark.sql import functions as F

from ionloom.functions import metadata as M
from ionloom.functions import spectra as S
from ionloom.functions import vectors as V
from ionloom.functions.chemistry import formula_mass
from ionloom.functions.keys import clean_key, clean_name


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def peaks_of(spark, peaks, f):
    return one(spark, "p array<struct<mz:double,i:double>>", (peaks,), f(F.col("p")))[0]


def test_bins_truncate(spark):
    got = peaks_of(spark, [(0.3, 1.0), (999.99, 0.25), (1000.0, 1.0)], S.binned)
    assert [(r.bin, r.v) for r in got] == [(2, 1.0), (9999, 0.5)]


def test_top_peaks_tie_goes_to_lower_mz(spark):
    got = peaks_of(spark, [(3.0, 0.5), (1.0, 0.5), (2.0, 0.9)], lambda p: S.top_peaks(p, 2))
    assert [r.mz for r in got] == [1.0, 2.0]
    assert peaks_of(spark, [], S.top_peaks) == [] and peaks_of(spark, None, S.top_peaks) is None


def cosine(spark, a, b):
    return one(spark, "a array<struct<mz:double,i:double>>, b array<struct<mz:double,i:double>>", (a, b), S.peak_cosine(F.col("a"), F.col("b")))[0]


def test_peak_cosine(spark):
    assert cosine(spark, [], [(1.0, 1.0)]) == 0 and cosine(spark, None, [(1.0, 1.0)]) == 0 and cosine(spark, [(1.0, 1.0)], None) == 0
    assert cosine(spark, [(100.0, 1.0)], [(99.9921875, 0.2), (100.0078125, 0.7)]) == 0.7  # the right one of two as near
    assert cosine(spark, [(100.0, 0.5), (100.004, 0.5)], [(100.002, 0.6)]) == 0.6  # one peak serves both
    assert cosine(spark, [(100.0, 1.0), (200.0, 1.0)], [(100.0, 0.9), (200.0, 0.9)]) == 1.0  # at most 1
    assert cosine(spark, [(100.0, 1.0)], [(100.0100001, 1.0)]) == 0


def test_quality_rule(spark):
    rule = S.is_clean(F.col("e"), F.col("n"), F.col("m"), F.col("p"))
    ask = lambda *r: one(spark, "e double, n int, m array<double>, p double", r, rule)[0]
    assert ask(None, 3, None, 100.0) and ask(20.0, 3, [103.0], 100.0) and ask(1.0, 5, [], 100.0)
    assert not ask(1.0, 2, [50.0], 100.0) and not ask(1.0, 3, [103.1], 100.0) and not ask(-21.0, 3, [1.0], 100.0)
    assert ask(1.0, None, [1.0], 100.0) is None


def test_metadata(spark):
    schema = "mz double, a string, m string, e array<double>"
    f = M.metadata_features(F.col("mz"), F.col("a"), F.col("m"), F.col("e"))
    known = one(spark, schema, (501.007276, "[M+H]+", "positive", [20.0, 35.0]), *f)
    assert len(known) == 22 and abs(known[1] - 0.5) < 1e-9 and known[2:7] == (1, 1, 0, 0, 1) and known[7] == 1 and known[-1] == 0
    other = one(spark, schema, (500.0, "[M+X]+", None, None), *f)
    assert other[1] == 0.5 and sum(other[2:-1]) == 0 and other[-1] == 1
    assert sum(one(spark, schema, (None, None, None, None), *f)) == 0
    assert one(spark, schema, (None, None, None, [20.0, 40.5]), M.energy_label(F.col("e")), M.mean_energy(F.col("e"))) == ("20,40", 30.25)


def test_strict_lookup_fails_on_unknown(spark):
    import pytest

    df = spark.createDataFrame([(1.0, "[M+X]+")], "mz double, a string")
    with pytest.raises(Exception, match="no value for"):
        df.select(M.strict_neutral_mass(F.col("mz"), F.col("a"))).collect()


def test_vectors(spark):
    schema = "a array<double>, b array<double>"
    got = one(spark, schema, ([3.0, 4.0], [1.0, 0.0]), V.norm(F.col("a")), V.cosine_of_units(V.unit(F.col("a")), F.col("b")), V.unit(F.array(F.lit(0.0))))
    assert got == (5.0, 0.6, None)
    bits = one(spark, schema, ([0.5, 0.25], [1.0, 0.0]), V.soft_tanimoto(F.col("a"), F.col("b")), V.likelihood(F.col("a"), F.col("b")), V.dot_over_root(F.col("a"), F.col("b")))
    assert math.isclose(bits[0], 0.5 / (0.75 + 1 - 0.5)) and bits[1] == 0 and bits[2] == 0.5
    words = one(spark, schema, ([1.0, -1.0, 1.0], [1.0, 1.0, -1.0]), V.sign_words(F.col("a"), 2), V.bit_tanimoto(V.sign_words(F.col("a")), V.sign_words(F.col("b"))))
    assert words[0] == [2, 1] and math.isclose(words[1], 1 / 3)


def test_keys_names_formulas(spark):
    ask = lambda x: one(spark, "k string", (x,), clean_key(F.col("k")))[0]
    assert {ask(x) for x in ("ABCDEFGHIJKLMN", " abcdefghijklmn\t", "InChIKey=ABCDEFGHIJKLMN-OPQRSTUVWX-N", "ABCDEFG HIJKLMN")} == {"ABCDEFGHIJKLMN"}
    assert {ask(x) for x in (None, "", "N/A", "-", "ABCDEFGHIJKLM", "ABCDEFGHIJKLMNO")} == {None}
    assert one(spark, "n string", (" Ursa_TIMS ",), clean_name(F.col("n")))[0] == "ursa-tims"
    mass = lambda x: one(spark, "f string", (x,), formula_mass(F.col("f")))[0]
    assert math.isclose(mass("C6H12O6"), 180.0633881, abs_tol=1e-5) and mass("Xx2") is None and mass("") is None and mass(None) is None


def test_structures_as_text(spark):
    from ionloom.functions import structures as X

    rows = [("[13CH4].CCO.[Na+]",), ("C[2H]",), ("CC(=O)Cl.Br",), ("*CC",), (" ",), (None,), ("c1ccccc1[N+](=O)[O-]",)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(X.without_isotope_labels(F.col("s")), X.heavy_atoms(F.col("s")), X.largest_fragment(F.col("s")), X.drop_reason(F.col("s"), F.lit(100.0))).collect()]
    assert got[0] == ("[CH4].CCO.[Na+]", 5, "CCO", "isotope-labelled")
    assert got[1] == ("C[H]", 1, "C[2H]", "isotope-labelled")
    assert got[2] == ("CC(=O)Cl.Br", 5, "CC(=O)Cl", "kept")
    assert got[3][3] == "generic structure (* atoms)" and got[4][3] == got[5][3] == "unparsable or no structure" and got[6][1:] == (9, "c1ccccc1[N+](=O)[O-]", "kept")
    assert spark.range(1).select(X.drop_reason(F.lit("C"), F.lit(2000.5))).first()[0] == "exact mass above 2000"
