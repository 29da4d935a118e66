"""Adducts, neutral masses and measurement features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Adduct -> (molecules in the ion, mass added). Ion m/z = molecules * M + mass.
PROTON = 1.007276
ADDUCTS: dict[str, tuple[int, float]] = {
    "[M+H]+": (1, PROTON),
    "[M+Na]+": (1, 22.989218),
    "[M+NH4]+": (1, 18.033823),
    "[M+K]+": (1, 38.963158),
    "[2M+H]+": (2, PROTON),
    "[2M+Na]+": (2, 22.989218),
    "[M-H]-": (1, -PROTON),
    "[M+Cl]-": (1, 34.969402),
    "[M+Br]-": (1, 78.918885),
    "[M+CH2O2-H]-": (1, 46.005479 - PROTON),
    "[M+C2H4O2-H]-": (1, 60.021129 - PROTON),
    "[2M-H]-": (2, -PROTON),
    "[2M+CH2O2-H]-": (2, 46.005479 - PROTON),
    "[2M+C2H4O2-H]-": (2, 60.021129 - PROTON),
}
# The adducts that every query of the strict neutral mass may have, and those that get an embedding.
STRICT_ADDUCTS = ("[M+H]+", "[M+Na]+", "[M+NH4]+", "[M+K]+", "[M-H]-", "[M+Cl]-", "[M+CH2O2-H]-")
EMBEDDED_ADDUCTS = (
    "[M+H]+", "[M+Na]+", "[M+NH4]+", "[M+K]+", "[M-H2O+H]+", "[M-2H2O+H]+", "[M+2H]2+", "[M]+", "[2M+H]+", "[2M+Na]+",
    "[M-H]-", "[M+CH2O2-H]-", "[M+C2H4O2-H]-", "[M+Cl]-", "[2M-H]-", "[2M+Na-2H]-",
)
ENERGIES = (20.0, 40.0, 60.0)
MASS_SCALE = 1000.0


def lookup(col: Column, table: dict, default=None, strict: bool = False) -> Column:
    """Values of ``col`` by ``table``; others take ``default``, or stop the query if ``strict``. NULL stays NULL if strict."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    value = F.try_element_at(pairs, col)
    if strict:
        return F.when(col.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("no value for "), col))).otherwise(value)
    return F.coalesce(value, F.lit(default))


def neutral_mass(mz: Column, adduct: Column) -> Column:
    """(m/z - added mass) / molecules; an adduct outside the table, or none, leaves m/z as it is."""
    return (mz - lookup(adduct, {k: v[1] for k, v in ADDUCTS.items()}, 0.0)) / lookup(adduct, {k: float(v[0]) for k, v in ADDUCTS.items()}, 1.0)


def strict_neutral_mass(mz: Column, adduct: Column) -> Column:
    return mz - lookup(adduct, {k: ADDUCTS[k][1] for k in STRICT_ADDUCTS}, strict=True)


def sign_matches(adduct: Column, mode: Column) -> Column:
    """The charge at the adduct's end agrees with the ionisation mode; NULL where either is missing."""
    return (adduct.endswith("+") & (mode == "positive")) | (adduct.endswith("-") & (mode == "negative"))


def gets_embedding(adduct: Column, mode: Column) -> Column:
    return F.coalesce(sign_matches(adduct, mode) & adduct.isin(*EMBEDDED_ADDUCTS), F.lit(False))


def energy_label(energies: Column) -> Column:
    """Energies as whole numbers joined by commas; NULL stays NULL."""
    return F.array_join(F.transform(energies, lambda e: e.cast("int").cast("string")), ",")


def mean_energy(energies: Column) -> Column:
    return F.try_divide(F.aggregate(energies, F.lit(0.0), lambda a, e: a + e), F.size(energies))


def metadata_features(mz: Column, adduct: Column, mode: Column, energies: Column) -> list[Column]:
    """The features of a measurement, in order: masses, polarity, energies, adducts. A missing input gives 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    out = [zero(mz / MASS_SCALE).alias("precursor"), zero(neutral_mass(mz, adduct) / MASS_SCALE).alias("neutral"), zero(mode == "positive").alias("is_positive")]
    out += [zero(F.array_contains(energies, e)).alias(f"energy_{int(e)}") for e in ENERGIES]
    out.append(zero(F.exists(energies, lambda e: ~e.isin(*ENERGIES))).alias("energy_other"))
    out += [zero(adduct == a).alias(f"adduct_{i}") for i, a in enumerate(ADDUCTS)]
    out.append(zero(~adduct.isin(*ADDUCTS)).alias("adduct_other"))
    return out
