"""Structures as text: what can be told from SMILES without a chemistry toolkit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Structures above this mass are dropped. A fixed value.
MAX_EXACT_MASS = 2000.0
_ISOTOPE = r"\[[0-9]+(?=[A-Za-z])"
_ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]"
_HYDROGEN = r"^\[[0-9]*H[0-9]*[+-]?[0-9]*\]$"


def isotope_labelled(smiles: Column) -> Column:
    """Whether an atom is written with an isotope."""
    return smiles.rlike(_ISOTOPE)


def without_isotope_labels(smiles: Column) -> Column:
    return F.regexp_replace(smiles, _ISOTOPE, "[")


def heavy_atoms(smiles: Column) -> Column:
    """The atoms that are written, hydrogens aside."""
    atoms = F.regexp_extract_all(smiles, F.lit(f"({_ATOM})"), F.lit(1))
    return F.size(F.filter(atoms, lambda a: ~a.rlike(_HYDROGEN)))


def largest_fragment(smiles: Column) -> Column:
    """The part between dots with the most heavy atoms; of several the longest, then the first in order of text."""
    parts = F.transform(F.split(smiles, r"\."), lambda p: F.struct((-heavy_atoms(p)).alias("a"), (-F.length(p)).alias("l"), p.alias("p")))
    return F.array_min(parts)["p"]


def drop_reason(smiles: Column, exact_mass: Column) -> Column:
    """Why a structure is left out of a library, or 'kept'; the first reason counts. An unknown mass is no reason."""
    return (
        F.when(smiles.isNull() | (F.trim(smiles) == ""), "unparsable or no structure")
        .when(smiles.contains("*"), "generic structure (* atoms)")
        .when(isotope_labelled(smiles), "isotope-labelled")
        .when(exact_mass > MAX_EXACT_MASS, F.lit(f"exact mass above {MAX_EXACT_MASS:g}"))
        .otherwise("kept")
    )
