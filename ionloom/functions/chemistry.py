"""Masses from formulas in SQL; structure functions where a chemistry toolkit is installed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses in Da.
MONOISOTOPIC = {"H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Na": 22.9897692809, "Si": 27.9769265325, "P": 30.97376163, "S": 31.97207100, "Cl": 34.96885268, "K": 38.96370668, "Br": 78.9183371, "I": 126.904473}


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass of a formula; NULL for NULL, an empty formula or an unknown element."""
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?[0-9]*)"), F.lit(1))
    masses = F.create_map(*[F.lit(x) for kv in MONOISOTOPIC.items() for x in kv])
    one = lambda p: F.try_element_at(masses, F.regexp_extract(p, "^([A-Z][a-z]?)", 1)) * F.coalesce(F.nullif(F.regexp_extract(p, "([0-9]*)$", 1), F.lit("")).cast("double"), F.lit(1.0))
    return F.when(formula.rlike("^([A-Z][a-z]?[0-9]*)+$"), F.aggregate(parts, F.lit(0.0), lambda a, p: a + one(p)))


def toolkit():
    """The chemistry toolkit's module, or None where it isn't installed."""
    try:
        from rdkit import Chem
    except ImportError:
        return None
    return Chem


def _mapped(kind: str, f):
    import pandas as pd

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        distinct = {s: f(s) if s else None for s in column.dropna().unique()}
        return column.map(distinct)

    return run


def exact_mass(smiles: Column) -> Column:
    """Exact mass by the toolkit; NULL for what it can't parse. Each distinct SMILES of a batch is parsed once."""
    chem = toolkit()
    if chem is None:
        raise RuntimeError("structure functions need the chemistry toolkit; give masses as a column instead")

    def one(s: str):
        from rdkit import Chem
        from rdkit.Chem.Descriptors import ExactMolWt

        mol = Chem.MolFromSmiles(s)
        return None if mol is None else float(ExactMolWt(mol))

    return _mapped("double", one)(smiles)


def standard_key(smiles: Column) -> Column:
    """The first 14 letters of the standard key; NULL on failure."""
    if toolkit() is None:
        raise RuntimeError("structure functions need the chemistry toolkit; give keys as a column instead")

    def one(s: str):
        from rdkit import Chem

        mol = Chem.MolFromSmiles(s)
        key = Chem.MolToInchiKey(mol) if mol is not None else ""
        return key[:14] or None

    return _mapped("string", one)(smiles)
