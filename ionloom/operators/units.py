"""Quantities stated in different units, found in free text and brought to one unit."""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways of writing a unit of collision energy (lower case, blanks as one blank), by unit name.
ENERGY_ALIASES: dict[str, tuple[str, ...]] = {
    "ev": ("ev", "evs", "electron volt", "electron volts", "electronvolt", "electronvolts", "electron-volt", "electron-volts"),
    "v": ("v", "volt", "volts"),
    "kv": ("kv", "kilovolt", "kilovolts"),
    "mev": ("mev", "millielectronvolt", "millielectronvolts", "millielectron volt", "millielectron volts"),
    "kj_per_mol": ("kj/mol", "kj mol-1", "kj.mol-1", "kj mol^-1", "kj·mol-1", "kj per mol", "kj per mole", "kj / mol"),
    "kcal_per_mol": ("kcal/mol", "kcal mol-1", "kcal.mol-1", "kcal mol^-1", "kcal·mol-1", "kcal per mol", "kcal per mole", "kcal / mol"),
    "nce": ("nce", "% nce", "%nce", "(nce)", "%", "% (nominal)", "percent", "percent nce", "normalized", "normalised", "normalized collision energy", "normalised collision energy", "% normalized", "% normalised"),
    "nce_fraction": ("nce fraction", "fraction of nce", "fraction nce"),
}

_DASHES = dict.fromkeys(map(ord, "‐‑‒–—−﹣－"), "-")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*(?:e[+-]?\d+)?", re.I)
#: What may stand between a number and the unit that follows a whole list of numbers.
_LIST_GAP = re.compile(r"[\s,;/+&|-]*(?:(?:to|and|bis|then)\b[\s,;/+&|-]*)?$")
_LONE_COMMA = re.compile(r"(\d+),(\d+)")
#: Words that a number may follow without a blank ("HCD30"); after any other letters it's part of a name ("MS2").
_GLUED = re.compile(r"(?:^|[^a-z])(?:hcd|cid|etd|ecd|ethcd|uvpd|ce|energy|voltage)$")


class AliasAutomaton:
    """Aho-Corasick automaton over aliases: one pass finds every alias in a text, whatever their number."""

    def __init__(self, aliases: dict[str, str]):
        self.step: list[dict[str, int]] = [{}]
        self.fail, self.out = [0], [[]]
        for alias, name in aliases.items():
            at = 0
            for ch in alias:
                if ch not in self.step[at]:
                    self.step[at][ch] = len(self.step)
                    self.step.append({})
                    self.fail.append(0)
                    self.out.append([])
                at = self.step[at][ch]
            self.out[at].append((len(alias), name))
        todo = deque(self.step[0].values())
        while todo:
            at = todo.popleft()
            for ch, to in self.step[at].items():
                back = self.fail[at]
                while back and ch not in self.step[back]:
                    back = self.fail[back]
                self.fail[to] = self.step[back].get(ch, 0) if self.step[back].get(ch, 0) != to else 0
                self.out[to] = self.out[to] + self.out[self.fail[to]]
                todo.append(to)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Leftmost-longest matches that don't overlap and don't cut a word: (start, end, name). A number may follow one of two letters or more."""
        found, at = [], 0
        for i, ch in enumerate(text):
            while at and ch not in self.step[at]:
                at = self.fail[at]
            at = self.step[at].get(ch, 0)
            for size, name in self.out[at]:
                start, end = i + 1 - size, i + 1
                if text[start].isalpha() and start and (text[start - 1].isalpha() or text[start - 1] == "_"):
                    continue
                if text[end - 1].isalnum() and end < len(text) and (text[end].isalnum() or text[end] == "_") and not (text[end].isdigit() and size > 1):
                    continue
                found.append((start, end, name))
        found.sort(key=lambda s: (s[0], -s[1]))
        kept: list[tuple[int, int, str]] = []
        for span in found:
            if not kept or span[0] >= kept[-1][1]:
                kept.append(span)
        return kept


@lru_cache(maxsize=8)
def _automaton(aliases: tuple[tuple[str, str], ...]) -> AliasAutomaton:
    return AliasAutomaton(dict(aliases))


def _values(token: str) -> list[float]:
    """The numbers in a run of digits, points and commas.

    One comma is a decimal mark if no point is there and it is followed by a single digit or only zeros, or if it
    follows a leading 0; one before exactly three zeros parts thousands; several commas, or one before a whole second
    number, separate a list.
    """
    lone = _LONE_COMMA.fullmatch(token)
    if lone and lone[2] == "000" and lone[1] != "0":
        return [float(lone[1] + lone[2])]
    if lone and (len(lone[2]) == 1 or not lone[2].strip("0") or lone[1] == "0"):
        return [float(f"{lone[1]}.{lone[2]}")]
    return [float(x.rstrip(".")) for x in re.split(",", token) if re.fullmatch(r"\d+(?:\.\d+)?(?:e[+-]?\d+)?", x, re.I)]


def stated_quantities(text: str | None, bare_unit: str | None, automaton: AliasAutomaton) -> list[tuple[float, str | None]]:
    """(value, unit) of every number that ``text`` states; signs don't count.

    A number takes the unit that follows it, with nothing but further numbers and separators between; else the one
    before it; else ``bare_unit``, the unit its field's source writes no unit for (None: unknown).
    """
    if not text:
        return []
    flat = re.sub(r"\s+", " ", text.translate(_DASHES).replace(" ", " ")).lower().strip()
    spans = automaton.spans(flat)
    masked = list(flat)
    for start, end, _ in spans:
        masked[start:end] = "\0" * (end - start)
    plain = "".join(masked)
    named = lambda at: at and (plain[at - 1].isalpha() or plain[at - 1] == "_") and not _GLUED.search(plain[:at])
    numbers = [m for m in _NUMBER.finditer(plain) if not named(m.start())]
    out: list[tuple[float, str | None]] = []
    for i, m in enumerate(numbers):
        unit, end = None, m.end()
        for nxt in [*numbers[i + 1 :], None]:
            after = next((s for s in spans if s[0] >= end), None)
            if after and (nxt is None or after[0] < nxt.start()):
                gap = plain[end : after[0]].replace("(", "").replace("[", "")
                if _LIST_GAP.fullmatch(gap):
                    unit = after[2]
                break
            if nxt is None or not _LIST_GAP.fullmatch(plain[end : nxt.start()]):
                break
            end = nxt.end()
        if unit is None:
            before = [s for s in spans if s[1] <= m.start()]
            unit = before[-1][2] if before else bare_unit
        out += [(v, unit) for v in _values(m.group())]
    return out


_FOUND = pa.list_(pa.struct([("value", pa.float64()), ("unit", pa.string())]))


def quantities_column(text: Column, bare_unit: Column, aliases: dict[str, tuple[str, ...]] = ENERGY_ALIASES) -> Column:
    """array<struct<value, unit>> of the quantities stated in ``text``: Arrow batches, each distinct text parsed once a batch."""
    flat = tuple((a, unit) for unit, names in aliases.items() for a in names)

    @F.arrow_udf("array<struct<value:double,unit:string>>")
    def parse(texts: pa.Array, units: pa.Array) -> pa.Array:
        automaton = _automaton(flat)
        both = [x.dictionary_encode() if not pa.types.is_dictionary(x.type) else x for x in (texts, units)]
        t, u = (x.dictionary.to_pylist() for x in both)
        seen: dict[tuple, int] = {}
        values, take = [], []
        for pair in zip(both[0].indices.to_pylist(), both[1].indices.to_pylist()):
            if pair not in seen:
                seen[pair] = len(values)
                i, j = pair
                values.append([{"value": v, "unit": w} for v, w in stated_quantities(None if i is None else t[i], None if j is None else u[j], automaton)])
            take.append(seen[pair])
        return pa.array(values, type=_FOUND).take(pa.array(take, type=pa.int64()))

    return parse(text, bare_unit)


#: Rows that a table of units or of sources may have to be broadcast; beyond it the join shuffles.
MAX_UNIT_ROWS = 10_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_UNIT_ROWS + 1).count() <= MAX_UNIT_ROWS else df


def energies_in_ev(spectra: DataFrame, libraries: DataFrame, units: DataFrame, *, library_name=None) -> DataFrame:
    """(row_id, value, unit, ev): one row for each energy that ``collision_energy_orig`` states, in eV.

    ``units`` has the conversion factors (unit, ev_per_unit, scales_with_mz), ``libraries`` the unit of bare numbers.
    A null, empty or blank text, or one without a number, gives no row; a number without any unit, one whose unit is
    unknown, or a unit that scales with a null precursor gives a row with a null ``ev``. A repeated row_id gives its
    rows again; other columns aren't read. Empty tables give an empty result.
    """
    from ionloom.functions.keys import clean_name

    name = library_name or clean_name
    slim = spectra.select("row_id", F.col("collision_energy_orig").alias("text"), "precursor_mz", name(F.col("ingest_lib")).alias("lib"))
    bare = libraries.select(name(F.col("ingest_lib")).alias("lib"), F.lower(F.trim("bare_energy_unit")).alias("bare")).where("lib is not null").groupBy("lib").agg(F.min("bare").alias("bare"))
    factors = units.select(F.lower(F.trim("unit")).alias("unit"), "ev_per_unit", "scales_with_mz").where("unit is not null").groupBy("unit").agg(F.min("ev_per_unit").alias("factor"), F.max("scales_with_mz").alias("scales"))
    digits = slim.where(F.col("text").rlike("[0-9]"))
    parsed = digits.join(_small(bare), "lib", "left").withColumn("q", quantities_column(F.col("text"), F.col("bare")))
    stated = parsed.select("row_id", "precursor_mz", F.explode("q").alias("q")).select("row_id", "precursor_mz", F.abs("q.value").alias("value"), F.col("q.unit").alias("unit"))
    scale = F.when(F.col("scales"), F.col("precursor_mz") / F.lit(500.0)).otherwise(F.lit(1.0))
    return stated.join(_small(factors), "unit", "left").select("row_id", "value", "unit", (F.col("value") * F.col("factor") * scale).alias("ev"))


def tenths(col: Column) -> Column:
    return F.floor(col * F.lit(10.0) + F.lit(0.5)).cast("bigint")


def incomplete_energies(spectra: DataFrame, libraries: DataFrame, units: DataFrame) -> DataFrame:
    """(row_id, ev_tenths): the stated energies of rows whose ``collision_energy_ev`` isn't the same set, in tenths of an eV.

    A null or empty list, a null in it, and a different set all make a row a case; the order and repeats don't.
    """
    ids = spectra.select("row_id", "ingest_lib", "collision_energy_orig", "precursor_mz", F.array_distinct(F.transform(F.filter(F.coalesce("collision_energy_ev", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x)), tenths)).alias("have"))
    # the list rides along inside row_id, so that one pass does without a join back to the spectra
    ev = energies_in_ev(ids.select(F.struct("row_id", "have").alias("row_id"), "ingest_lib", "collision_energy_orig", "precursor_mz"), libraries, units)
    per_row = ev.where(F.col("ev").isNotNull()).groupBy(F.col("row_id.row_id").alias("id")).agg(F.collect_set(tenths(F.col("ev"))).alias("stated"), F.min(F.col("row_id.have")).alias("have"))
    differs = (F.size(F.array_except("stated", "have")) > 0) | (F.size(F.array_except("have", "stated")) > 0)
    return per_row.where(differs).select(F.col("id").alias("row_id"), F.explode("stated").alias("ev_tenths"))


def energy_setting(ev: DataFrame) -> DataFrame:
    """(row_id, energy): the stated energies of a row in whole eV, in order, joined by commas; rows without any are left out."""
    whole = F.floor(F.col("ev") + F.lit(0.5)).cast("bigint")
    return ev.where("ev is not null").groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set(whole)).cast("array<string>"), ",").alias("energy"))
