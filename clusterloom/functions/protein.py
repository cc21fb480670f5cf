"""Protein properties and translation as column expressions.

Constants below are fixed values from the published scales named beside them.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.tokens import explode_kmers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Average residue masses of the free amino acids, and of water.
RESIDUE_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666,
    "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179,
    "O": 255.3134, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192,
    "U": 168.0532, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
WATER_MASS = 18.0153

# Hydropathy scale of Kyte and Doolittle (1982).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4,
    "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8,
    "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# Normalised flexibility of Vihinen et al. (1994), its 9-residue window weights and divisor.
FLEXIBILITY = {
    "A": 0.984, "C": 0.906, "E": 1.094, "D": 1.068, "G": 1.031, "F": 0.915, "I": 0.927,
    "H": 0.950, "K": 1.102, "M": 0.952, "L": 0.935, "N": 1.048, "Q": 1.037, "P": 1.049,
    "S": 1.046, "R": 1.008, "T": 0.997, "W": 0.904, "V": 0.931, "Y": 0.929,
}
FLEX_WEIGHTS = (0.25, 0.4375, 0.625, 0.8125)
FLEX_WINDOW = 9
FLEX_MIDDLE = 6  # 1-based residue of the window that has weight 1
FLEX_DIVISOR = 5.25

# Dissociation constants of Bjellqvist et al. (1993).
POSITIVE_PK = {"Nterm": 7.5, "K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"Cterm": 3.55, "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
C_TERMINAL_PK = {"D": 4.55, "E": 4.75}
N_TERMINAL_PK = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PI_START, PI_LOW, PI_HIGH, PI_STEPS = 7.775, 4.05, 12.0, 17

# Standard genetic code, bases in the order T, C, A, G.
CODON_BASES = "TCAG"
CODON_TABLE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def residue_count(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))


def _dot(seq: Column, table: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for residue, value in sorted(table.items()):
        total = total + residue_count(seq, residue) * F.lit(value)
    return total


def composition(seq: Column) -> dict[str, Column]:
    """Whole-sequence properties; null for an empty sequence."""
    n = F.length(seq)
    share = lambda letters: sum((residue_count(seq, r) for r in letters[1:]),
                                residue_count(seq, letters[0]))
    ratio = lambda value: F.try_divide(value.cast("double"), n.cast("double"))
    return {
        "proteinMWeight": F.when(n > 0, _dot(seq, RESIDUE_MASS) - (n - 1) * F.lit(WATER_MASS)),
        "proteinAroma": ratio(share("YWF")),
        "proteinGravy": ratio(_dot(seq, HYDROPATHY)),
        "proteinSecstruc-1": ratio(share("VIYFWL")),
        "proteinSecstruc-2": ratio(share("NPGS")),
        "proteinSecstruc-3": ratio(share("EMAL")),
    }


def flexibility_windows(df: DataFrame, seq_col: str) -> DataFrame:
    """Flexibility score of every window: ``pos`` (1-based start) and ``score``.

    The last window is left out: starts run over ``length - 9`` positions.
    """
    rest = [c for c in df.columns if c != seq_col]
    grams = explode_kmers(df, seq_col, FLEX_WINDOW, "_w", "pos", tail=1)
    table = F.create_map(*[F.lit(x) for kv in sorted(FLEXIBILITY.items()) for x in kv])
    value = lambda i: table[F.substring("_w", i, 1)]
    score = F.lit(0.0)
    for j, weight in enumerate(FLEX_WEIGHTS):
        score = score + (value(j + 1) + value(FLEX_WINDOW - j)) * F.lit(weight)
    score = (score + value(FLEX_MIDDLE)) / F.lit(FLEX_DIVISOR)
    # The window's score belongs to the residue at the same ordinal, its first residue.
    return grams.select(*rest, "pos", F.substring("_w", 1, 1).alias("residue"), score.alias("score"))


def flexibility_by_residue(df: DataFrame, id_cols: list[str], seq_col: str) -> DataFrame:
    """Window scores summed per residue: ``id…, feature`` (``protein-<residue>``), ``value``."""
    return (
        flexibility_windows(df.select(*id_cols, seq_col), seq_col)
        .groupBy(*id_cols, "residue")
        .agg(F.sum("score").alias("value"))
        .select(*id_cols, F.concat(F.lit("protein-"), "residue").alias("feature"), "value")
    )


def dipeptide_index(
    df: DataFrame, id_cols: list[str], seq_col: str, weights: DataFrame
) -> DataFrame:
    """Instability index: ``10 / length`` times the summed dipeptide weights.

    ``weights`` is the published table as ``dipeptide, weight``. Pairs are counted per
    instance before the join.
    """
    sized = df.select(*id_cols, F.length(seq_col).alias("_n"), seq_col)
    pairs = (
        explode_kmers(sized, seq_col, 2, "dipeptide")
        .groupBy(*id_cols, "_n", "dipeptide")
        .agg(F.count("*").alias("_cnt"))
    )
    return (
        pairs.join(weights.select("dipeptide", "weight"), "dipeptide", "left")
        .groupBy(*id_cols, "_n")
        .agg(F.sum(F.col("_cnt") * F.coalesce("weight", F.lit(0.0))).alias("_s"))
        .select(*id_cols, (F.lit(10.0) / F.col("_n") * F.col("_s")).alias("instability"))
    )


def isoelectric_point(seq: Column) -> Column:
    """pH of zero charge by bisection, a fixed number of halvings over residue counts."""
    first, last = F.substring(seq, 1, 1), F.substring(seq, -1, 1)

    def pick(residue: Column, table: dict[str, float], default: float) -> Column:
        out = F.lit(default)
        for r, pk in table.items():
            out = F.when(residue == r, pk).otherwise(out)
        return out

    charged = {r: residue_count(seq, r).cast("double") for r in "KRHDECY"}
    nterm = pick(first, N_TERMINAL_PK, POSITIVE_PK["Nterm"])
    cterm = pick(last, C_TERMINAL_PK, NEGATIVE_PK["Cterm"])
    facts = F.struct(
        *[c.alias(r) for r, c in charged.items()], nterm.alias("nterm"), cterm.alias("cterm")
    )

    def charge(ph: Column, f: Column) -> Column:
        up = lambda pk: F.pow(F.lit(10.0), pk - ph) / (F.pow(F.lit(10.0), pk - ph) + 1)
        down = lambda pk: F.pow(F.lit(10.0), ph - pk) / (F.pow(F.lit(10.0), ph - pk) + 1)
        total = up(f["nterm"])
        for r in "KRH":
            total = total + f[r] * up(F.lit(POSITIVE_PK[r]))
        total = total - down(f["cterm"])
        for r in "DECY":
            total = total - f[r] * down(F.lit(NEGATIVE_PK[r]))
        return total

    start = F.struct(
        F.lit(PI_LOW).alias("lo"), F.lit(PI_HIGH).alias("hi"), F.lit(PI_START).alias("ph"),
        facts.alias("f"),
    )

    def step(acc: Column, _i: Column) -> Column:
        positive = charge(acc["ph"], acc["f"]) > 0
        lo = F.when(positive, acc["ph"]).otherwise(acc["lo"])
        hi = F.when(positive, acc["hi"]).otherwise(acc["ph"])
        return F.struct(
            lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("ph"), acc["f"].alias("f")
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(PI_STEPS)), start, step, lambda a: a["ph"])
    return F.when(F.length(seq) > 0, found)


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGT", "TGCA"))


#: Base of each byte by its place in ``CODON_BASES``; anything else has none.
_NO_BASE = 64
_BASE_OF = np.full(256, _NO_BASE, np.uint8)
_BASE_OF[np.frombuffer(CODON_BASES.encode(), np.uint8)] = np.arange(4)
_RESIDUES = np.append(np.frombuffer(CODON_TABLE.encode(), np.uint8), np.uint8(ord("X")))


def _residues(dna: str | None) -> str | None:
    if not isinstance(dna, str):
        return None
    # Other characters are no bases, but each takes one place.
    codes = np.frombuffer(dna.encode("ascii", "replace"), np.uint8)
    bases = _BASE_OF[codes[:len(codes) // 3 * 3]].reshape(-1, 3).astype(np.int32)
    return _RESIDUES[np.minimum(bases[:, 0] * 16 + bases[:, 1] * 4 + bases[:, 2], _NO_BASE)].tobytes().decode()


def translate_dna(dna: Column) -> Column:
    """Amino acids of the complete codons; a codon with any other letter gives ``X``.

    Codons are looked up a text at a time: one by one each would cost an expression.
    """
    return F.pandas_udf(lambda texts: texts.map(_residues), "string")(dna)


def six_frames(df: DataFrame, seq_col: str) -> DataFrame:
    """Six translations per sequence: ``frame`` (1..3 forward, -1..-3 reverse) and ``protein``."""
    rest = [c for c in df.columns if c != seq_col]
    strands = F.array(
        *[F.struct(F.lit(f).alias("frame"), F.substr(F.col(seq_col), F.lit(f)).alias("dna"))
          for f in (1, 2, 3)],
        *[F.struct(F.lit(-f).alias("frame"),
                   F.substr(reverse_complement(F.col(seq_col)), F.lit(f)).alias("dna"))
          for f in (1, 2, 3)],
    )
    return df.select(*rest, F.explode(strands).alias("_s")).select(
        *rest, F.col("_s.frame").alias("frame"), translate_dna(F.col("_s.dna")).alias("protein")
    )
