"""Column expressions for ids, labels, paths and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed per sequence type.
NUCLEOTIDE_DROP = "BDEFHIJKLMNOPQRSUVXYWZ"
AMINOACID_DROP = "BJXZ-"

# Annotation type -> display colour, tested in this order.
ANNOTATION_COLOURS = (
    ("backbone", "#EE0000"),
    ("tailor", "#EE9300"),
    ("transcript", "#048014"),
    ("transport", "#1888f0"),
)
GOLD_COLOUR = "#9931f2"


def normalize_sequence(seq: Column, kind: str) -> Column:
    """Drop characters that are not bases (``nucleotide``) or residues (``aminoacid``)."""
    if kind == "nucleotide":
        return F.translate(seq, NUCLEOTIDE_DROP, "")
    if kind == "aminoacid":
        return F.translate(seq, AMINOACID_DROP, "")
    raise ValueError(f"unknown sequence kind {kind!r}")


def label_from_name(path: Column, marker: str = "bgc") -> Column:
    """1 when the file name carries the positive marker, else 0."""
    return F.when(F.lower(path).contains(marker), 1).otherwise(0)


def normalize_gene_id(gene: Column) -> Column:
    """Drop ``>`` and the version suffix; ids that contain ``|`` are kept whole."""
    bare = F.replace(gene, F.lit(">"), F.lit(""))
    return F.when(bare.contains("|"), bare).otherwise(F.split_part(bare, F.lit("."), F.lit(1)))


def strip_version(token: Column) -> Column:
    """``PF00001.21`` -> ``PF00001``."""
    return F.split_part(token, F.lit("."), F.lit(1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Last dot suffix of the base name, dot included; empty when there is none."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.split_part(base_name(path), F.lit("."), F.lit(1))


def species_from_path(path: Column) -> Column:
    """Name of the directory that holds the file."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def is_positive(score: Column, threshold: float = 0.5) -> Column:
    return score >= F.lit(threshold)


def cluster_display_id(genes: Column) -> Column:
    """``Cluster<first>_<last>``."""
    return F.concat(
        F.lit("Cluster"), F.element_at(genes, 1), F.lit("_"), F.element_at(genes, -1)
    )


def slim_window_id(genes: Column) -> Column:
    """``<first>|to|<last>``."""
    return F.concat_ws("|to|", F.element_at(genes, 1), F.element_at(genes, -1))


def annotation_weight(kind: Column) -> Column:
    """Weight of one annotation row: 2 for a backbone, 1.5 for any other type."""
    return (
        F.when(kind.isNull(), 0.0).when(kind.contains("backbone"), 2.0).otherwise(1.5)
    )


def annotation_colour(kind: Column, in_gold: Column) -> Column:
    """Colour of a gene by annotation type, else the gold colour, else null."""
    expr = F.lit(None).cast("string")
    expr = F.when(kind.isNull() & in_gold, GOLD_COLOUR).otherwise(expr)
    for word, colour in reversed(ANNOTATION_COLOURS):
        expr = F.when(kind.contains(word), colour).otherwise(expr)
    return expr


def parse_result_name(name: Column) -> dict[str, Column]:
    """Columns encoded in a result file name.

    ``<classifier>_<feature>_<feature>_…len<L>_overlap<NN>…IDs.test.<variant>.eval.metrics``
    """
    parts = F.split(name, "_")
    raw = F.replace(
        F.replace(F.split_part(name, F.lit("IDs.test."), F.lit(2)), F.lit("eval.metrics"), F.lit("")),
        F.lit("."),
        F.lit(""),
    )
    variant = F.when(raw == "", "succ0").otherwise(F.replace(raw, F.lit("similar"), F.lit("sim")))
    variant = F.when(
        variant.contains("merge"), F.replace(variant, F.lit("succ"), F.lit(""))
    ).otherwise(variant)
    return {
        "features": F.concat_ws("+", F.get(parts, 1), F.get(parts, 2)),
        "classifier": F.get(parts, 0),
        "length": F.regexp_extract(name, r"len([^_]*)_", 1),
        "overlap": F.substring(F.regexp_extract(name, r"overlap([^_]*)", 1), 1, 2),
        "variant": variant,
    }
