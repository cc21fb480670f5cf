"""Writers. Each writes a folder of part files; rows are never gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tsv(df: DataFrame, path: str, header: bool = True) -> None:
    # Lines are read back as plain text: no quotes, no escapes.
    df.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="", emptyValue="", nullValue="")


def write_fasta(df: DataFrame, id_col: str | Column, seq_col: str | Column, path: str, sort: bool = False) -> None:
    """``>id`` and sequence per record; ``sort`` orders records by id over all files."""
    rows = df.orderBy(id_col) if sort else df
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows.select(
        F.concat(F.lit(">"), as_col(id_col).cast("string"), F.lit("\n"), as_col(seq_col))
    ).write.mode("overwrite").text(path)


def annotation_records(lines: DataFrame, instances: DataFrame) -> DataFrame:
    """One record text per instance that has annotation lines: ``instance_id, record``.

    ``lines`` rows are ``instance_id, pos, line``.
    """
    bodies = lines.groupBy("instance_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))),
                                 lambda e: e["line"]), "\n").alias("body"))
    return instances.select("instance_id").join(bodies, "instance_id", "left").select(
        "instance_id",
        F.when(F.col("body").isNotNull(),
               F.concat(F.lit(">"), F.col("instance_id").cast("string"), F.lit("\n"), "body")).alias("record"))


def write_annotations(records: DataFrame, path: str, per_instance: bool = False) -> None:
    found = records.filter(F.col("record").isNotNull())
    if per_instance:
        found.write.mode("overwrite").partitionBy("instance_id").text(path)
    else:
        found.select("record").write.mode("overwrite").text(path)


def annotation_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(F.col("record").isNotNull()).alias("found"),
        F.count_if(F.col("record").isNull()).alias("not_found"))


def domain_lines(hits: DataFrame) -> DataFrame:
    """``acc|name`` lines of domain hits in alignment order: ``instance_id, pos, line``."""
    return hits.select(
        F.col("seq_id").alias("instance_id"), F.col("ali_start").alias("pos"),
        F.concat_ws("|", "hmm_acc", "hmm_name").alias("line"))


def labelled_domains(lines: DataFrame, label: Column) -> DataFrame:
    """The seven-column labelled domain table."""
    zero = F.lit(0)
    return lines.select(
        F.col("instance_id").cast("string").alias("sequence_id"),
        F.split_part("line", F.lit("|"), F.lit(2)).alias("protein_id"),
        zero.alias("gene_start"), zero.alias("gene_end"), zero.alias("gene_strand"),
        F.split_part("line", F.lit("|"), F.lit(1)).alias("pfam_id"), label.alias("in_cluster"))


def write_labelled_domains(df: DataFrame, path: str) -> None:
    """Positives and negatives in separate folders."""
    df.write.mode("overwrite").partitionBy("in_cluster").csv(path, sep="\t", header=True)


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, header: bool = True) -> None:
    """Plain table sink: features, counts, similarities, predictions, Q statistics."""
    _tsv(df.select(*columns) if columns else df, path, header)


def write_predictions(df: DataFrame, path: str) -> None:
    """``g1|g2|…`` and score per line."""
    _tsv(df.select(F.array_join("genes", "|").alias("genes"), "score"), path, header=False)


def write_scores(df: DataFrame, path: str) -> None:
    """Ranked score table with all four columns named."""
    _tsv(df.withColumn("genes", F.array_join("genes", "|")), path)


def gff_lines(df: DataFrame, source: str, note: Column, name: Column, colour: Column | None = None) -> DataFrame:
    """GFF3 feature lines: ``line``."""
    info = F.concat(F.lit("Name="), name, F.lit(";Note="), note)
    if colour is not None:
        info = F.concat(info, F.coalesce(F.concat(F.lit(";color="), colour), F.lit("")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws(
        "\t", text("seqid"), F.lit(source), text("start"), text("end"), F.lit("?"), text("strand"), text("phase"),
        F.coalesce(info, F.concat(F.lit("Name="), name), F.lit("."))
    ).alias("line"))


def write_gff(lines: DataFrame, path: str) -> None:
    """Feature lines under the version header; one part per task, header first in each."""
    # A separator that no line holds keeps every line one unquoted field.
    lines.withColumnRenamed("line", "##gff-version 3").write.mode("overwrite").option(
        "comment", "\u0002").csv(path, header=True, sep="\u0001", quote="", escape="")


def write_table(df: DataFrame, path: str) -> None:
    """Typed table persistence: Q table, reward table, vocabulary, state map."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
