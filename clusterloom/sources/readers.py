"""Readers. Record formats are split by a multi-character line separator, so large files stay
splittable; ``.gz`` files are decompressed by the reader. With ``stream`` a reader yields a stream of
the files that ``sources.incremental`` has not handled yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import scalar
from clusterloom.functions.protein import translate_dna
from clusterloom.operators.ordered import index_rows
from clusterloom.session import cut_lineage

# Column layouts of the alignment and domain-scan outputs.
BLAST_SCHEMA = (
    "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, "
    "qstart int, qend int, sstart int, send int, evalue double, bitscore double, qcovs double"
)
DOMAIN_HIT_FIELDS = (
    ("seq_id", "string"), ("ali_start", "int"), ("ali_end", "int"), ("env_start", "int"),
    ("env_end", "int"), ("hmm_acc", "string"), ("hmm_name", "string"), ("type", "string"),
    ("hmm_start", "int"), ("hmm_end", "int"), ("hmm_length", "int"), ("bit_score", "double"),
    ("evalue", "double"), ("significance", "int"), ("clan", "string"), ("active_site", "string"),
)
GFF_SCHEMA = (
    "seqid string, source string, type string, start int, `end` int, score string, "
    "strand string, phase string, attributes string"
)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that has fewer splits than the cluster has cores.

    A large input already has more splits and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _reader(spark: SparkSession, ext: str | None, stream: bool = False):
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", f"*.{ext}") if ext else reader


def list_files(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """Files below ``path`` with the extension: ``file, size``. Content is not read."""
    return (
        _reader(spark, ext).format("binaryFile").load(path)
        .select(F.col("path").alias("file"), F.col("length").alias("size"))
    )


def read_lines(spark: SparkSession, path: str, ext: str | None = None, stream: bool = False) -> DataFrame:
    return _reader(spark, ext, stream).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.rtrim("value").alias("line"))


def _records(spark: SparkSession, path: str, ext: str | None, separator: str, stream: bool = False) -> DataFrame:
    return _reader(spark, ext, stream).option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("record"))


def read_headed_records(spark: SparkSession, path: str, ext: str | None, stream: bool = False) -> DataFrame:
    """``>header`` records: ``file, header, body`` (body lines joined by line breaks)."""
    cut = F.regexp_replace("record", r"^\s*>?", "")
    return (
        _records(spark, path, ext, "\n>", stream).select("file", cut.alias("_r"))
        .select("file", F.trim(F.split_part("_r", F.lit("\n"), F.lit(1))).alias("header"),
                F.regexp_replace(F.regexp_extract("_r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s+$", "").alias("body"))
        .filter(F.col("header") != "")
    )


def read_fasta(spark: SparkSession, path: str, ext: str | None = "fasta", stream: bool = False) -> DataFrame:
    """``file, seq_id, seq``; the id is the first word of the header."""
    return read_headed_records(spark, path, ext, stream).select(
        "file", F.split_part("header", F.lit(" "), F.lit(1)).alias("seq_id"),
        F.regexp_replace("body", r"\s", "").alias("seq"))


def read_genbank(spark: SparkSession, path: str, ext: str | None = "gbk", stream: bool = False) -> DataFrame:
    """``file, record_id, organism, seq, cds`` per record; ``cds`` are the feature texts."""
    grab = lambda pattern: F.regexp_extract("record", pattern, 1)
    own = lambda c: F.when(c != "", c)
    sequence = F.upper(F.regexp_replace(grab(r"(?s)\nORIGIN[^\n]*\n(.*)$"), r"[\s\d/]", ""))
    return (
        _records(spark, path, ext, "\n//", stream)
        .filter(F.col("record").contains("LOCUS"))
        .select(
            "file",
            F.coalesce(own(grab(r"(?m)^VERSION\s+(\S+)")), own(grab(r"(?m)^ACCESSION\s+(\S+)")),
                       grab(r"(?m)^LOCUS\s+(\S+)")).alias("record_id"),
            grab(r"(?m)^  ORGANISM\s+([^\n]*)").alias("organism"), sequence.alias("seq"),
            F.regexp_extract_all(
                "record", F.lit(r"(?ms)(^     CDS .*?)(?=^     \S|^\S|\z)"), F.lit(1)).alias("cds"))
    )


def _qualifier(feature: Column, name: str, joiner: str = " ") -> Column:
    return F.regexp_replace(F.regexp_extract(feature, f'/{name}="([^"]*)"', 1), r"\n\s*", joiner)


def genbank_proteins(records: DataFrame) -> DataFrame:
    """Protein entries of all CDS, exact duplicates removed: ``header, seq``.

    Header ``locus|species|id|description``; the id is the locus tag, else the gene, else the
    protein id; the description is the product and, when given, the function.
    """
    cds = records.select("file", "record_id", F.explode("cds").alias("_f"))
    q = lambda name: _qualifier(F.col("_f"), name)
    usable = lambda c: F.when(F.length(c) > 1, c)
    name = F.coalesce(usable(q("locus_tag")), usable(q("gene")),
                      usable(F.replace(q("protein_id"), F.lit("/"), F.lit(""))), F.lit(""))
    function = q("function")
    description = F.concat(F.trim(q("product")), F.when(F.trim(function) != "", F.concat(F.lit("|"), function)).otherwise(""))
    return cds.select(
        F.concat_ws("|", "record_id", scalar.species_from_path(F.col("file")), name, description).alias("header"),
        _qualifier(F.col("_f"), "translation", "").alias("seq")).dropDuplicates()


def genbank_translations(records: DataFrame) -> DataFrame:
    """Per record: ``seq_id`` (id and region suffix of the file), translated whole sequence and
    concatenated CDS translations."""
    region = F.regexp_extract("file", r"region(.*)\.gbk", 1)
    joined = F.array_join(F.transform("cds", lambda f: _qualifier(f, "translation", "")), "")
    return records.select(
        F.concat("record_id", region).alias("seq_id"), "organism",
        translate_dna(F.col("seq")).alias("protein"), joined.alias("cds_protein"))


def read_gff(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """Feature rows; of a repeated attribute key the first value stands."""
    rows = _reader(spark, ext).schema(GFF_SCHEMA).csv(path, sep="\t", comment="#", quote="")
    pairs = F.transform(F.split("attributes", ";"), lambda a: F.struct(
        F.split_part(a, F.lit("="), F.lit(1)).alias("key"), F.get(F.split(a, "=", 2), F.lit(1)).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return rows.withColumn("attributes", F.map_from_entries(first))


def mrna_features(gff: DataFrame) -> DataFrame:
    """mRNA features keyed by name (version ``.1`` removed), one row per name."""
    name = F.regexp_replace(F.col("attributes")["Name"], r"\.1$", "")
    return gff.filter("type = 'mRNA'").groupBy(name.alias("name")).agg(
        F.min(F.struct("seqid", "start", "end", "strand", "phase")).alias("_f")).select("name", "_f.*")


def read_blast(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    return _reader(spark, ext).schema(BLAST_SCHEMA).csv(path, sep="\t", quote="")


def read_domain_hits(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """Whitespace table of domain hits; comment and blank lines are skipped."""
    lines = read_lines(spark, path, ext).select(F.trim("line").alias("line"))
    fields = F.split("line", r"\s+")
    return lines.filter((F.col("line") != "") & ~F.col("line").rlike("^[#>]")).select(
        *[F.get(fields, F.lit(i)).try_cast(kind).alias(name)
          for i, (name, kind) in enumerate(DOMAIN_HIT_FIELDS)])


def read_dataset(
    spark: SparkSession, path: str, feature_types: str, source_type: str = "aminoacid",
    per_domain: bool = False, by_folder: bool = False,
) -> DataFrame:
    """Contents of all wanted types: ``file, instance_id, feature_type, content``.

    Types are told by file extension, or with ``by_folder`` by the sub-folder of that name
    (as Spark writes them). ``per_domain`` gives one row per domain line. A wanted type
    without files is an error.
    """
    out: list[DataFrame] = []
    name = scalar.strip_version(F.col("header")).alias("instance_id")

    def load(ext: str) -> DataFrame:
        if by_folder:
            rows = read_headed_records(spark, f"{path}/{ext}", None)
        else:
            rows = read_headed_records(spark, path, ext)
        if rows.isEmpty():
            raise ValueError(f"no .{ext} files with records in {path}")
        return rows

    def typed(rows: DataFrame, kind: str, content: Column) -> DataFrame:
        return rows.select("file", name, F.lit(kind).alias("feature_type"), content.alias("content"))

    if "domain" in feature_types or "dictionary" in feature_types:
        rows = load("domains")
        lines = F.transform(F.split("body", "\n"), scalar.strip_version)
        if per_domain:
            out.append(rows.select("file", name, F.lit("domains").alias("feature_type"),
                                   F.explode(lines).alias("content")))
        else:
            kept = typed(rows, "domains", F.array_join(lines, "\n"))
            out.append(kept.filter(F.col("content") != ""))
    if "kmers" in feature_types or "prot" in feature_types:
        rows = load("fasta")
        seq = scalar.normalize_sequence(F.upper(F.regexp_replace("body", r"\s", "")), source_type)
        if "kmers" in feature_types:
            out.append(typed(rows, "kmers", seq))
        if "prot" in feature_types:
            out.append(typed(rows, "protanalys", seq))
    if "go" in feature_types:
        out.append(typed(load("go"), "go", F.col("body")))
    if not out:
        raise ValueError(f"no known feature type in {feature_types!r}")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", schema="cluster_id string, gene string")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``pos, genes, score`` in the order of the sorted lines; empty genes removed."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    parsed = lines.select(
        "value", F.monotonically_increasing_id().alias("_tie"),
        F.filter(F.split(F.split_part("value", F.lit("\t"), F.lit(1)), r"\|"), lambda g: g != "").alias("genes"),
        F.split_part("value", F.lit("\t"), F.lit(2)).cast("double").alias("score"))
    return index_rows(parsed, [], ["value", "_tie"]).select("pos", "genes", "score")


def read_scores(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    """Score table from ``threshold`` on; header and blank lines are dropped."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(f, F.lit(0)).alias("gold_cluster_id"), F.get(f, F.lit(1)).alias("predicted_cluster_id"),
        F.get(f, F.lit(2)).try_cast("double").alias("cluster_score"),
        F.split(F.get(f, F.lit(3)), r"\|").alias("genes")).filter(F.col("cluster_score") >= threshold)


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, pident``: the highest identity per pair."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="id string, pident double, bitscore double, qcovs double")
    return rows.groupBy(F.split_part("id", F.lit("|"), F.lit(1)).alias("a"),
                        F.split_part("id", F.lit("|"), F.lit(2)).alias("b")).agg(F.max("pident").alias("pident"))


def read_ontology_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", schema="entry string, goids string")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Features: column two when tabbed (one-character ones skipped), else the line."""
    tabbed = F.col("value").contains("\t")
    second = F.split_part("value", F.lit("\t"), F.lit(2))
    return spark.read.text(path).filter(~tabbed | (F.length(second) > 1)).select(
        F.when(tabbed, second).otherwise(F.col("value")).alias("feature"))


def read_gene_lengths(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", quote="", schema="gene string, length long")
    return rows.select(scalar.strip_version(F.col("gene")).alias("gene"), "length")


def read_list(spark: SparkSession, path: str, name: str = "domain") -> DataFrame:
    return spark.read.text(path).filter(F.col("value") != "").select(F.col("value").alias(name))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="domain string, type string")


def read_target_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Key and value of a two-column list; spaces become underscores."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="key string, value string")
    return rows.select(*[F.translate(c, " ", "_").alias(c) for c in ("key", "value")])


def read_rewards(spark: SparkSession, path: str) -> DataFrame:
    """``domain, rewards ARRAY<INT>`` from ``ACC.ver|name`` or plain names."""
    key = F.split_part("value", F.lit("\t"), F.lit(1))
    labels = F.split(F.split_part("value", F.lit("\t"), F.lit(2)), ",")
    return spark.read.text(path).select(
        scalar.strip_version(F.split_part(key, F.lit("|"), F.lit(1))).alias("domain"),
        F.transform(labels, lambda x: x.cast("int")).alias("rewards"))


def long_rewards(rewards: DataFrame) -> DataFrame:
    """One row per domain and file ordinal: ``domain, file, reward``."""
    return rewards.select("domain", F.posexplode("rewards").alias("file", "reward"))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` with ``_at``, which orders lines by file and place."""
    return spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias("_at"))


def read_orthogroups(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``group_id, members`` split on tab, ``;`` and ``,``; the first line of a file is its
    header; optionally only the first groups, in the order of the files."""
    parts = F.transform(F.split("value", "[\t;,]"), lambda p: F.trim(p))
    lines = _file_lines(spark, path)
    headers = lines.groupBy("_at.file").agg(F.min("_at").alias("_at")).select("_at")
    rows = lines.join(headers, "_at", "left_anti").select(
        F.get(parts, F.lit(0)).alias("group_id"),
        F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda m: m != "").alias("members"), "_at")
    return (rows.orderBy("_at").limit(limit) if limit else rows).drop("_at")


def read_word_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``feature, vector`` of a text vector file; the count line is skipped.

    Vector files are sorted by frequency: ``limit`` keeps the first lines in the order of the
    files, found by their numbers alone.
    """
    parts = F.split(F.rtrim("value"), " ")
    lines = _file_lines(spark, path).filter(F.size(parts) > 2)
    if limit:
        first = index_rows(lines.select("_at"), [], ["_at"]).filter(F.col("pos") < limit).select("_at")
        lines = lines.join(first, "_at", "left_semi")
    return lines.select(
        F.get(parts, F.lit(0)).alias("feature"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vector"))


def summarize_metrics(spark: SparkSession, path: str, ext: str = "metrics") -> DataFrame:
    """One row per metrics file: name fields and the ``pos`` metric line, sorted by name.

    A file is named by itself or, where a writer made it a folder, by that; ``pos`` is the two
    characters after the first ``pos`` of ``path``.
    """
    lines = _reader(spark, None).text(path).select(
        F.url_decode("_metadata.file_path").alias("file"), F.rtrim("value").alias("line")).filter(F.col("line").startswith("pos\t"))
    # Cut here, as a sort reads its input twice and opening the files is most of the work.
    named = cut_lineage(lines.select(
        F.regexp_extract("file", rf"([^/=]*\.{ext})(/[^/]*)?$", 1).alias("name"),
        F.regexp_replace("line", "^pos\t", "").alias("metrics")).filter("name <> ''"))
    fields = scalar.parse_result_name(F.col("name"))
    share = path.split("pos")[1][:2] if "pos" in path else ""
    return named.select("name", *(c.alias(n) for n, c in fields.items()), F.lit(share).alias("pos"), "metrics").orderBy("name")


def read_policy_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of a trained policy: ``id, rewardKeep, rewardSkip, qvalueKeep, qvalueSkip``."""
    return spark.read.option("sep", "\t").option("header", "true").schema(
        "id string, rewardKeep double, rewardSkip double, qvalueKeep double, qvalueSkip double").csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report as the report sink wrote it, one object a line; ``schema`` fixes the types."""
    return spark.read.schema(schema).json(path)
