"""Protein property and translation queries over the letters of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.functions import protein as pr

PROTEINS = """prots AS (
  SELECT doc_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS seq
  FROM documents)"""
BASES = "ACGTACGTACGTACGTACGTACGTAC"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def proteins(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.upper(F.regexp_replace(
        "text", "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", "")).alias("seq"))


def _values(mapping) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in mapping.items())


@query("protein_composition", f"""
WITH {PROTEINS}, mass(r, m) AS (VALUES {_values(pr.RESIDUE_MASS)}),
hydro(r, h) AS (VALUES {_values(pr.HYDROPATHY)}),
letters AS (SELECT doc_id, unnest(string_split(seq, '')) AS r FROM prots WHERE seq <> ''),
counts AS (SELECT doc_id, r, count(*) AS c FROM letters GROUP BY ALL),
agg AS (
  SELECT doc_id, sum(c) AS n, sum(c * m) AS mw, sum(c * h) AS gv,
         coalesce(sum(c) FILTER (r IN ('Y','W','F')), 0) AS ar,
         coalesce(sum(c) FILTER (r IN ('V','I','Y','F','W','L')), 0) AS hx,
         coalesce(sum(c) FILTER (r IN ('N','P','G','S')), 0) AS tu,
         coalesce(sum(c) FILTER (r IN ('E','M','A','L')), 0) AS sh
  FROM counts JOIN mass USING (r) JOIN hydro USING (r) GROUP BY doc_id)
SELECT doc_id, round((mw - (n - 1) * {pr.WATER_MASS})::DOUBLE, 4) AS weight,
       round((ar / n)::DOUBLE, 6) AS aromaticity, round((gv / n)::DOUBLE, 6) AS gravy,
       round((hx / n)::DOUBLE, 6) AS helix, round((tu / n)::DOUBLE, 6) AS turn,
       round((sh / n)::DOUBLE, 6) AS sheet
FROM prots LEFT JOIN agg USING (doc_id)""")
def protein_composition(spark, sf):
    c = pr.composition(F.col("seq"))
    r = lambda name, digits=6: F.round(c[name], digits)
    return proteins(spark, sf).select(
        "doc_id", r("proteinMWeight", 4).alias("weight"), r("proteinAroma").alias("aromaticity"),
        r("proteinGravy").alias("gravy"), r("proteinSecstruc-1").alias("helix"),
        r("proteinSecstruc-2").alias("turn"), r("proteinSecstruc-3").alias("sheet"))


@query("protein_flexibility", f"""
WITH {PROTEINS}, flex(r, f) AS (VALUES {_values(pr.FLEXIBILITY)}),
wins AS (SELECT doc_id, i, substr(seq, i, 9) AS w
         FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 8)) AS i FROM prots)),
seats(j, wt) AS (VALUES (1, 0.25), (2, 0.4375), (3, 0.625), (4, 0.8125), (9, 0.25), (8, 0.4375),
                 (7, 0.625), (6, 1.8125)),
scored AS (SELECT doc_id, i, any_value(substr(w, 1, 1)) AS residue, sum(f * wt)::DOUBLE / 5.25 AS score
           FROM (SELECT doc_id, i, w, j, wt, substr(w, j, 1) AS r FROM wins, seats) JOIN flex USING (r)
           GROUP BY doc_id, i)
SELECT doc_id, 'protein-' || residue AS feature, round(sum(score), 5) AS value
FROM scored GROUP BY doc_id, residue""")
def protein_flexibility(spark, sf):
    return pr.flexibility_by_residue(proteins(spark, sf), ["doc_id"], "seq").select(
        "doc_id", "feature", F.round("value", 5).alias("value"))


DIPEPTIDE_RULE = "(ascii(substr(d, 1, 1)) * 7 + ascii(substr(d, 2, 1)) * 3) % 50 - 15"


@query("protein_instability", f"""
WITH {PROTEINS},
pairs AS (SELECT doc_id, n, substr(seq, i, 2) AS d FROM (
  SELECT doc_id, length(seq) AS n, seq, unnest(range(1, length(seq))) AS i FROM prots))
SELECT doc_id, round(10.0::DOUBLE / n * sum({DIPEPTIDE_RULE}), 5) AS instability
FROM pairs GROUP BY doc_id, n""")
def protein_instability(spark, sf):
    """The published 400-value table is a parameter; a rule over the seen dipeptides fills it here."""
    from clusterloom.functions.tokens import explode_kmers

    seqs = proteins(spark, sf)
    seen = explode_kmers(seqs.select("seq"), "seq", 2, "dipeptide").distinct()
    code = lambda i: F.ascii(F.substring("dipeptide", i, 1))
    weights = seen.withColumn("weight", ((code(1) * 7 + code(2) * 3) % 50 - 15).cast("double"))
    return pr.dipeptide_index(seqs, ["doc_id"], "seq", weights).select(
        "doc_id", F.round("instability", 5).alias("instability"))


def _pk(col: str, mapping, default) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default}::DOUBLE END"


def _count(r: str) -> str:
    return f"(length(seq) - length(replace(seq, '{r}', '')))"


_up = lambda pk: f"(pow(10.0::DOUBLE, {pk} - ph) / (pow(10.0::DOUBLE, {pk} - ph) + 1))"
_down = lambda pk: f"(pow(10.0::DOUBLE, ph - {pk}) / (pow(10.0::DOUBLE, ph - {pk}) + 1))"
CHARGE = (
    _up("nt")
    + "".join(f" + n_{r} * {_up(pr.POSITIVE_PK[r])}" for r in "KRH")
    + f" - {_down('ct')}"
    + "".join(f" - n_{r} * {_down(pr.NEGATIVE_PK[r])}" for r in "DECY")
)


@query("protein_isoelectric_point", f"""
WITH RECURSIVE {PROTEINS},
facts AS (SELECT doc_id, {", ".join(f"{_count(r)} AS n_{r}" for r in "KRHDECY")},
  {_pk("substr(seq, 1, 1)", pr.N_TERMINAL_PK, pr.POSITIVE_PK["Nterm"])} AS nt,
  {_pk("substr(seq, length(seq), 1)", pr.C_TERMINAL_PK, pr.NEGATIVE_PK["Cterm"])} AS ct
  FROM prots WHERE seq <> ''),
steps AS (
  SELECT doc_id, 0 AS i, {pr.PI_LOW}::DOUBLE AS lo, {pr.PI_HIGH}::DOUBLE AS hi, {pr.PI_START}::DOUBLE AS ph FROM facts
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN q > 0 THEN ph ELSE lo END, CASE WHEN q > 0 THEN hi ELSE ph END,
         (CASE WHEN q > 0 THEN ph ELSE lo END + CASE WHEN q > 0 THEN hi ELSE ph END) / 2
  FROM (SELECT s.*, {CHARGE} AS q FROM steps s JOIN facts USING (doc_id)) WHERE i < {pr.PI_STEPS})
SELECT doc_id, round(ph, 3) AS pi FROM prots LEFT JOIN (SELECT * FROM steps WHERE i = {pr.PI_STEPS}) USING (doc_id)""")
def protein_isoelectric_point(spark, sf):
    return proteins(spark, sf).select(
        "doc_id", F.round(pr.isoelectric_point(F.col("seq")), 3).alias("pi"))


def dna(spark, sf):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf, "documents").select(
        "doc_id", F.translate(letters, LETTERS, BASES).alias("dna"))


@query("six_frame_translation", f"""
WITH d AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS dna
           FROM documents),
strands AS (SELECT doc_id, 1 AS sign, dna FROM d
            UNION ALL SELECT doc_id, -1, reverse(translate(dna, 'ACGT', 'TGCA')) FROM d),
frames AS (SELECT doc_id, sign * f AS frame, substr(dna, f) AS s FROM strands, (VALUES (1), (2), (3)) t(f)),
codons AS (SELECT doc_id, frame, i, substr(s, i * 3 + 1, 3) AS c
           FROM (SELECT doc_id, frame, s, unnest(range(0, length(s) // 3)) AS i FROM frames)),
aas AS (SELECT doc_id, frame, string_agg(substr('{pr.CODON_TABLE}',
          ((strpos('TCAG', substr(c, 1, 1)) - 1) * 16 + (strpos('TCAG', substr(c, 2, 1)) - 1) * 4
           + strpos('TCAG', substr(c, 3, 1)))::INT, 1), '' ORDER BY i) AS protein
        FROM codons GROUP BY doc_id, frame)
SELECT doc_id, frame, md5(coalesce(protein, '')) AS digest FROM frames LEFT JOIN aas USING (doc_id, frame)""")
def six_frame_translation(spark, sf):
    return pr.six_frames(dna(spark, sf), "dna").select(
        "doc_id", "frame", F.md5(F.col("protein").cast("binary")).alias("digest"))
