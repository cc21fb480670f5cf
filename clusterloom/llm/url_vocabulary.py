"""URL filter with a weighted vocabulary and host rules (operator 5).

One Aho-Corasick automaton finds all terms in the lower-cased URL. A hit counts if no letter or
digit touches it. One strict term blocks; soft terms block once the weights of the *distinct*
ones reach ``soft_limit``. Host and path rules come first; the longest fitting rule decides.

Edge cases: a null URL, or one without ``://``, has an empty host and path; a null URL has no
hits and is allowed. Repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value

by_value(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STRICT = ("porn", "porno", "xxx", "hentai", "viagra", "cialis", "casino", "escort", "camgirls", "warez")
#: Weight of each soft term; one alone does not block.
SOFT = {
    "adult": 1.0, "bet": 1.0, "betting": 1.0, "bonus": 1.0, "cheap": 1.0, "crack": 1.0, "dating": 1.0,
    "discount": 1.0, "farm": 1.0, "free": 1.0, "jackpot": 1.0, "keygen": 1.0, "loan": 1.0, "loans": 1.0,
    "nude": 1.0, "pharma": 1.0, "pills": 1.0, "poker": 1.0, "replica": 1.0, "sex": 1.0, "sexy": 1.0,
    "slots": 1.0, "spam": 1.0, "torrent": 1.0, "win": 1.0,
}


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def judge(
    pages: DataFrame, rules: Mapping[str, str], *, strict: Sequence[str] = STRICT,
    soft: Mapping[str, float] = SOFT, soft_limit: float = 2.0,
) -> DataFrame:
    """``(page_id, url)`` to ``page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight``.

    ``rules`` maps a host and path prefix such as ``example.org/fr/`` to ``allow`` or ``block``.
    ``n_strict`` counts hits, ``n_soft`` distinct terms.
    """
    weights = {**{t: -1.0 for t in strict}, **{t: w for t, w in soft.items() if t not in set(strict)}}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            machine.add_word(term, (term, weight))
        if weights:
            machine.make_automaton()
        for batch in batches:
            hard, distinct, total = [], [], []
            for url in batch.column(1).to_pylist():
                low = (url or "").lower()
                n, found = 0, {}
                for end, (term, weight) in machine.iter(low) if weights and low else ():
                    first = end - len(term) + 1
                    if (first and low[first - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                        continue
                    if weight < 0:
                        n += 1
                    else:
                        found[term] = weight
                hard.append(n)
                distinct.append(len(found))
                total.append(float(sum(found.values())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hard, pa.int64()), pa.array(distinct, pa.int64()), pa.array(total, pa.float64())],
                ["page_id", "url", "n_strict", "n_soft", "soft_weight"])

    kind = pages.schema["page_id"].dataType.simpleString()
    counted = pages.select("page_id", "url").mapInArrow(
        count, f"page_id {kind}, url string, n_strict long, n_soft long, soft_weight double")
    host, path = host_path(F.col("url"))
    out = counted.select("*", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for name in sorted(rules, key=len):  # the longest is tested first
        test = fits(name, F.col("host"), F.col("path"))
        rule = F.when(test, name).otherwise(F.lit(None) if rule is None else rule)
    rule = F.lit(None).cast("string") if rule is None else rule
    verdict = F.when((F.col("n_strict") > 0) | (F.col("soft_weight") >= soft_limit), "block").otherwise("allow")
    for name, said in rules.items():
        verdict = F.when(F.col("rule") == name, said).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("verdict", verdict).select(
        "page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight")
