"""Licence scan by canonical digests, in DataFrame operations only.

A text is normalised line by line: A-Z folded, copyright statements dropped (lines that go on with a year, a sign, a name in
brackets or 'by', and 'all rights reserved'), equivalent spellings made one, everything that is not a letter or digit made a
single space. Lines are then joined, so how a text is wrapped doesn't matter. The SHA-256 of the whole normalised text is looked up among the digests of known
licence texts, and each line's, which is an entire notice, among those of known notices: equi-joins on the digest.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import LOWER, UPPER, ascii_lower, cut, table, text_of
from mapgauge.llm.license_texts import ALSO, FILES, NOTICES, TEXTS, TITLES

COPYRIGHT = r"^[ \t\r*#/;-]*(copyright[ \t]*:?[ \t]*(\(c\)|©|[0-9]{4}|by |<|\[|\{)|\(c\)|©|all rights reserved[. \t\r]*$)"
NOISE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{2010}-\x{201F}©®]+"
#: Spellings that mean the same, on lower-cased text.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("authorisation", "authorization"), ("whilst", "while"), ("favour", "favor"), ("&", " and "))


def _line(line: Column) -> Column:
    for a, b in SPELLINGS:
        line = F.replace(line, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(line, NOISE, " "))


def canonical_lines(text: Column) -> Column:
    """The normalised lines that aren't empty."""
    lines = F.filter(F.split(ascii_lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    return F.filter(F.transform(lines, _line), lambda x: x != "")


def canonical(text: str) -> list[str]:
    """canonical_lines for one text, for building tables of known licences."""
    out = []
    for line in text.translate(str.maketrans(UPPER, LOWER)).split("\n"):
        if re.search(COPYRIGHT, line):
            continue
        for a, b in SPELLINGS:
            line = line.replace(a, b)
        line = re.sub(NOISE.replace(r"\x{2010}-\x{201F}", "‐-‟"), " ", line).strip(" ")
        out += [line] if line else []
    return out


def variants(text: str, titles: tuple[str, ...] = ()) -> list[str]:
    """The canonical forms of a text without a title and with each of its usual ones."""
    body = " ".join(canonical(text))
    return [body, *(f"{' '.join(canonical(t))} {body}" for t in titles)]


def known_digests(texts: dict[str, str] = TEXTS, notices: dict = NOTICES, files: dict[str, str] = FILES) -> list[tuple[str, str, str]]:
    """(kind, licence, digest) of known texts, files and notices."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole = [("text", k, sha(x)) for k, v in texts.items() for wording in (v, *ALSO.get(k, ())) for x in variants(wording, TITLES.get(k, ()))]
    whole += [("text", k, d) for k, d in files.items()]
    return whole + [("notice", k, sha(" ".join(canonical(v)))) for k, all_ in notices.items() for v in all_]


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text", known: DataFrame | None = None) -> DataFrame:
    """A row a document: id, text_digest, license_id (whole text; null if none), notices (licences named by a line, in
    order, comma-joined).

    known: kind ('text' or 'notice'), license_id, digest; by default the built-in list. Null text is empty and matches
    nothing unless known has the digest of the empty text. Rows with equal identifier and text give equal rows. If several
    licences share a digest the first by name counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(known_digests(), "kind string, license_id string, digest string")
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), canonical_lines(text_of(text_col)).alias("lines"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    light = cut(lines.select("id", digest(F.array_join("lines", " ")).alias("text_digest"), F.transform(F.array_distinct("lines"), lambda x: F.unhex(digest(x))).alias("line_digests")))
    whole = known.where("kind = 'text'").groupBy(F.col("digest").alias("text_digest")).agg(F.min("license_id").alias("license_id"))
    notices = known.where("kind = 'notice'").groupBy(F.unhex("digest").alias("line")).agg(F.min("license_id").alias("notice"))
    hits = light.select("id", "text_digest", F.explode("line_digests").alias("line")).join(notices, "line")
    hits = hits.groupBy(F.col("id").alias("h_id"), F.col("text_digest").alias("h_digest")).agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"))
    out = light.drop("line_digests").join(whole, "text_digest", "left")
    out = out.join(hits, out["id"].eqNullSafe(F.col("h_id")) & (out["text_digest"] == F.col("h_digest")), "left")
    return out.select(F.col("id").alias(id_col), "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def op10_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    line = "x"
    for a, b in SPELLINGS:
        line = f"replace({line}, '{a}', '{b}')"
    known = ", ".join(f"('{k}', '{i}', '{d}')" for k, i, d in known_digests())
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
    WITH known(kind, license_id, digest) AS (VALUES {known}),
    l AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split({lower}, chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT}')),
            lambda x: trim(regexp_replace({line}, '{NOISE}', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents),
    d AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest, list_transform(lines, lambda x: sha256(x)) AS ds FROM l),
    n AS (SELECT DISTINCT doc_id, text_digest, license_id FROM (SELECT doc_id, text_digest, unnest(ds) AS digest FROM d) JOIN known USING (digest) WHERE kind = 'notice'),
    a AS (SELECT doc_id, text_digest, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM n GROUP BY ALL)
    SELECT d.doc_id, d.text_digest, k.license_id, coalesce(a.notices, '') AS notices
    FROM d LEFT JOIN known k ON k.kind = 'text' AND k.digest = d.text_digest LEFT JOIN a ON a.doc_id = d.doc_id AND a.text_digest = d.text_digest"""


ORACLE = _oracle()
