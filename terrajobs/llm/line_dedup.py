"""Repeated runs of lines, found by winnowing over line hashes. DataFrame functions only.

In every window of ``run`` consecutive non-blank lines, and in every shorter one of 50 words
or more that holds no such window, the line of smallest hash is a fingerprint, so any two equal windows share one. Fingerprints that occur
once are dropped; each other one is extended both ways to the aligned windows around it, and a window that occurs earlier marks its lines. A longer repeated run is
the union of its windows, so exactly the lines of later repeated runs go. Windows meet
their first occurrence only, never each other, so nothing grows with the square of a run's
copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrajobs.llm.common import split_by_ids
from terrajobs.storage import stash

RUN = 3
LONG_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


SPACES = " \t\x0b\f\r"


def _body(line: Column) -> Column:
    """A line without ASCII white space around it; blank lines have none."""
    return F.btrim(line, F.lit(SPACES))


def _words(body: Column) -> Column:
    """How many words a body has: in plain lines one more than spaces."""
    odd = F.contains(body, F.lit("  "))
    for c in SPACES[1:]:
        odd = odd | F.contains(body, F.lit(c))
    plain = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit(""))) + 1
    return F.when(odd, F.size(F.split(body, "[ \\t\\x0B\\f\\r]+"))).otherwise(plain)


def fingerprints(documents: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, version, mark, windows): a row per fingerprint, with the aligned windows that
    hold it, each with its hash and its line numbers."""
    lines = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), _body(line).alias("body")))
    solid = F.transform(F.filter(lines, lambda x: x["body"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["body"]).alias("h"), _words(x["body"]).alias("w")))
    rows = documents.select("doc_id", F.xxhash64("text").alias("version"), solid.alias("solid")).filter(F.size("solid") > 0)
    rows = rows.withColumn("h", F.col("solid.h")).withColumn("i", F.col("solid.i")).withColumn("w", F.col("solid.w"))

    def smallest(j: Column) -> Column:  # 0-based place of the rightmost minimum of window j
        part = F.slice("h", j + 1, run)
        return (j + run - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), smallest))

    def window(s: Column, size: int = run) -> Column:
        return F.struct(F.xxhash64(F.slice("h", s + 1, size)).alias("key"), F.slice("i", s + 1, size).alias("lines"))

    def around(q: Column) -> Column:
        return F.transform(F.sequence(F.greatest(q - (run - 1), F.lit(0)), F.least(q, F.size("h") - run)), lambda s: window(s))

    def wordy(size: int) -> Column:  # shorter windows of many words are runs, too
        def words(s: Column, n: int) -> Column:
            return sum((F.element_at("w", s + k + 1) for k in range(n)), F.lit(0))

        starts = F.filter(F.sequence(F.lit(0), F.size("h") - size), lambda s: (words(s, size) >= LONG_WORDS) & (words(s, size - 1) < LONG_WORDS) & (words(s + 1, size - 1) < LONG_WORDS))
        each = F.transform(starts, lambda s: F.struct(F.array_min(F.slice("h", s + 1, size)).alias("mark"), F.array(window(s, size)).alias("windows")))
        return F.when(F.size("h") >= size, each)

    found = F.transform(chosen, lambda q: F.struct(F.element_at("h", q + 1).alias("mark"), around(q).alias("windows")))
    found = [F.when(F.size("h") >= run, found), *(wordy(size) for size in range(1, run))]
    found = F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return rows.select("doc_id", "version", F.explode(found).alias("f")).select("doc_id", "version", "f.mark", "f.windows")


def repeated_lines(documents: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, version, gone): line numbers of later repeated runs, per document with any."""
    prints = stash(fingerprints(documents, run), "fingerprints")
    often = prints.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    windows = prints.join(often, "mark").select("doc_id", "version", F.explode("windows").alias("w"))
    windows = stash(windows.select("doc_id", "version", F.col("w.key").alias("key"), F.col("w.lines").alias("lines")).distinct(), "windows")
    place = F.struct("doc_id", "version", F.col("lines")[0].alias("at"))
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "version", F.col("lines")[0].alias("at"))).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    later = windows.join(first, "key").filter(place != F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def dedup_lines(documents: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the new text in ``text_col``, and n_lines and n_removed (non-blank
    lines before, and lines deleted).

    Lines are equal if they are equal without ASCII white space around them; blank lines
    are skipped in runs and stay in the text. A run has ``run`` lines, or fewer lines with
    ``LONG_WORDS`` words or more together, but not without its first or its last line; it is repeated if the same lines occur earlier, in
    order of (id, position), in another text or further up in the same one. Null and empty
    texts and rows of a null id stay as they are, an empty table stays empty, and texts may
    have any length. Rows of equal id and text count as one document. Other columns are kept;
    columns of the input named n_lines or n_removed are replaced.
    """
    documents = documents.drop("n_lines", "n_removed")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("row"))
    base = rows.select("doc_id", "text").filter("doc_id is not null and text is not null")
    gone = stash(repeated_lines(base, run), "gone")
    solid = F.size(F.filter(_lines(F.col("text")), lambda line: _body(line) != ""))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(solid).cast("long"))
    hit, rest = split_by_ids(rows, "doc_id", gone, "doc_id")
    joined = hit.withColumn("version", F.xxhash64("text")).join(gone, ["doc_id", "version"], "left")
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    joined = joined.select("row", text.alias("text"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    both = joined.unionByName(rest.select("row", "text", "n_lines", F.lit(0).cast("long").alias("n_removed")))
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in documents.columns], "n_lines", "n_removed")


def _grams(size: int) -> str:
    lines, joins = [f"x{j}" for j in range(size)], "".join(f" JOIN solid x{j} ON x{j}.doc_id = x0.doc_id AND x{j}.k = x0.k + {j}" for j in range(1, size))
    words = lambda part: " + ".join([f"{x}.words" for x in part] or ["0"])
    least = "" if size == RUN else f" WHERE {words(lines)} >= {LONG_WORDS} AND {words(lines[1:])} < {LONG_WORDS} AND {words(lines[:-1])} < {LONG_WORDS}"
    return f"SELECT x0.doc_id, x0.k, {size} AS size, {' || chr(10) || '.join(f'{x}.body' for x in lines)} AS gram FROM solid x0{joins}{least}"


GRAMS = "grams AS (" + " UNION ALL ".join(_grams(size) for size in range(1, RUN + 1)) + ")"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i, regexp_replace(line, '^[ \\t\\x0B\\f\\r]+|[ \\t\\x0B\\f\\r]+$', '', 'g') AS body, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
solid AS (SELECT *, len(string_split_regex(body, '[ \\t\\x0B\\f\\r]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE body <> ''),
{GRAMS},
later AS (SELECT doc_id, k, size FROM (SELECT doc_id, k, size, row_number() OVER (PARTITION BY size, gram ORDER BY doc_id, k) AS n FROM grams) WHERE n > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM later l JOIN solid s ON s.doc_id = l.doc_id AND s.k BETWEEN l.k AND l.k + l.size - 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.i = l.i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  (SELECT count(*) FROM solid s WHERE s.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
