"""Cross-site line deduplication by distinct-site spread, in DataFrame functions only.

A line that many sites show is boilerplate.  Every line is named by two hashes of its
normalised form, 128 bits together.  First, one aggregation counts each name's
occurrences and finds the first document that shows it: a line that occurs less often
than the spread asked for cannot reach it.  For the rest, HyperLogLog sketches of the
sites are built straight from the lines and merged by aggregation; an estimate well above
or below the threshold decides, one near it is replaced by an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions
from tessera.plans.storage import shared_table

#: A line shown by so many distinct sources or more is boilerplate.
MIN_SITES = 3
#: Lines of fewer words are left alone; 1: every line that is not blank is judged.
MIN_WORDS = 1
#: Around the threshold, the share within which a sketch's estimate is not trusted
#: (eight standard errors of 2^10 registers); at least one.
_LG_K, _BAND = 10, 0.26
#: Names that make up one part in so many of all repeated lines are hot: no more than
#: that many can be, so their list is small enough to broadcast, whatever the corpus.
HOT_NAMES = 1000
_NAME = ["name", "check"]


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _name(line: Column, min_words: int) -> Column:
    """(name, check), two hashes of the line in lower case, white space collapsed; null if
    it is too short.  The expression engine meets few lines with white space to collapse."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\x0b")
    plain = F.trim(F.lower(F.when(odd, F.regexp_replace(line, "[ \t\r\f\x0b]+", " ")).otherwise(line)))
    both = F.struct(F.xxhash64(plain).alias("name"), F.xxhash64(F.lit(1), plain).alias("check"))
    return F.when(F.substring_index(plain, " ", min_words - 1) != plain, both)


def repeated(lines: DataFrame, least: int) -> DataFrame:
    """(name, check, n, first_doc, hot) of the names that occur `least` times or more."""
    often = lines.groupBy(*_NAME).agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"))
    often = shared_table(often.where(F.col("n") >= least), "repeated")
    total = often.agg(F.sum("n")).first()[0] or 0
    return often.withColumn("hot", F.col("n") * HOT_NAMES >= F.lit(total))


def join_salted(lines: DataFrame, named: DataFrame, hot: DataFrame) -> DataFrame:
    """lines joined with named on name and check.  Rows of a hot name are dealt over all
    tasks by document, to as many copies of its row in named; other names have one."""
    salts = partitions(lines.sparkSession)
    marked = F.broadcast(hot.select(*_NAME, F.lit(True).alias("__hot")))
    left = lines.join(marked, _NAME, "left")
    left = left.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("doc"), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    right = named.join(marked, _NAME, "left")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = right.withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [*_NAME, "__salt"]).drop("__salt")


def boilerplate(lines: DataFrame, min_sites: int, often: DataFrame | None = None) -> DataFrame:
    """(name, check, first_doc) of the names in lines(name, check, doc, site) that min_sites
    distinct sites or more show; often: what `repeated` says of these lines, if known."""
    often = repeated(lines, min_sites) if often is None else often
    by = [*_NAME, "first_doc"]
    named, hot = often.select(*by), often.where("hot")
    spread = join_salted(lines, named, hot).groupBy(*by).agg(F.hll_sketch_agg("site", _LG_K).alias("sketch"))
    sized = spread.select(*by, F.hll_sketch_estimate("sketch").alias("sites"))
    band = max(1.0, _BAND * min_sites)
    near = sized.where(F.abs(F.col("sites") - min_sites) <= band).select(*by)
    exact = join_salted(lines, near, hot).groupBy(*by).agg(F.count_distinct("site").alias("sites"))
    sure = sized.where(F.col("sites") - min_sites > band).select(*by)
    return sure.union(exact.where(F.col("sites") >= min_sites).select(*by))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs without cross-site boilerplate lines; adds n_lines and n_removed.

    A line of min_words words or more that min_sites distinct `source` values show stays
    in the document with the smallest doc_id that has it, where it first stands, and goes
    everywhere else; so one copy of everything remains.  Other lines, blank ones
    included, stay as they are.  Null texts stay null with no lines.  A null source is no
    site; a null doc_id is larger than any.  Rows repeating a doc_id are treated alike.
    All rows and columns stay, in their order; a column that has one of the names in
    `counts` gives way to the count, so a caller with such columns names others.  An empty
    table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    every = F.transform(_lines("text"), lambda line: _name(line, min_words))
    named = docs.select(key.alias("doc"), F.col("source").cast("string").alias("site"), F.array_compact(every).alias("names"))
    lines = shared_table(named, "names").select("doc", "site", F.inline("names"))
    often = repeated(lines, min_sites)
    found = boilerplate(lines, min_sites, often)
    hits = join_salted(lines, found, often.where("hot")).select("doc", F.struct(*_NAME).alias("line"), (F.col("doc") == F.col("first_doc")).alias("own"))
    marks = hits.groupBy(F.col("doc").alias("of")).agg(
        F.collect_set(F.when(~F.col("own"), F.col("line"))).alias("gone"), F.collect_set(F.when(F.col("own"), F.col("line"))).alias("once")
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), F.col("text").alias("text"))
    joined = rows.join(marks, F.col("key") == F.col("of"), "left")
    keep = F.when(F.col("of").isNull(), _lines("text")).otherwise(
        F.transform(
            F.filter(
                F.arrays_zip(_lines("text").alias("line"), F.col("names").alias("name"), F.sequence(F.lit(1), F.size("names")).alias("at")),
                lambda x: F.coalesce(
                    ~F.array_contains("gone", x["name"])
                    & (~F.array_contains("once", x["name"]) | (F.array_position("names", x["name"]) == x["at"])),
                    F.lit(True),
                ),
            ),
            lambda x: x["line"],
        )
    )
    # The generator keeps later filters from being pushed below, which would judge lines twice.
    judged = joined.withColumn("names", F.when(F.col("of").isNotNull(), every)).withColumn("judged", keep)
    out = judged.withColumn("kept", F.explode(F.array("judged")))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines("text")))
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept"))
    text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    own = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in counts]
    return out.select(*own, total.cast("long").alias(counts[0]), (total - left).cast("long").alias(counts[1]))


def dedup_report_sql(min_sites: int = MIN_SITES, documents: str = "documents") -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed, text of dedup_lines."""
    return f"""
WITH lines AS (
  SELECT doc_id, source, u.line, u.pos,
         trim(lower(regexp_replace(u.line, '[ \\t\\r\\f\\x0b]+', ' ', 'g'))) AS plain
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM {documents} WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u
), long AS (
  SELECT *, plain <> '' AND length(plain) - length(replace(plain, ' ', '')) + 1 >= {MIN_WORDS} AS counts FROM lines
), found AS (
  SELECT plain, min(doc_id) AS first_doc FROM long WHERE counts GROUP BY plain HAVING count(DISTINCT source) >= {min_sites}
), judged AS (
  SELECT l.doc_id, l.line, l.pos,
         f.plain IS NULL OR (l.doc_id = f.first_doc AND row_number() OVER (PARTITION BY l.doc_id, l.plain ORDER BY l.pos) = 1) AS stays
  FROM long l LEFT JOIN found f ON l.counts AND l.plain = f.plain
)
SELECT d.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(j.kept, '') END AS text
FROM {documents} d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays) AS kept
  FROM judged GROUP BY doc_id
) j ON d.doc_id = j.doc_id
"""
