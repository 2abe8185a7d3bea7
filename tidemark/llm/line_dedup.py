"""Line dedup: lines spread over many sites, found by HyperLogLog sketches and settled by exact counts, are kept once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side


@dataclass(frozen=True)
class SpreadRules:
    """A line of at least ``min_chars`` characters seen on ``min_sites`` distinct sites or more is boilerplate.

    Sketches have ``2**lg_k`` registers; a line whose estimate is within ``margin`` relative errors of ``min_sites`` is counted exactly.
    """

    min_sites: int = 5
    min_chars: int = 16
    lg_k: int = 10
    margin: float = 4.0

    @property
    def error(self) -> float:
        return 1.04 / 2 ** (self.lg_k / 2)


def line_key(line):
    """Two hashes of a line with outer blanks trimmed, not tabs or CR: lines are equal when both agree."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(17), line).alias("g"))


def _lines(df: DataFrame, rules: SpreadRules) -> DataFrame:
    """``(row, own, site, h, g)``: each row's distinct long lines, once."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x))
    keys = F.array_distinct(F.transform(F.filter(trimmed, lambda x: F.length(x) >= rules.min_chars), line_key))
    return df.select("row", "own", "site", F.explode(keys).alias("k")).select("row", "own", "site", "k.h", "k.g")


def _source(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Rows ``(row, own, text, site)``; a row without an id is known by the hash of its text, ``own``, so that such rows do not meet in one place."""
    own = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))
    return df.select(F.col(id_col).alias("row"), own.alias("own"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))


def line_spread(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", rules: SpreadRules = SpreadRules()) -> DataFrame:
    """Boilerplate lines: ``(h, g, sites, exact, keeper)``, ``keeper`` the smallest id of a row that holds the line.

    One aggregation makes a sketch of sites for each line, merged map-side so that a line of any frequency costs a task one sketch.
    Lines near the threshold (``SpreadRules.margin``) are then counted exactly from distinct (line, site) pairs.
    A null site counts as no site; a null text has no lines; a null id is never a keeper where another row has the line.
    """
    source = _source(df, id_col, text_col, site_col)
    lines = _lines(source, rules)
    sketches = materialize(
        lines.groupBy("h", "g")
        .agg(F.hll_sketch_agg("site", rules.lg_k).alias("sketch"), F.min("row").alias("keeper"))
        .select("h", "g", "keeper", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= int(rules.min_sites * (1 - rules.margin * rules.error))),
        "line-spread",
    )
    near = sketches.where(F.col("estimate") <= rules.min_sites * (1 + rules.margin * rules.error) + 1)
    exact = (
        lines.join(small_side(near.select("h", "g")), ["h", "g"], "left_semi")
        .where("site is not null")
        .groupBy("h", "g")
        .agg(F.count_distinct("site").alias("exact"))
    )
    settled = sketches.join(exact, ["h", "g"], "left")
    sites = F.coalesce("exact", "estimate")
    return settled.where(sites >= rules.min_sites).select("h", "g", sites.alias("sites"), F.col("exact").isNotNull().alias("exact"), "keeper")


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", rules: SpreadRules = SpreadRules()) -> DataFrame:
    """``df`` with boilerplate lines cut from its texts, and ``n_lines``, ``n_removed`` (long).

    A boilerplate line stays at its first place in the row of the smallest id that holds it (in each of them, where the id
    repeats; nowhere, if all ids are null) and goes everywhere else, so no line is lost from the corpus. Other lines stay,
    repeated or not, in order. Every row of ``df`` comes back, with all its columns: null text stays null with no lines, empty
    text has one empty line. Should ``df`` have columns named ``n_lines`` or ``n_removed``, they are replaced.
    """
    spread = materialize(line_spread(df, id_col=id_col, text_col=text_col, site_col=site_col, rules=rules), "line-boilerplate")
    source = _source(df, id_col, text_col, site_col)
    hits = _lines(source, rules).join(small_side(spread.select("h", "g", "keeper")), ["h", "g"])
    hits = hits.groupBy(F.col("row").alias("hit_row"), F.col("own").alias("hit_own")).agg(
        F.collect_set(F.struct("h", "g")).alias("hit_keys"), F.collect_set(F.when(F.col("row") == F.col("keeper"), F.struct("h", "g"))).alias("kept_keys")
    )
    drop = [c for c in ("n_lines", "n_removed") if c in df.columns]
    names = [c for c in df.columns if c not in drop]
    base = df.select(F.struct(*names).alias("whole"))  # so no name of theirs meets one of ours
    own = F.when(base["whole"][id_col].isNull(), F.xxhash64(base["whole"][text_col]))
    both = base.join(hits, base["whole"][id_col].eqNullSafe(hits["hit_row"]) & own.eqNullSafe(hits["hit_own"]), "left")
    text = F.col("whole")[text_col]
    parts = F.split(text, "\n", -1)
    keys = F.transform(parts, lambda x: F.when(F.length(F.btrim(x)) >= rules.min_chars, line_key(F.btrim(x))))
    stays = lambda x, i: (
        F.coalesce(~F.array_contains("hit_keys", F.get("line_keys", i)), F.lit(True))
        | F.coalesce(F.array_contains("kept_keys", F.get("line_keys", i)) & (F.array_position("line_keys", F.get("line_keys", i)) == i + 1), F.lit(False))
    )
    hit = F.col("hit_keys").isNotNull() & text.isNotNull()
    both = both.withColumn("line_keys", F.when(hit, keys)).withColumn("kept_lines", F.when(hit, F.filter(parts, stays)))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return both.select(
        *(F.when(hit, F.array_join("kept_lines", "\n")).otherwise(text).alias(c) if c == text_col else F.col("whole")[c].alias(c) for c in names),
        n.alias("n_lines"),
        F.when(hit, n - F.size("kept_lines")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )


def lines_report(df: DataFrame, rules: SpreadRules = SpreadRules()) -> DataFrame:
    """What line dedup leaves of each of ``documents``: line counts, and the MD5 of the text left (of the empty text for null)."""
    out = dedup_lines(df.select("doc_id", "text", "source"), rules=rules)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


#: For DuckDB, with ``rules`` of the defaults.
LINES_SQL = """
WITH lines AS (
  SELECT doc_id, source, pos, raw, trim(raw, ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)),
spread AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE length(line) >= {min_chars}
  GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
marked AS (
  SELECT l.*, s.keeper, min(pos) OVER (PARTITION BY l.doc_id, l.line) AS first_pos
  FROM lines l LEFT JOIN spread s ON l.line = s.line),
kept AS (
  SELECT *, keeper IS NOT NULL AND NOT (doc_id = keeper AND pos = first_pos) AS gone FROM marked)
SELECT d.doc_id,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
""".format(min_chars=SpreadRules().min_chars, min_sites=SpreadRules().min_sites)
