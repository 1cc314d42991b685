"""Line dedup: overlapping three-line windows.

Every window of `lines` consecutive lines is hashed (two 64-bit hashes). So is a run of fewer lines where it says as much as a window: one of more
than `words` words, or the whole of a text that has no more lines. A window that occurs more than once in the whole
corpus keeps its first occurrence, by (id, text hash, position); each later one covers its lines, and the covered
lines of a document, merged over all its windows, are removed.

The texts themselves are shuffled once, to meet the covered positions; windows travel as hashes. A window's first occurrence
is a grouped minimum, with partial sums before the shuffle, and it is joined back to the occurrences, so a
window that a third of all documents hold does not gather in one task (the join back splits such a key by AQE's skew join).

Defined results: null and empty texts have no window and stay as they are. A window of
blank lines only (ASCII white space, so those of \\r\\n files too) is no window. Rows that agree in id and text count as one document, and each gets the same result;
rows with one id and different texts are different documents. Other columns stay, but for those named as a result. A null id is one id, before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 50
WORD = r"[^ \t\r\x0B\x0C]+"


def _windows(lines: int, words: int) -> Column:
    """struct(p, k, h1, h2) of each window, k lines from p, which counts from 0; of __ld_lines and __ld_counts, the words of each line."""
    n = F.size("__ld_lines")

    def runs(k: int) -> Column:
        said = lambda p: sum((F.get("__ld_counts", p + j) for j in range(1, k)), F.get("__ld_counts", p))
        ok = lambda p: (said(p) > words) | ((n == k) & (said(p) > 0)) if k < lines else said(p) > 0
        parts = lambda p: [F.get("__ld_lines", p + j) for j in range(k)]
        window = lambda p: F.struct(p.cast("int").alias("p"), F.lit(k).alias("k"), F.xxhash64(*parts(p)).alias("h1"), F.xxhash64(F.lit("second"), *parts(p)).alias("h2"))
        return F.when(n >= k, F.transform(F.filter(F.sequence(F.lit(0), n - k), ok), window))

    return F.flatten(F.array_compact(F.array(*map(runs, range(1, lines + 1)))))


def oracle_sql(lines: int = 3, words: int = WORDS) -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed and text; windows are compared as strings, not as hashes."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
with texts as (
  select doc_id, text, string_split(text, chr(10)) as l from (select distinct doc_id, text from documents where text is not null)
), split as (
  select doc_id, text, unnest(l) as line, generate_subscripts(l, 1) - 1 as p from texts
), runs as (
  select doc_id, text, p, k, len(l) as n, l[p + 1 : p + k] as w
  from (select doc_id, text, l, generate_subscripts(l, 1) - 1 as p from texts), (select unnest(range(1, {lines + 1})) as k) where p + k <= len(l)
), windows as (
  select doc_id, text, p, k, w from runs
  where trim(array_to_string(w, ' '), {blanks}) <> ''
    and (k = {lines} or (p = 0 and k = n) or len(regexp_extract_all(array_to_string(w, ' '), '{WORD}')) > {words})
), ranked as (
  select *, row_number() over (partition by w order by doc_id, text, p) as i from windows
), covered as (
  select distinct doc_id, text, p + unnest(range(k)) as p from ranked where i > 1
), joined as (
  select s.doc_id, s.text as was, count(*) as n_lines, count(c.p) as n_removed,
         coalesce(string_agg(case when c.p is null then s.line end, chr(10) order by s.p), '') as text
  from split s left join covered c on c.doc_id = s.doc_id and c.text = s.text and c.p = s.p
  group by s.doc_id, s.text
)
select d.doc_id, coalesce(j.n_lines, 0) as n_lines, coalesce(j.n_removed, 0) as n_removed, j.text
from documents d left join joined j on j.doc_id = d.doc_id and j.was = d.text
"""


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = 3, words: int = WORDS) -> DataFrame:
    """The input's columns with the text's later occurrences removed, and n_lines, n_removed (long)."""
    split = docs.select(
        F.col(id_col).alias("__ld_id"),
        F.xxhash64(F.col(text_col), F.length(text_col)).alias("__ld_t"),
        F.split(F.col(text_col), "\n", -1).alias("__ld_lines"),
    ).withColumn("__ld_counts", F.transform("__ld_lines", lambda x: F.regexp_count(x, F.lit(WORD))))
    windows = split.select("__ld_id", "__ld_t", F.explode(_windows(lines, words)).alias("w")).select("__ld_id", "__ld_t", "w.p", "w.k", "w.h1", "w.h2")
    place = F.struct("__ld_id", "__ld_t", "p")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = repeated.where(~F.col("first").eqNullSafe(F.col("last")))
    later = windows.join(repeated.select("h1", "h2", "first"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = (
        later.groupBy("__ld_id", "__ld_t", "p").agg(F.max("k").alias("k"))
        .groupBy("__ld_id", "__ld_t").agg(F.collect_list(F.struct("p", "k")).alias("__ld_starts"))
    )
    cut = F.array_distinct(F.flatten(F.transform("__ld_starts", lambda s: F.sequence(s["p"], s["p"] + s["k"] - 1))))
    covered = covered.select(F.col("__ld_id").alias("__ld_cid"), F.col("__ld_t").alias("__ld_ct"), F.sort_array(cut).alias("__ld_cut"))
    own = docs.withColumn("__ld_t", F.xxhash64(F.col(text_col), F.length(text_col)))
    met = own.join(covered, own[id_col].eqNullSafe(F.col("__ld_cid")) & (F.col("__ld_t") == F.col("__ld_ct")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__ld_cut"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")
    return met.select(
        *[F.when(F.col("__ld_cut").isNull(), F.col(text_col)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__ld_cut"), F.lit(0)).cast("long").alias("n_removed"),
    )
