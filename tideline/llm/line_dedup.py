"""Operator 2, line dedup: winnowing over line hashes. DataFrame functions only.

Lines are a text's parts between line feeds, without white space at their ends; blank ones take no
part. Every window of `window` consecutive lines selects its least hash as a fingerprint, so two
texts that share a run of that many lines share a fingerprint; a line of `long_words` words or more is
a window by itself besides, so that a long passage is found between any neighbours. Positions of
fingerprints that occur once are done with. The others are joined: a window meets the place (id, line) where its
lines, told apart by 128 bits, first occurred, and matches at one distance are extended both ways
into runs. The later run is deleted. Each step is linear in the lines, whatever the size of a group: a window
meets its first occurrence, never all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, documents, materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", "")


def _bare_lines(text: Column) -> Column:
    return F.filter(F.transform(_lines(text), _bare), lambda x: x != "")


def _hashes(line: Column) -> tuple[Column, Column]:
    """Two hashes of a line, of different seeds."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def windows(docs: DataFrame, window: int, id_col: str, text_col: str, long_words: int = 50) -> DataFrame:
    """(doc_id, lines, at, span, match, check, print, new): each window of lines, how many it has, two hashes of its
    lines in order, the fingerprint it selects, and whether the window before selected another line. lines: hash
    of all lines, for rows of equal id. A text of fewer lines than a window is one window."""
    wide = lambda x: (F.length(x) >= 2 * long_words - 1) & (F.size(F.split(x, r"[ \t\x0B\f\r]+")) >= long_words)
    line = lambda x: F.struct(_hashes(x)[0].alias("h"), _hashes(x)[1].alias("g"), wide(x).alias("wide"))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(_bare_lines(F.col(text_col)), line).alias("x"))
    hashed = hashed.select("doc_id", F.col("x.h").alias("h"), F.col("x.g").alias("g"), F.col("x.wide").alias("wide"))
    hashed = hashed.where(F.size("h") > 0).withColumn("lines", F.xxhash64("h")).dropDuplicates(["doc_id", "lines"])
    part = lambda i, n=window, of="h": F.slice(of, i + 1, F.lit(n))
    least = lambda i: i + F.array_position(part(i), F.array_min(part(i))) - 1
    last = F.greatest(F.size("h") - F.lit(window), F.lit(0))

    def struct(i, span, new, mark):
        return F.struct(i.alias("at"), span.alias("span"), F.xxhash64(part(i)).alias("match"), F.xxhash64(part(i, of="g")).alias("check"), mark.alias("print"), new.alias("new"))

    new = lambda i: (i == 0) | (least(i) != least(i - F.when(i > 0, 1).otherwise(0)))
    # fingerprints of single lines are kept apart from those of windows that select the same line
    single = lambda i: F.bitwise_not(F.get("h", i))
    mark = (lambda i: F.array_min(part(i))) if window == 1 else (lambda i: F.when(F.size("h") == 1, single(i)).otherwise(F.array_min(part(i))))
    made = F.transform(F.sequence(F.lit(0), last), lambda i: struct(i, F.least(F.size("h"), F.lit(window)), new(i), mark(i)))
    if window > 1:
        alone = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("wide", i) & (F.size("h") > 1))
        one = lambda i: F.struct(i.alias("at"), F.lit(1).alias("span"), F.xxhash64(part(i, 1)).alias("match"), F.xxhash64(part(i, 1, "g")).alias("check"), single(i).alias("print"), F.lit(True).alias("new"))
        made = F.concat(made, F.transform(alone, one))
    return hashed.select("doc_id", "lines", F.explode(made).alias("x")).select("doc_id", "lines", "x.*")


def repeats(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int = 50) -> DataFrame:
    """(doc_id, lines, at, span, source_id, source_lines, source_at) of each window that occurred before, with where it first did."""
    every = materialize(windows(docs, window, id_col, text_col, long_words), "line-windows")
    prints = every.where("new").groupBy("print").agg(F.count("*").alias("n"))
    prints = materialize(prints.where("n > 1").select("print"), "line-prints")
    # the windows are sent once, and by merge joins at any size, so that disk grows as the lines do
    posted = every.join(prints.hint("merge"), "print", "left_semi").select("doc_id", "lines", "at", "span", "match", "check")
    posted = materialize(posted, "line-posted")
    discard(every, prints)
    first = posted.groupBy("match", "check").agg(F.min(F.struct("doc_id", "lines", "at")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").select("match", "check", "first"), "line-first")
    later = posted.join(first.hint("merge"), ["match", "check"]).where(F.struct("doc_id", "lines", "at") > F.col("first"))
    return later.select("doc_id", "lines", "at", "span", F.col("first.doc_id").alias("source_id"), F.col("first.lines").alias("source_lines"), F.col("first.at").alias("source_at"))


def _runs(docs: DataFrame, window: int, id_col: str, text_col: str, long_words: int) -> DataFrame:
    """Matches extended both ways: adjoining windows that match at one distance in one text are a run."""
    found = repeats(docs, window, id_col, text_col, long_words).withColumn("shift", F.col("source_at") - F.col("at"))
    place = ["doc_id", "lines", "source_id", "source_lines", "shift", "span"]  # at most the windows of one text
    found = found.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*place).orderBy("at")))
    return found.groupBy(*place, "run").agg(F.min("at").alias("first_line"), (F.max("at") + F.col("span") - 1).alias("last_line"))


def runs(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int = 50) -> DataFrame:
    """Maximal matched runs: doc_id, first_line, last_line (of lines that are not blank), source_id, source_line."""
    found = _runs(docs, window, id_col, text_col, long_words)
    return found.select("doc_id", "first_line", "last_line", "source_id", (F.col("first_line") + F.col("shift")).alias("source_line"))


def line_dedup(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int = 50) -> DataFrame:
    """Every row of docs with the columns doc_id, n_lines, n_removed and clean_text.

    Lines in a run of `window` or more lines that occurred before, in order of id and line, are
    deleted, and so are lines of `long_words` or more words that occurred before; the first occurrence stays, and
    so do blank lines. A shorter text is deleted whole if another text before it consists of the same
    lines. Texts of any length are taken whole, a row's memory being its own lines. Null text is empty; null ids come first;
    rows of equal id and lines count as one and keep or lose the same lines; other columns are
    ignored; an empty table gives an empty one.
    """
    marks = _runs(docs, window, id_col, text_col, long_words)
    drop = materialize(marks.groupBy("doc_id", "lines").agg(F.collect_list(F.struct("first_line", "last_line")).alias("drop")), "line-marks")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.transform(_bare_lines(F.col(text_col)), lambda x: _hashes(x)[0]).alias("h"))
    slim = slim.select("doc_id", "text", F.size("h").alias("n_lines"), F.xxhash64("h").alias("lines"))
    held = drop.agg(F.sum(F.size("drop") * 16 + 64)).first()[0] or 0
    drop = drop.select(F.col("doc_id").alias("_id"), F.col("lines").alias("_lines"), "drop")
    # by size: the marks go to the texts, or beyond the bound both are shuffled, the texts once
    joined = slim.join(F.broadcast(drop) if held <= BROADCAST_BYTES else drop, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lines") == F.col("_lines")), "left")
    raw = _lines(F.col("text"))
    # places of the lines that are not blank, then of those that marked windows hold
    places = F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: _bare(F.get(F.col("raw"), i)) != "")
    held = F.array_distinct(F.flatten(F.transform("drop", lambda r: F.sequence(r["first_line"], r["last_line"]))))
    marked = joined.withColumn("raw", F.when(F.col("drop").isNotNull(), raw))
    marked = marked.withColumn("places", F.when(F.col("drop").isNotNull(), places)).withColumn("gone", held)
    kept = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.transform("gone", lambda k: F.get(F.col("places"), k)))
    clean = F.array_join(F.transform(kept, lambda i: F.get(F.col("raw"), i)), "\n")
    return marked.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(clean).alias("clean_text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("clean_text", "utf-8")).alias("clean_md5"))


OP2_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM raw
), bare AS (
  SELECT doc_id, place, regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS bare FROM line
), n AS (
  SELECT doc_id, place, bare, row_number() OVER w AS idx, count(*) OVER (PARTITION BY doc_id) AS total, lead(bare) OVER w AS nxt
  FROM bare WHERE bare <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), win AS (
  SELECT doc_id, idx, span, row_number() OVER (PARTITION BY bare, nxt ORDER BY doc_id, idx) AS nth FROM (
    SELECT doc_id, idx, 2 AS span, bare, nxt FROM n WHERE nxt IS NOT NULL UNION ALL
    SELECT doc_id, idx, 1, bare, NULL FROM n WHERE total = 1 OR len(regexp_split_to_array(bare, '[ \t\x0B\f\r]+')) >= 50)
), gone AS (
  SELECT DISTINCT n.doc_id, n.place FROM n JOIN win ON win.doc_id = n.doc_id AND win.nth > 1 AND n.idx >= win.idx AND n.idx < win.idx + win.span
), kept AS (
  SELECT line.doc_id, string_agg(line.line, chr(10) ORDER BY line.place) AS clean
  FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.place = line.place WHERE gone.place IS NULL GROUP BY line.doc_id
)
SELECT raw.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, md5(coalesce(kept.clean, '')) AS clean_md5
FROM raw LEFT JOIN (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id) c ON c.doc_id = raw.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = raw.doc_id
LEFT JOIN kept ON kept.doc_id = raw.doc_id
"""
