"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A text's lines with a word are hashed as grams of ``run`` neighbouring lines. Of each ``window`` of
lines the gram of least hash (of equal ones the last) is selected as a fingerprint, and so is every
line of ``long`` characters or more, a passage by itself. Fingerprints alone are joined over the corpus: a
common run of ``max(run, window)`` lines has one in common. Only the texts that share one are looked at further.

From its fingerprint a match is extended both ways over the grams that stand earlier, in a text
that shares fingerprints too: so each ``run`` neighbouring lines of what goes have stood together before, and lines
that only happen to stand side by side stay. First places are by id and position; a second hash is compared.

Matches are rows (a gram, its text and place), and runs are islands of neighbouring
places in a text, so the work grows with the lines and not with pairs of them, however
often a text repeats a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, staged

#: Least lines of a run, lines of a window, characters of a line that is a passage by itself.
RUN, WINDOW, LONG = 2, 3, 60


def cut_lines(df: DataFrame, id_col: str, text_col: str, run: int, long: int) -> DataFrame:
    """(id, key, at, hash, check, passages): by text, the places of its lines with a word, hashes of its grams, and its long lines (pos, hash, check)."""
    cut = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.split(F.col(text_col), "\n").alias("lines"))
    cut = cut.withColumn("at", F.expr(r"filter(sequence(0, size(lines) - 1), i -> lines[i] rlike '[^\\x20\\x09-\\x0D]')"))
    cut = cut.withColumn("own", F.transform("at", lambda i: F.element_at("lines", i + 1)))
    starts = F.expr(f"if(size(own) < {run}, array(), sequence(1, size(own) - {run - 1}))")
    gram = lambda i: F.array_join(F.slice("own", i, F.lit(run)), "\n")
    h60 = lambda text: F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    passage = lambda x, i: F.when(F.length(x) >= long, F.struct(i.alias("pos"), h60(x).alias("hash"), F.hash(x).alias("check")))
    passages = F.array_compact(F.transform("own", passage)) if run > 1 else F.expr("array()").cast("array<struct<pos:int,hash:bigint,check:int>>")
    return cut.select("id", "key", "at", F.transform(starts, lambda i: h60(gram(i))).alias("hash"), F.transform(starts, lambda i: F.hash(gram(i))).alias("check"), passages.alias("passages"))


def selected(window: int):
    """Whether the gram at place ``i`` of ``hash`` is the least of a window that holds it, the last among equal ones.

    It is so if, going ``l`` lines back and ``r`` lines on, none before is less and none behind is less or equal,
    with the window's grams in reach; a shorter text is one window.
    """
    spans = []
    for back in range(window):
        ahead = window - 1 - back
        low = f"greatest(i - {back}, 0)"
        high = f"least(i + {ahead}, size(hash) - 1)"
        # windows lie within the text; one that is cut off counts only where the text is shorter
        whole = f"((i >= {back} and i + {ahead} < size(hash)) or size(hash) < {window})"
        before = f"coalesce(array_min(slice(hash, {low} + 1, i - {low})) >= hash[i], true)"
        behind = f"coalesce(array_min(slice(hash, i + 2, {high} - i)) > hash[i], true)"
        spans.append(f"({whole} and {before} and {behind})")
    return " or ".join(spans)


def firsts(each: DataFrame) -> DataFrame:
    """(hash, first): where each gram that comes more than once stands first."""
    return each.groupBy("hash").agg(F.min(F.struct("place", "check")).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(id, key, n_lines, gone array<int>: places of lines that go), one row for each distinct id and text."""
    rows = df.where(F.col(text_col).isNotNull())
    of = cut_lines(rows, id_col, text_col, run, long).groupBy("id", "key").agg(*[F.first(c).alias(c) for c in ("at", "hash", "check", "passages")])
    of = staged(of, "lines")
    text = F.struct(F.col("id").isNull().alias("n"), "id", "key")
    grams = f"if(size(hash) = 0, array(), transform(sequence(0, size(hash) - 1), i -> named_struct('pos', i, 'hash', hash[i], 'check', check[i], 'wide', {run}, 'mark', {selected(max(1, window - run + 1))})))"
    singles = "transform(passages, p -> named_struct('pos', p.pos, 'hash', p.hash, 'check', p.check, 'wide', 0, 'mark', true))"
    every = of.select(text.alias("text"), "hash", "check", "passages")
    with_grams = lambda of: of.select("text", F.expr(f"concat({grams}, {singles})").alias("grams"))
    as_rows = lambda of, what: of.select("text", F.explode(what).alias("g")).select("g.hash", F.struct("text", "g.pos").alias("place"), "g.check", "g.wide", "g.mark")

    marked = as_rows(with_grams(every), F.filter("grams", lambda g: g["mark"]))
    shared = staged(firsts(marked).select("hash"), "lines-shared")
    touched = staged(marked.join(shared.hint("merge"), "hash", "left_semi").select("place.text").distinct(), "lines-touched")
    near = staged(every.join(touched.hint("merge"), "text", "left_semi"), "lines-near")  # shuffled once, as hashes alone
    each = as_rows(with_grams(near), F.col("grams"))
    first = staged(firsts(each), "lines-first")  # written, so that the rows of a very common gram can be split
    later = each.join(first.hint("merge"), "hash").where((F.col("place") != F.col("first.place")) & (F.col("check") == F.col("first.check")))
    later = later.select("place.text", "place.pos", "wide", "mark")
    # neighbours that stand before form an island: their place less their rank is one number
    along = W.partitionBy("text", "wide").orderBy("pos")
    islands = later.withColumn("island", F.when(F.col("wide") == 0, F.col("pos")).otherwise(F.col("pos") - F.row_number().over(along)))
    islands = islands.withColumn("any_mark", F.max("mark").over(W.partitionBy("text", "wide", "island")))
    lines = F.explode(F.sequence("pos", F.col("pos") + F.greatest(F.col("wide") - 1, F.lit(0)))).alias("line")
    gone = islands.where("any_mark").select("text", lines).groupBy("text").agg(F.collect_set("line").alias("line"))
    out = of.join(gone, text == F.col("text"), "left")
    return out.select("id", "key", F.size("at").alias("n_lines"), F.expr("coalesce(transform(line, i -> at[i]), array())").alias("gone"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """The rows of ``df`` with the text less its repeated lines, and __n_lines, __n_removed (long).

    Lines are equal only to the byte. Lines without a word are never counted or removed, nor
    do they part a run. A run of ``max(run, window)`` lines or more that stands before, in an earlier text or earlier in
    its own, goes, with the neighbours whose ``run`` lines stood together before as well; so does a line of ``long``
    characters that stands before. Other lines stay, also if each of them stands before elsewhere (with a run and window
    of 1, every line that stands before goes). Null texts stay null with 0 lines. Rows equal in id and text are one
    text and get one result; null ids come after all others. Columns of ``df`` may have any names but those two. An
    empty table gives an empty result.
    """
    found = repeated_lines(df, id_col, text_col, run, window, long)
    rows = df.toDF(*[f"d_{c}" for c in df.columns]).withColumn("own", F.xxhash64(col(f"d_{text_col}")))  # no name clashes with ours
    joined = rows.join(found, col(f"d_{id_col}").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")), "left")
    # texts are shuffled once, whole; the lines of one are cut here, and named once by the outer function
    lines = F.array(F.split(col(f"d_{text_col}"), "\n"))
    left = lambda cut: F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone"))
    kept = F.transform(lines, lambda cut: F.array_join(F.transform(left(cut), lambda i: F.element_at(cut, i + 1)), "\n"))[0]
    return joined.select(
        *[(F.when(F.size("gone") > 0, kept).otherwise(col(f"d_{c}")) if c == text_col else col(f"d_{c}")).alias(c) for c in df.columns],
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("__n_lines"),
        F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("__n_removed"),
    )


ORACLE = rf"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, place, line, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i
  FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
grams AS (
  SELECT doc_id, i, 1 AS wide, '0x' || substr(md5(line || chr(10) || next), 1, 15) AS hash
  FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM lines) WHERE next IS NOT NULL
  UNION ALL SELECT doc_id, i, 0, '0x' || substr(md5(line), 1, 15) FROM lines WHERE length(line) >= {LONG}),
marked AS (
  SELECT doc_id, i, wide, CAST(hash AS BIGINT) AS hash,
    wide = 0 OR count(*) OVER d = 1 OR coalesce(hash <= lag(hash) OVER o, false) OR coalesce(hash < lead(hash) OVER o, false) AS mark
  FROM grams WINDOW d AS (PARTITION BY doc_id, wide), o AS (PARTITION BY doc_id, wide ORDER BY i)),
touched AS (
  SELECT DISTINCT doc_id FROM marked WHERE mark AND hash IN (SELECT hash FROM marked WHERE mark GROUP BY hash HAVING count(*) > 1)),
near AS (
  SELECT * FROM marked WHERE doc_id IN (SELECT doc_id FROM touched)),
first AS (
  SELECT hash, min((doc_id, i)) AS f FROM near GROUP BY hash),
later AS (
  SELECT m.*, CASE WHEN wide = 0 THEN i ELSE i - row_number() OVER (PARTITION BY doc_id, wide ORDER BY i) END AS island FROM near m JOIN first f ON f.hash = m.hash WHERE (m.doc_id, m.i) <> f.f),
runs AS (
  SELECT doc_id, wide, island FROM later GROUP BY doc_id, wide, island HAVING bool_or(mark)),
gone AS (
  SELECT DISTINCT l.doc_id, x.place FROM later l JOIN runs r ON r.doc_id = l.doc_id AND r.wide = l.wide AND r.island = l.island JOIN lines x ON x.doc_id = l.doc_id AND x.i BETWEEN l.i AND l.i + l.wide),
kept AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.place) FILTER (WHERE g.place IS NULL) AS text, count(g.place) AS n_removed
  FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.place = c.place GROUP BY c.doc_id)
SELECT d.doc_id,
       coalesce((SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id), 0) AS n_lines,
       coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
