"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets a few ratios in whole thousandths. For each language and source a sketch of
each ratio counts texts by log-linear bucket (relative width 1/16): sketches are plain
counts, so they merge by addition and are the same in any order. A ratio's fence lies
``REACH`` times as far beyond its upper decile as that lies beyond the median, and below
likewise for two-sided ratios. Where most texts show nothing at all (no symbol, no
repeated line) both are 0; so a fence leaves room for ``ALLOWED`` occurrences in a text of
the group's median length, which has a sketch as well.

A group's sketch is merged with that of its language and that of all texts by fixed shares, ``OWN`` to
``LANG`` to ``ALL``, whatever the sizes: a small group leans on few texts of its own, but follows them when they all
change. Its decile counts only up to the fence of its language (or the group's own median, if that lies
beyond): in a group of which up to half is junk, junk doesn't lift the fence, as long as it is less than a tenth
of the language. Nor is a decile nearer to the group's median than the language's to its own, so that few alike texts
don't narrow their fences. Texts beyond a fence aren't kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, WORD, staged, with_text_columns

WORDS = re.compile(WORD)
#: Symbols, the window of repeats, the rule of the base.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: Reach of a fence in distances from median to decile; occurrences that are always allowed; shares of the group's sketch, its language's and that of all.
REACH, ALLOWED, OWN, LANG, ALL = 3, 2, 8, 4, 1
#: Ratios in thousandths: (name, what it counts, what it is counted in, least size of an occurrence, whether it has a fence below).
RATIOS = (
    ("symbol_pm", "n_symbols", "word_chars", 1, False),
    ("shout_pm", "n_upper", "n_words", 1, False),
    ("mark_pm", "n_marks", "n_words", 1, False),
    ("length_pm", "word_chars", "n_words", 0, True),
    ("line_pm", "n_dup_lines", "n_lines", 1, False),
    ("repeat_pm", "n_repeat_words", "n_words", 2 * WINDOW, False),
)
#: Lengths whose medians scale the occurrences allowed.
LENGTHS = ("n_words", "word_chars", "n_lines")
SKETCHED = (*[r[0] for r in RATIOS], *LENGTHS)
#: A bucket has the values that agree in place and in this many bits behind the first.
KEPT_BITS = 4


def repeat_words(words: list) -> int:
    """Words in windows of ``WINDOW`` words that are found twice or more, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    for step in (1, 2, 4):  # number the distinct windows of 2, 4 and 8 words
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids, count = np.unique(pairs, return_inverse=True, return_counts=True)
    twice = (count[ids] > 1).astype(np.int64)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[WINDOW:] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines, n_upper, n_marks for the ratios."""
    if not text:
        return (0,) * 8
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    upper = sum(map(str.isupper, words))
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        upper,
        text.count("!") + text.count("?"),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def _setup():
    def columns(texts: pa.Array) -> list[pa.Array]:
        rows = [measures(x.as_py()) for x in texts]
        return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(NAMES))]

    return columns


def measured(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    base = with_text_columns(df, text_col, keep, [T.StructField(n, T.LongType()) for n in NAMES], _setup)
    pm = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return base.withColumns({name: pm(of, by) for name, of, by, _, _ in RATIOS}).withColumn("base_failed", failed)


def bucketed(df: DataFrame) -> DataFrame:
    """(..., value) -> top: the highest value of its bucket."""
    shift = F.greatest(F.length(F.bin("value")) - (KEPT_BITS + 1), F.lit(0)).cast("int")
    return df.withColumn("shift", shift).withColumn("top", F.expr("shiftleft(shiftright(value, shift) + 1, shift) - 1"))


def blended(sketch: DataFrame) -> DataFrame:
    """(g_lang, g_source, ratio, top, n): each group's sketch merged with its language's and that of all, weighed in whole numbers.

    A row a group and bucket: some hundred buckets a ratio at most.
    """
    whole = lambda c: F.sum(c).cast("decimal(12,0)")
    lang = sketch.groupBy("lang", "ratio", "top").agg(whole("n").alias("n"))
    every = lang.groupBy("ratio", "top").agg(whole("n").alias("n"))
    # texts of the group, of its language, of all: each ratio has one value a text
    one = sketch.where(F.col("ratio") == RATIOS[0][0])
    n_lang = one.groupBy("lang").agg(whole("n").alias("n_lang"))
    sized = one.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(whole("n").alias("n_own"))
    sized = sized.join(n_lang, F.col("g_lang").eqNullSafe(F.col("lang"))).drop("lang").crossJoin(F.broadcast(one.agg(whole("n").alias("n_all"))))  # one row
    sized = staged(sized, "quality-groups")
    keys = sized.withColumn("r", F.explode(F.array(*map(F.lit, SKETCHED))))
    mass = lambda share, *by: (F.lit(share).cast("decimal(2,0)") * F.col("n") * F.col(by[0]) * F.col(by[1])).cast("decimal(38,0)").alias("n")
    own = sketch.withColumn("n", F.col("n").cast("decimal(12,0)")).join(sized, F.col("g_lang").eqNullSafe(F.col("lang")) & F.col("g_source").eqNullSafe(F.col("source")))
    own = own.select("g_lang", "g_source", "ratio", "top", mass(OWN, "n_lang", "n_all"))
    like = sized.join(lang, F.col("g_lang").eqNullSafe(F.col("lang"))).select("g_lang", "g_source", "ratio", "top", mass(LANG, "n_own", "n_all"))
    rest = keys.join(every, F.col("r") == F.col("ratio")).select("g_lang", "g_source", "ratio", "top", mass(ALL, "n_own", "n_lang"))
    return own.unionByName(like).unionByName(rest).groupBy("g_lang", "g_source", "ratio", "top").agg(F.sum("n").alias("n"))


def marks(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, <ratio>_<tenths>): the first and ninth decile and the median of each group's ratios."""
    whole = W.partitionBy(*keys, "ratio")
    ranked = counted.withColumn("upto", F.sum("n").over(whole.orderBy("top").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(whole))
    at = lambda name, tenths: F.min(F.when((F.col("ratio") == name) & (F.col("upto") * 10 >= F.col("all") * tenths), F.col("top"))).alias(f"{name}_{tenths}")
    return ranked.groupBy(*keys).agg(*[at(name, tenths) for name in SKETCHED for tenths in (1, 5, 9)])


def beyond(name: str, by: str, least: int, high, low) -> tuple:
    """The fences of a ratio whose deciles count as ``high`` and ``low``."""
    free = F.floor(F.lit(1000 * ALLOWED * least) / F.greatest(F.col(f"{by}_5"), F.lit(1))).cast("long")
    half = F.col(f"{name}_5")
    return high + REACH * (high - half) + free, low - REACH * (half - low)


def fences(sketch: DataFrame) -> DataFrame:
    """(g_lang, g_source, <ratio>_high, <ratio>_low): the fences of each group of the sketch (lang, source, ratio, top, n)."""
    lang = marks(sketch.groupBy("lang", "ratio", "top").agg(F.sum("n").alias("n")), ["lang"])
    ends = {name: beyond(name, by, least, F.col(f"{name}_9"), F.col(f"{name}_1")) for name, _, by, least, _ in RATIOS}
    spread = lambda name: (F.col(f"{name}_9") - F.col(f"{name}_5"), F.col(f"{name}_5") - F.col(f"{name}_1"))
    lang = lang.select("lang", *[c.alias(f"lang_{name}_{what}") for name, both in ends.items() for what, c in zip(("high", "low", "up", "down"), (*both, *spread(name)), strict=True)])
    own = marks(blended(sketch), ["g_lang", "g_source"]).join(lang, F.col("g_lang").eqNullSafe(F.col("lang")))
    sides = []
    for name, _, by, least, two_sided in RATIOS:
        half = F.col(f"{name}_5")
        up = F.greatest(F.least(f"{name}_9", F.greatest(half, F.col(f"lang_{name}_high"))), half + F.col(f"lang_{name}_up"))
        down = F.least(F.greatest(f"{name}_1", F.least(half, F.col(f"lang_{name}_low"))), half - F.col(f"lang_{name}_down"))
        high, low = beyond(name, by, least, up, down)
        sides += [high.alias(f"{name}_high"), *([low.alias(f"{name}_low")] if two_sided else [])]
    return own.select("g_lang", "g_source", *sides)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, top, n) of texts that pass the base."""
    stack = ", ".join(f"'{name}', {name}" for name in SKETCHED)
    values = bucketed(rows.where("not base_failed").select("lang", "source", F.expr(f"stack({len(SKETCHED)}, {stack}) as (ratio, value)")))
    return values.groupBy("lang", "source", "ratio", "top").agg(F.count("*").alias("n"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed: names of ratios outside), one row a row.

    Null and empty texts have zeros and fail the base. Null languages and sources are
    groups of their own. Texts that fail the base take no part in the sketches. Repeated
    rows count as often as they come and get equal verdicts. An empty table gives an empty result.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = staged(measured(keyed, ["id", "lang", "source"], "text"), "quality")
    fence = staged(fences(staged(sketches(rows), "quality-sketch")), "quality-fences")
    judged = rows.join(fence, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    out = [F.when((F.col(r) > F.col(f"{r}_high")) | (F.col(r) < F.col(f"{r}_low") if two_sided else F.lit(False)), F.lit(r)) for r, _, _, _, two_sided in RATIOS]
    judged = judged.withColumn("failed", F.array_compact(F.array(*out)))
    return judged.select(F.col("id").alias(id_col), *NAMES[:5], "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def _pm(a: str, b: str) -> str:
    return f"1000 * {a} // greatest({b}, 1)"


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM words WHERE len(w) >= {WINDOW}),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS n FROM starts),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, source, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(list_filter(w.w, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
  FROM words w LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeats USING (doc_id)),
rated AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    {", ".join(f"{_pm(of, by)} AS {r}" for r, of, by, _, _ in RATIOS)}
  FROM base),
long AS (
  UNPIVOT (SELECT doc_id, lang, source, base_failed, {", ".join(f"CAST({r} AS BIGINT) AS {r}" for r in SKETCHED)} FROM rated)
  ON {", ".join(SKETCHED)} INTO NAME ratio VALUE value),
placed AS (
  SELECT lang, source, ratio, ((value >> shift) + 1 << shift) - 1 AS top
  FROM (SELECT *, greatest(length(bin(value)) - {KEPT_BITS + 1}, 0) AS shift FROM long WHERE NOT base_failed)),
tops AS (
  SELECT lang, source, ratio, top, CAST(count(*) AS HUGEINT) AS n FROM placed GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, (SELECT CAST(count(*) AS HUGEINT) FROM rated r WHERE NOT r.base_failed AND r.lang IS NOT DISTINCT FROM g.lang) AS n_lang,
    (SELECT CAST(count(*) AS HUGEINT) FROM rated r WHERE NOT r.base_failed AND r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source) AS n_own,
    (SELECT CAST(count(*) AS HUGEINT) FROM rated r WHERE NOT r.base_failed) AS n_all
  FROM (SELECT DISTINCT lang, source FROM tops) g),
weighed AS (
  SELECT g.lang, g.source, false AS whole, t.ratio, t.top,
    CASE WHEN t.lang IS NOT DISTINCT FROM g.lang AND t.source IS NOT DISTINCT FROM g.source THEN {OWN} * t.n * n_lang * n_all ELSE 0 END
    + CASE WHEN t.lang IS NOT DISTINCT FROM g.lang THEN {LANG} * t.n * n_own * n_all ELSE 0 END + {ALL} * t.n * n_own * n_lang AS n
  FROM groups g, tops t
  UNION ALL SELECT lang, NULL, true, ratio, top, n FROM tops),
merged AS (
  SELECT lang, source, whole, ratio, top, CAST(sum(n) AS HUGEINT) AS n FROM weighed GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, whole, ratio ORDER BY top) AS upto, sum(n) OVER (PARTITION BY lang, source, whole, ratio) AS total FROM merged),
marks AS (
  SELECT lang, source, whole, ratio, min(top) FILTER (WHERE upto * 10 >= total) AS q10, min(top) FILTER (WHERE upto * 10 >= total * 5) AS q50,
    min(top) FILTER (WHERE upto * 10 >= total * 9) AS q90
  FROM ranked GROUP BY lang, source, whole, ratio),
scaled AS (
  SELECT m.*, CASE m.ratio {" ".join(f"WHEN '{r}' THEN {1000 * ALLOWED * least}" for r, _, _, least, _ in RATIOS)} END // greatest(l.q50, 1) AS free
  FROM marks m JOIN marks l ON l.lang IS NOT DISTINCT FROM m.lang AND l.source IS NOT DISTINCT FROM m.source AND l.whole = m.whole
    AND l.ratio = CASE m.ratio {" ".join(f"WHEN '{r}' THEN '{by}'" for r, _, by, _, _ in RATIOS)} END),
bounded AS (
  SELECT s.*, greatest(least(s.q90, greatest(s.q50, l.q90 + {REACH} * (l.q90 - l.q50) + l.free)), s.q50 + l.q90 - l.q50) AS up,
    least(greatest(s.q10, least(s.q50, l.q10 - {REACH} * (l.q50 - l.q10))), s.q50 - (l.q50 - l.q10)) AS down
  FROM scaled s JOIN scaled l ON l.whole AND l.lang IS NOT DISTINCT FROM s.lang AND l.ratio = s.ratio WHERE NOT s.whole),
fences AS (
  SELECT lang, source, ratio, up + {REACH} * (up - q50) + free AS high,
    CASE WHEN ratio IN ({", ".join(f"'{r}'" for r, _, _, _, two in RATIOS if two)}) THEN down - {REACH} * (q50 - down) END AS low
  FROM bounded),
verdicts AS (
  SELECT l.doc_id, coalesce(bool_or(l.value > f.high OR coalesce(l.value < f.low, false)), false) AS outside
  FROM long l LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM l.lang AND f.source IS NOT DISTINCT FROM l.source AND f.ratio = l.ratio
  GROUP BY l.doc_id)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT outside AS kept
FROM rated r JOIN verdicts v ON v.doc_id = r.doc_id
"""
