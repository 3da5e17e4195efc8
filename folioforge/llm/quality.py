"""Operator 1, quality rules with adaptive thresholds (native: SQL functions only).

Every document gets base counts and five ratios. Mergeable KLL quantile sketches
of the ratios and of the documents' lengths are built per language and source,
and merged per language and over all. A group's quantiles are drawn to those of
its language, and these to those of all documents, as if `pull` documents of the
wider group belonged to it, so a small group leans on the wider one and a large
one on its own documents. A ratio's fence is the group's median plus a multiple of
its spread: twice the distance from the median down to the tenth, which junk on
the upper side does not move, or, where most documents have a ratio of 0, what a
few occurrences make in a document of the group's median length. Documents are
then joined to their group's fences and filtered.

Defined cases: a null or empty text has zero counts and fails the base rule;
null languages and sources are groups of their own; repeated rows and ids are
judged each on its own; a value on a fence is inside; an empty table gives an
empty result; input columns of any name are kept as they are, since internal
columns live in structs. Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Ratio -> (multiple of the spread, occurrences that a median document may have by chance, what they are counted among, also a lower fence).
RULES = {
    "symbol_ratio": (6.0, 9.0, "n_words", False),
    "dup_line_ratio": (6.0, 1.0, "n_lines", False),
    "repeat_ratio": (6.0, 24.0, "n_words", False),
    "upper_ratio": (12.0, 3.0, "n_words", False),
    "mean_word": (8.0, 60.0, "n_words", True),
}
#: Sketched columns, and the size parameter of the sketches.
SKETCHED = (*RULES, "n_words", "n_lines")
SKETCH_K = 400
#: Weight of the wider group, in documents.
PULL = 200
MIN_WORDS = 50

_SPACE = r"[\\x20\\x09-\\x0D]+"
_LETTER = r"[^\\x20\\x09-\\x0D]"


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all input columns) and stats (counts and ratios of the text).

    Repeated windows: if all hashes of a text's 3-word windows differ there are
    none. Otherwise (hash, place) pairs are sorted, equal neighbours give the
    repeated places, and their union of three words each is summed up, so a long
    text costs n log n. Windows are compared by their 64-bit hash.
    """
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", text.alias("t"))
    b = a.select(
        "row",
        F.length("t").alias("chars"),
        F.expr(f"array_remove(split(t, '{_SPACE}'), '')").alias("w"),
        F.expr(f"filter(split(t, '\\n', -1), x -> x rlike '{_LETTER}')").alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
    )
    c = b.select(
        "row",
        "chars",
        "n_symbols",
        "n_upper",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr("if(size(w) < 4, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").cast("array<long>").alias("h"),
    )
    d = c.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), null, sort_array(transform(h, (x, i) -> struct(x as h, i as p))))"))
    twice = "filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h))"
    union = f"aggregate(array_sort(transform({twice}, x -> x.p)), struct(0 as e, 0 as n), (z, p) -> struct(p + 3 as e, z.n + p + 3 - greatest(p, z.e) as n), z -> z.n)"
    e = d.withColumn("n_repeat_words", F.expr(f"if(s is null, 0, {union})"))
    n, long = F.greatest("n_words", F.lit(1)), lambda x: F.col(x).cast("long").alias(x)
    return e.select(
        "row",
        F.struct(
            *[long(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            long("n_lines"),
            ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long"))).alias("base_failed"),
            (F.col("n_symbols") / n).alias("symbol_ratio"),
            (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
            (F.col("n_repeat_words") / n).alias("repeat_ratio"),
            (F.col("n_upper") / F.greatest("chars", F.lit(1))).alias("upper_ratio"),
            (F.col("word_chars") / n).alias("mean_word"),
        ).alias("stats"),
    )


def _quantiles(n, sketches: dict):
    """Number of documents, tenth and median of every sketched column as one struct."""
    at = lambda x, q: F.kll_sketch_get_quantile_double(sketches[x], F.lit(q))
    return F.struct(n.cast("double").alias("n"), *[c for x in SKETCHED for c in (at(x, 0.1).alias(f"low_{x}"), at(x, 0.5).alias(f"mid_{x}"))])


def _drawn(own: str, wide: str, pull: float):
    """Quantiles of a group drawn to those of a wider one."""
    names = [f"{k}_{x}" for x in SKETCHED for k in ("low", "mid")]
    share = F.col(f"{own}.n") / (F.col(f"{own}.n") + F.lit(pull))
    return F.struct(F.col(f"{own}.n").alias("n"), *[(share * F.col(f"{own}.{c}") + (1 - share) * F.col(f"{wide}.{c}")).alias(c) for c in names])


def _fences(q: str):
    """Upper and lower fences of all rules from a group's quantiles."""
    out = []
    for x, (times, chance, among, low) in RULES.items():
        mid = F.col(f"{q}.mid_{x}")
        spread = times * F.greatest(2 * (mid - F.col(f"{q}.low_{x}")), F.lit(chance) / F.greatest(F.col(f"{q}.mid_{among}"), F.lit(1.0)))
        out += [(mid + spread).alias(f"hi_{x}"), ((mid - spread) if low else F.lit(float("-inf"))).alias(f"lo_{x}")]
    return F.struct(*out)


def thresholds(judged: DataFrame, lang_col: str = "lang", source_col: str = "source", pull: float = PULL) -> DataFrame:
    """lang, source and the fences that hold there, from documents that pass the base rule."""
    passed = judged.where(~F.col("stats.base_failed")).select(F.col(f"row.`{lang_col}`").alias("lang"), F.col(f"row.`{source_col}`").alias("source"), "stats")
    sketch = lambda x: F.kll_sketch_agg_double(F.col(f"stats.{x}").cast("double"), F.lit(SKETCH_K)).alias(x)
    groups = save(passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *[sketch(x) for x in SKETCHED]), "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(x).alias(x) for x in SKETCHED]]
    quantiles = lambda df, tag: df.withColumn(tag, _quantiles(F.col("n"), {x: F.col(x) for x in SKETCHED})).drop("n", *SKETCHED)
    whole = quantiles(groups.agg(*merged).where("n > 0"), "top").first()  # one row at most
    own = quantiles(groups, "own")
    if whole is None:
        return own.select("lang", "source", _fences("own").alias("f"))
    top = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in whole.top.asDict().items()])
    by_lang = quantiles(groups.groupBy("lang").agg(*merged), "wide").withColumn("top", top).select(F.col("lang").alias("of"), _drawn("wide", "top", pull).alias("wide"))
    drawn = save(own.join(by_lang, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "source", _drawn("own", "wide", pull).alias("q")), "quality-quantiles")
    return drawn.select("lang", "source", _fences("q").alias("f"))


def _kept(judged: DataFrame, fences: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    inside = None
    for x in RULES:
        test = (F.col(f"stats.{x}") <= F.col(f"f.hi_{x}")) & (F.col(f"stats.{x}") >= F.col(f"f.lo_{x}"))
        inside = test if inside is None else inside & test
    same = F.col(f"row.`{lang_col}`").eqNullSafe(F.col("lang")) & F.col(f"row.`{source_col}`").eqNullSafe(F.col("source"))
    return judged.join(fences, same, "left").select("row", "stats", F.coalesce(~F.col("stats.base_failed") & inside, F.lit(False)).alias("kept"))


def _saved_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all columns but the text) and stats, stored: the sketches read a few of its columns."""
    row = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text_col])
    return save(with_stats(docs, text_col).select(row.alias("row"), "stats"), "quality-stats")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pull: float = PULL) -> DataFrame:
    """row (all columns but the text), stats and kept of every document."""
    judged = _saved_stats(docs, text_col)
    return _kept(judged, thresholds(judged, lang_col, source_col, pull), lang_col, source_col)


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pull: float = PULL) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Counts are computed twice, for the sketches and for the filter, instead of writing whole texts between.
    """
    fences = thresholds(_saved_stats(docs.select(*dict.fromkeys((f"`{lang_col}`", f"`{source_col}`", f"`{text_col}`"))), text_col), lang_col, source_col, pull)
    return _kept(with_stats(docs, text_col), fences, lang_col, source_col).where("kept").select("row.*")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: id, base counts, base_failed, kept."""
    wanted = docs.select(*[c for c in dict.fromkeys((id_col, text_col, kw.get("lang_col", "lang"), kw.get("source_col", "source")))])
    out = judge(wanted, text_col=text_col, **kw)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), *[F.col(f"stats.{c}").alias(c) for c in counts], "kept")


ORACLE_BASE = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
words as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
grams as (select doc_id, unnest(range(1, len(w) - 1)) as p, w from words where len(w) > 2),
r as (select doc_id, p, count(*) over (partition by doc_id, w[p], w[p+1], w[p+2]) as n from grams),
c as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, p + unnest([0, 1, 2]) as q from r where n > 1) group by doc_id),
s as (select words.doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, length(t) as chars, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) as n_upper
  from words left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols / greatest(n_words, 1) as symbol_ratio,
  n_dup_lines / greatest(n_lines, 1) as dup_line_ratio, n_repeat_words / greatest(n_words, 1) as repeat_ratio, n_upper / greatest(chars, 1) as upper_ratio,
  word_chars / greatest(n_words, 1) as mean_word from s)
"""


def oracle(pull: float = PULL) -> str:
    """DuckDB SQL with exact quantiles in the place of sketches."""
    names = [f"{k}_{x}" for x in SKETCHED for k in ("low", "mid")]
    quantiles = ", ".join(f"quantile_disc({x}, 0.1)::double as low_{x}, quantile_disc({x}, 0.5)::double as mid_{x}" for x in SKETCHED)
    draw = lambda a, b: ", ".join(f"{a}.n / ({a}.n + {pull}) * {a}.{c} + (1 - {a}.n / ({a}.n + {pull})) * {b}.{c} as {c}" for c in names)
    levels = f"""g as (select lang, source, count(*)::double as n, {quantiles} from b where not base_failed group by lang, source),
l as (select lang, count(*)::double as n, {quantiles} from b where not base_failed group by lang),
a as (select count(*)::double as n, {quantiles} from b where not base_failed),
w as (select l.lang, {draw("l", "a")} from l, a),
q as (select g.lang, g.source, {draw("g", "w")} from g join w on g.lang is not distinct from w.lang)"""
    tests = []
    for x, (times, chance, among, low) in RULES.items():
        spread = f"{times} * greatest(2 * (mid_{x} - low_{x}), {chance} / greatest(mid_{among}, 1))"
        tests.append(f"b.{x} <= mid_{x} + {spread}" + (f" and b.{x} >= mid_{x} - {spread}" if low else ""))
    return f"""{ORACLE_BASE}, {levels}
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, coalesce(not base_failed and {' and '.join(tests)}, false) as kept
from b left join q on b.lang is not distinct from q.lang and b.source is not distinct from q.source"""
