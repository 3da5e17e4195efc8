"""Mixing of sources to target amounts along time-varying weight schedules.

A schedule is a piecewise linear weight over the time of training, from 0 to 1.
Its integral is the source's weight; the integral up to a time, inverted, gives
the time at which a word of the source's stream is wanted. Documents take the
position of their first word and are sorted by ranges of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordinals, running_total
from ..rng import h
from .common import WORD, save, table

#: Knots (time, weight) from time 0 to time 1.
Schedule = Sequence[tuple[float, float]]


def weight(schedule: Schedule) -> Fraction:
    """The integral of a schedule, exactly."""
    knots = [(Fraction(str(t)), Fraction(str(w))) for t, w in schedule]
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule's times rise from 0 to 1 and its weights are not negative")
    return sum(((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])), Fraction(0))


def _pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float, float]]:
    """(time, next time, weight, slope, share before, share after) of the linear pieces; shares of the whole integral."""
    whole, done, out = float(weight(schedule)), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        out.append((t0, t1, w0, (w1 - w0) / (t1 - t0), done / whole, (done + area) / whole))
        done += area
    return out


def time_of_share(share: Column, schedule: Schedule) -> Column:
    """The time until which a share (0 to 1) of a schedule's demand has come: the integral, inverted piece by piece."""
    whole, found = float(weight(schedule)), F.lit(1.0)
    for t0, t1, w0, slope, before, after in reversed(_pieces(schedule)):
        area = F.greatest((share - before) * whole, F.lit(0.0))
        root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * area, F.lit(0.0)))
        at = F.when(area <= 0, F.lit(t0)).otherwise(t0 + 2 * area / root)
        found = F.when(share < after, F.least(at, F.lit(t1))).otherwise(found)
    return found


def share_at(time: Column, schedule: Schedule) -> Column:
    """The share of a schedule's demand that has come by a time."""
    whole, found = float(weight(schedule)), F.lit(1.0)
    for t0, t1, w0, slope, before, _ in reversed(_pieces(schedule)):
        u = time - t0
        found = F.when(time < t1, before + (w0 * u + slope * u * u / 2) / whole).otherwise(found)
    return found


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] | Mapping[str | None, Schedule], budget: int | None = None, cap: int = 3) -> DataFrame:
    """source, schedule (its number), source_size and target of every source, from (source, source_size).

    A list of schedules repeats over the sources by code point, null last; a mapping names
    them, other sources get none and a target of 0. The budget (all words, if not given) is shared by weight; a
    target stops at cap times the source's size and what is above is shared again by weight
    until none is above. Each round takes two sums over the sources; weights are summed exactly, so reruns agree.
    """
    if isinstance(schedules, Mapping):
        kinds = list(dict.fromkeys(tuple(map(tuple, s)) for s in schedules.values()))
        number = F.lit(None).cast("int")
        for source, schedule in schedules.items():
            number = F.when(F.col("source").eqNullSafe(F.lit(source)), kinds.index(tuple(map(tuple, schedule)))).otherwise(number)
        numbered = save(sizes.select("source", "source_size", number.alias("schedule")), "sources")
    else:
        kinds = list(schedules)
        numbered = ordinals(sizes, "source").select("source", "source_size", (F.col("ordinal") % len(kinds)).cast("int").alias("schedule"))
    weights = [weight(k) for k in kinds]
    own = F.lit(None).cast("double")
    for k, w in enumerate(weights):
        own = F.when(F.col("schedule") == k, F.lit(float(w))).otherwise(own)
    rows = numbered.withColumn("weight", own).withColumn("most", cap * F.col("source_size"))
    level, full = (0, Fraction(1)), -1
    while True:
        rest, over = float(level[0]), float(level[1])
        above = (rest * F.col("weight") / over > F.col("most")) & (F.col("weight") > 0)
        # one row for each schedule and side
        sums = rows.where("schedule is not null").groupBy("schedule", above.alias("above")).agg(F.count("*").alias("n"), F.sum("source_size").alias("words"), F.sum("most").alias("most")).collect()
        words = budget if budget is not None else rows.agg(F.sum("source_size")).first()[0] or 0 if full < 0 else words
        now = sum(r["n"] for r in sums if r["above"])
        if now == full:
            break
        open_weight = sum((weights[r["schedule"]] * r["n"] for r in sums if not r["above"]), Fraction(0))
        level, full = (max(0, words - sum(r["most"] for r in sums if r["above"])), open_weight or Fraction(1)), now
    rest, over = float(level[0]), float(level[1])
    target = F.least(rest * F.col("weight") / over, F.col("most").cast("double"))
    return rows.select("source", "schedule", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, schedules: Sequence[Schedule] | Mapping[str | None, Schedule], budget: int | None = None, cap: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, taken, begin and position, sorted by ranges of position.

    A source's documents form a stream in keyed random order, read again from its start up to
    cap times; the mix takes its first round(target) words, so only the last document is cut.
    begin is a document's place in its source's stream. position is the number of words that all sources are to have given before the
    document's first one, null if it is not taken; it follows from begin through the inverted integral of the source's schedule.
    Null and empty texts have size 0 and are not taken. Repeated rows are copies that follow one another in the stream; null ids and
    sources count as one id and one source. No document is taken more than cap times.
    """
    source, ident = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    size = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(source.alias("source"), ident.alias("doc_id"), size.alias("size"))
    # copies meet on the map side: a group of copies is one row from here on
    units = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("key", h(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranked = running_total(units, F.col("size") * F.col("copies"), "source", "key", "doc_id", "size")
    sums = save(ranked.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.min("before").alias("first")), "sources")
    targets = save(source_targets(sums.select("source", "source_size"), schedules, budget, cap), "targets")
    kinds = list(schedules) if not isinstance(schedules, Mapping) else list(dict.fromkeys(tuple(map(tuple, s)) for s in schedules.values()))
    wanted = {r["schedule"]: float(r["target"]) for r in targets.where("schedule is not null").groupBy("schedule").agg(F.sum(F.round("target").cast("bigint")).alias("target")).collect()}
    of = targets.select(F.col("source").alias("of"), "schedule", "source_size", "target").join(sums.select(F.col("source").alias("named"), "first"), F.col("of").eqNullSafe(F.col("named")))
    joined = ranked.join(of, F.col("source").eqNullSafe(F.col("of")))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    begin = F.col("before") - F.col("first") + F.col("copy") * F.col("size")
    amount = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    placed = copies.withColumn("begin", begin)
    partial = F.greatest(F.least(amount - whole * F.col("source_size") - F.col("begin"), F.col("size")), F.lit(0))
    taken = placed.withColumn("taken", (whole * F.col("size") + partial).cast("bigint"))
    share, position = F.col("begin") / amount, F.lit(None).cast("double")
    for k, schedule in enumerate(kinds):
        if weight(schedule):
            position = F.when(F.col("schedule") == k, time_of_share(share, schedule)).otherwise(position)
    timed = taken.withColumn("time", F.when(F.col("taken") > 0, position))
    before = F.lit(0.0)
    for k, schedule in enumerate(kinds):
        if wanted.get(k):
            before = before + wanted[k] * share_at(F.col("time"), schedule)
    out = timed.select("doc_id", "source", "size", "source_size", "target", "taken", "begin", "time", F.floor(before).alias("position"), "key", "schedule")
    # rows that are not taken have no position; their keys spread them over partitions of their own
    return out.orderBy(F.coalesce(F.col("time"), 2 + F.col("key") / 4294967296.0), "key", "doc_id", "begin").drop("key")


def pieces(planned: DataFrame, schedules: Sequence[Schedule] | Mapping[str | None, Schedule]) -> DataFrame:
    """One row per document and pass that the mix takes: doc_id, source, pass, words (fewer than size where the mix ends) and time, sorted by ranges of time."""
    kinds = list(schedules) if not isinstance(schedules, Mapping) else list(dict.fromkeys(tuple(map(tuple, s)) for s in schedules.values()))
    passes = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("taken") / F.col("size")).cast("bigint") - 1)
    rows = planned.where("taken > 0").withColumn("pass", F.explode(passes))
    share, time = (F.col("begin") + F.col("pass") * F.col("source_size")) / F.round("target"), F.lit(None).cast("double")
    for k, schedule in enumerate(kinds):
        if weight(schedule):
            time = F.when(F.col("schedule") == k, time_of_share(share, schedule)).otherwise(time)
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return rows.select("doc_id", "source", "size", F.col("pass").cast("int"), words.alias("words"), time.alias("time")).orderBy("time", "doc_id", "pass")


def training_stream(docs: DataFrame, schedules: Sequence[Schedule] | Mapping[str | None, Schedule], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, in order of time: doc_id, source, pass, words, time and text, cut after words where the mix ends inside a document. Ids must be unique."""
    order = pieces(plan(docs, schedules, id_col=id_col, text_col=text_col, **options), schedules)
    texts = docs.select(F.col(f"`{id_col}`").alias("of"), F.col(f"`{text_col}`").alias("text"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    return order.join(texts, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "source", "pass", "words", "time", text.alias("text")).orderBy("time", "doc_id", "pass")


#: Weights 5, 2 and 1 as integrals: sources of the first kind fade, of the second stay even, of the third grow.
SCHEDULES = [[(0, 8), (1, 2)], [(0, 2), (1, 2)], [(0, 0.5), (0.5, 1), (1, 1.5)]]


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"), SCHEDULES).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from d group by source),
r as (select *, sum(source_size) over () as words, coalesce(sum(3 * source_size) over w, 0) as full_words, sum(weight) over () - coalesce(sum(weight) over w, 0) as open_weight,
  row_number() over (order by source_size / weight, source nulls last) as place from s window w as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select (words - full_words)::double as rest, open_weight::double as over from r where (words - full_words)::double * weight / open_weight <= 3 * source_size order by place limit 1),
t as (select source, source_size, least(rest * weight / over, (3 * source_size)::double) as target from s, l),
b as (select d.*, source_size, target, round(target)::bigint as amount, (sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) - size)::bigint as begin from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (case when source_size > 0 then (amount // source_size) * size + greatest(least(amount % source_size - begin, size), 0) else 0 end)::bigint as taken from b
"""
