"""References to records that don't exist: missing, deleted or late parents, per field and period.

Both sides become one row per key before they meet: references are grouped by
(key, facts), parents reduced to their interval (first arrival, last arrival,
last removal). The streams are co-partitioned and sorted on the key and merged
linearly: Spark's sort-merge join, asked for by hint. A key that holds a third
of all references skews only the reference side, which adaptive execution
splits, the parent side being one row.

The numbers an index states are never laid out to be compared: the numbers its
slices bear are collected in blocks of ``BLOCK``, and what lies between two of
them is a run of missing numbers. Runs become rows only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.text import link_stem, squeeze
from tabularium.sources.tables import cut

BLOCK = 1000  # numbers collected in one array
LONGEST = 10_000_000  # missing numbers in a row that become rows; a longer run is one row, and whole in ``gaps``


def whole(c: Column) -> Column:
    """A field that states a whole number, as BIGINT; anything else null."""
    bare = squeeze(c)
    return F.when(bare.rlike("^[0-9]{1,18}$"), bare.try_cast("bigint"))


def arrivals(notes: DataFrame) -> DataFrame:
    """One row per (note_id, stem): first and last arrival, and the fields that refer to others."""
    return (
        notes.where("note_id is not null")
        .groupBy("note_id", "stem")
        .agg(F.min("ingested_at").alias("first_in"), F.max("ingested_at").alias("last_in"), *[F.max(c).alias(c) for c in ("partes", "parte", "obra")])
    )


def parents(notes: DataFrame, removals: DataFrame) -> DataFrame:
    """Validity interval of each stem ever seen: (stem, first_in, last_in, last_out, present).

    A stem is present if it has a row in notes and no removal after its last
    arrival; one with rows but no arrival time is present unless removed. Null
    stems are left out, repeated rows make no difference.
    """
    seen = notes.where("stem is not null").groupBy("stem").agg(F.min("ingested_at").alias("first_in"), F.max("ingested_at").alias("last_in"), F.lit(True).alias("has_row"))
    gone = removals.where("stem is not null").groupBy("stem").agg(F.max("removed_at").alias("last_out"), F.lit(True).alias("logged"))
    return (
        seen.hint("merge")
        .join(gone, "stem", "full")
        .select(
            "stem",
            "first_in",
            "last_in",
            "last_out",
            F.coalesce("logged", F.lit(False)).alias("logged"),
            (F.coalesce("has_row", F.lit(False)) & ~F.coalesce(F.col("last_out") > F.coalesce("last_in", F.lit("0001-01-01").cast("timestamp_ntz")), F.lit(False))).alias("present"),
        )
    )


def _referring(notes: DataFrame, who: DataFrame) -> DataFrame:
    """Notes that are present, with the stem they link to and the month of their arrival."""
    present = who.where("present").select("stem")
    return arrivals(notes).hint("merge").join(present, "stem").withColumn("alvo", link_stem(F.col("obra"))).withColumn("periodo", F.date_format("first_in", "yyyy-MM"))


def _indexes(refs: DataFrame) -> DataFrame:
    return refs.withColumn("n", whole(F.col("partes"))).where("n > 0").select("note_id", "periodo", "stem", "n")


def _borne(refs: DataFrame) -> DataFrame:
    """(stem, parte): the numbers that present slices of an index bear."""
    return refs.where("alvo is not null").select(F.col("alvo").alias("stem"), whole(F.col("parte")).alias("parte")).where("parte > 0").distinct()


def _runs(refs: DataFrame) -> DataFrame:
    """(note_id, periodo, stem, n, first, last): the longest runs of numbers an index states and no present slice bears."""
    index, of = _indexes(refs), ("note_id", "periodo", "stem", "n")
    have = index.hint("merge").join(_borne(refs), "stem").where("parte <= n").groupBy(*of, F.expr(f"(parte - 1) div {BLOCK}").alias("b")).agg(F.array_sort(F.collect_set("parte")).alias("ps"))
    # 0 stands before every first number, n + 1 behind every last one
    blocks = have.unionByName(index.select(*of, F.lit(-1).cast("bigint").alias("b"), F.array(F.lit(0).cast("bigint")).alias("ps")))
    blocks = blocks.withColumn("next", F.lead(F.col("ps")[0]).over(Window.partitionBy(*of).orderBy("b")))
    runs = F.expr("transform(ps, (x, i) -> struct(x + 1 as first, coalesce(get(ps, i + 1), next, n + 1) - 1 as last))")
    return blocks.select(*of, F.explode(runs).alias("r")).select(*of, "r.first", "r.last").where("first <= last")


def gaps(notes: DataFrame, removals: DataFrame) -> DataFrame:
    """(note_id, periodo, first, last): runs of slice numbers that an index states and no present slice bears, however long."""
    return _runs(_referring(notes, parents(notes, removals))).select("note_id", "periodo", "first", "last").distinct()


def found(notes: DataFrame, removals: DataFrame) -> DataFrame:
    """p2_found: every reference to a note that isn't there, was removed or came later.

    Blank links and counts that aren't whole numbers refer to nothing, as do
    notes that aren't present. Rows are distinct; empty tables give no rows. Of
    a run of more than ``LONGEST`` missing numbers (a count that can't be meant)
    only the last number and the deleted ones are rows; ``gaps`` has all runs whole.
    """
    who = cut(parents(notes, removals))  # read three times
    refs = cut(_referring(notes, who).select("note_id", "stem", "first_in", "periodo", "partes", "parte", "alvo"))  # and this five times

    # slices that name their index
    up = refs.where("alvo is not null").select("note_id", "periodo", F.col("first_in").alias("ref_in"), "alvo")
    met = up.hint("merge").join(who.withColumnRenamed("stem", "alvo"), "alvo", "left")
    caso = (
        F.when(F.col("present").isNull(), "missing")
        .when(~F.col("present"), F.when(F.col("logged"), "deleted").otherwise("missing"))
        .when(F.col("first_in") > F.col("ref_in"), "late")
    )
    obra = met.select(F.lit("obra").alias("campo"), "note_id", F.lit(0).cast("bigint").alias("parte"), "periodo", caso.alias("caso")).where("caso is not null")

    # indexes that count their slices: removed slices by their names, and what lies in the runs
    index = _indexes(refs).withColumn("base", F.regexp_replace("stem", "_INDICE$", ""))
    gone = who.where("logged and not present").select(F.regexp_extract("stem", "^(.*)_p[0-9]{2,18}$", 1).alias("base"), F.regexp_extract("stem", "_p([0-9]{2,18})$", 1).try_cast("bigint").alias("parte"), F.col("stem").alias("slice"))
    gone = gone.where(F.col("slice") == F.format_string("%s_p%02d", "base", "parte")).drop("slice")
    deleted = index.hint("merge").join(gone, "base").where("parte between 1 and n").join(_borne(refs).hint("merge"), ["stem", "parte"], "left_anti").select("note_id", "periodo", "parte").distinct()
    runs = _runs(refs).select("note_id", "periodo", F.when(F.col("last") - F.col("first") < LONGEST, F.col("first")).otherwise(F.col("last")).alias("first"), "last")
    steps = runs.select("note_id", "periodo", "first", "last", F.explode(F.expr(f"sequence(0L, (last - first) div {BLOCK})")).alias("b"))
    lost = steps.select("note_id", "periodo", F.explode(F.expr(f"sequence(first + b * {BLOCK}, least(last, first + b * {BLOCK} + {BLOCK - 1}))")).alias("parte"))
    missing = lost.hint("merge").join(deleted, ["note_id", "periodo", "parte"], "left_anti").withColumn("caso", F.lit("missing"))
    partes = missing.unionByName(deleted.withColumn("caso", F.lit("deleted"))).select(F.lit("partes").alias("campo"), "note_id", "parte", "periodo", "caso")
    return obra.unionByName(partes).distinct()


def summary(cases: DataFrame) -> DataFrame:
    """Orphan references per field, month and kind."""
    return cases.groupBy("campo", "periodo", "caso").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("note_id").alias("n_notes"))


_SQL = r"""
with n as (select note_id, stem, min(ingested_at) first_in, max(ingested_at) last_in, max(partes) partes, max(parte) parte, max(obra) obra
           from notes where note_id is not null group by note_id, stem),
seen as (select stem, min(ingested_at) first_in, max(ingested_at) last_in from notes where stem is not null group by stem),
gone as (select stem, max(removed_at) last_out from removals where stem is not null group by stem),
who as (select coalesce(s.stem, g.stem) stem, s.first_in, s.stem is not null and not coalesce(g.last_out > s.last_in, false) present, g.stem is not null logged
        from seen s full join gone g on s.stem = g.stem),
refs as (select n.*, strftime(n.first_in, '%Y-%m') periodo,
           case when obra is null or trim(obra) in ('', 'null', '[]') then null else
           nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(case when contains(obra, '[[') then regexp_extract(obra, '\[\[([^\]]*)\]\]', 1) else obra end, '[|#].*$', ''), '^.*/', '')), '(?i)\.md$', '')), '') end alvo
         from n join who w on n.stem = w.stem and w.present),
c as (select note_id, periodo, stem, try_cast(trim(partes) as bigint) n from refs where regexp_matches(trim(partes), '^[0-9]{1,18}$')),
h as (select distinct alvo stem, try_cast(trim(parte) as bigint) parte from refs where alvo is not null and regexp_matches(trim(parte), '^[0-9]{1,18}$'))
"""

FOUND_SQL = _SQL + r""",
o as (select 'obra' campo, r.note_id, 0::bigint parte, r.periodo,
        case when w.stem is null or not w.present and not w.logged then 'missing' when not w.present then 'deleted' when w.first_in > r.first_in then 'late' end caso
      from refs r left join who w on w.stem = r.alvo where r.alvo is not null),
k as (select note_id, periodo, stem, unnest(range(1, n + 1)) parte from c),
p as (select 'partes' campo, k.note_id, k.parte, k.periodo, case when w.stem is not null then 'deleted' else 'missing' end caso
      from k left join who w on w.stem = regexp_replace(k.stem, '_INDICE$', '') || '_p' || lpad(k.parte::varchar, greatest(2, length(k.parte::varchar))::int, '0') and w.logged and not w.present
      where not exists (select 1 from h where h.stem = k.stem and h.parte = k.parte))
select distinct * from o where caso is not null union select distinct * from p
"""

GAPS_SQL = _SQL + r""",
x as (select *, 0 p from c union all select c.*, h.parte from c join h on h.stem = c.stem and h.parte between 1 and c.n),
y as (select *, coalesce(lead(p) over (partition by note_id, periodo, stem, n order by p), n + 1) nx from x)
select distinct note_id, periodo, p + 1 as first, nx - 1 as last from y where nx > p + 1
"""
