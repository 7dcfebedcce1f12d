"""Queries over tables derived from the collection, in which the faults that the operators look for do occur."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabularium.operators import anchors as A
from tabularium.operators import slices as S
from tabularium.operators import vault as V
from tabularium.plans import reference as R
from tabularium.plans.reference import TARGET, masters, notes
from tabularium.plans.vault_queries import _SL
from tabularium.sources.tables import table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# the works of one source type read one behind the other, in the order of their conversion: their pages begin anew
_LONG = f"{R._ANC}, mm as (select master_id, max(tipo_fonte) tipo_fonte, max(converted_at) born from masters where master_id is not null group by 1), lg as (select tipo_fonte, label, n, row_number() over (partition by tipo_fonte order by born nulls first, master_id, pos)::bigint pos from an join mm using (master_id) where tipo_fonte is not null)"


def _long(spark, d):
    m = table(spark, d, "masters").where("master_id is not null")
    info = m.groupBy("master_id").agg(F.max("tipo_fonte").alias("tipo_fonte"), F.max("converted_at").alias("at")).where("tipo_fonte is not null")
    a = A.anchors(m).join(info, "master_id")
    return a.select("tipo_fonte", "label", "n", F.row_number().over(Window.partitionBy("tipo_fonte").orderBy("at", "master_id", "pos")).cast("long").alias("pos"))


@query("W01_across_works", f"with {_LONG}, x as (select *, lag(n) over (partition by tipo_fonte order by pos) before from lg where n is not null) select tipo_fonte, pos, n, before from x where n < before")
def w01(spark, d):
    return A.out_of_order(_long(spark, d), "tipo_fonte")


@query("W02_across_works", f"with {_LONG} select tipo_fonte, label, count(*)::bigint times from lg group by all having count(*) > 1")
def w02(spark, d):
    return A.doubles(_long(spark, d), "tipo_fonte")


@query("W03_odd_anchors", f"with {R._ANC}, o as (select * from an where pos % 3 <> 2) select master_id, min(n) as first, max(n) as last, (max(n) - min(n) + 1 - count(distinct n))::bigint missing from o where n is not null group by master_id having max(n) - min(n) + 1 > count(distinct n)")
def w03(spark, d):
    return A.gaps(A.anchors(table(spark, d, "masters")).where("pos % 3 != 2"))


@query("C06_lost_and_invented", f"with {R._ANC}, be as (select master_id, label, count(*) c from an group by all), af as (select master_id, case when pos % 5 = 0 then label || 'x' else label end label from an where pos % 7 <> 0), aft as (select master_id, label, count(*) c from af group by all), x as (select master_id, label, coalesce(aft.c, 0) - coalesce(be.c, 0) d from be full join aft using (master_id, label)) select master_id, label, case when d < 0 then 'lost' else 'invented' end change, abs(d)::bigint times from x where d <> 0")
def c06(spark, d):
    a = A.anchors(table(spark, d, "masters"))
    after = a.where("pos % 7 != 0").withColumn("label", F.when(F.col("pos") % 5 == 0, F.concat("label", F.lit("x"))).otherwise(F.col("label")))
    return A.difference(a, after)


@query("C05_fenced_anchors", r"select master_id, regexp_matches(case when master_id % 3 = 0 then '```' || chr(10) || t when master_id % 3 = 1 then '```' || chr(10) || '`' || t else t end, '```[^`]*\{\{p\.') fenced from (select master_id, max(corpo) t from masters where master_id is not null and corpo is not null group by 1)")
def c05(spark, d):
    k = F.col("master_id") % 3
    return A.fenced(table(spark, d, "masters").select("master_id", F.when(k == 0, F.concat(F.lit("```\n"), "corpo")).when(k == 1, F.concat(F.lit("```\n`"), "corpo")).otherwise(F.col("corpo")).alias("corpo")))


@query("C11_delivered", _SL + ", sl as (select master_id, parte, sum(words) w from r group by all) select master_id, sum(w)::bigint words, count(*)::bigint n_slices, sum(w) < 600 or count(*) < 2 as whole from sl group by master_id")
def c11(spark, d):
    return S.delivered(table(spark, d, "masters"), TARGET, 600)


@query("J11_A14_collisions", f"with {notes('titulo')}, {masters('titulo', 'corpo')}, x as (select 'note' layer, upper(titulo) name, note_id id from n where titulo is not null union all select 'master', titulo, master_id from m where titulo is not null) select lower(name) name_key, count(*)::bigint n, count(distinct layer)::bigint layers, min(id) first_id from x group by 1 having count(*) > 1")
def j11(spark, d):
    n = table(spark, d, "notes").where("note_id is not null").groupBy("note_id").agg(F.max("titulo").alias("titulo"))
    m = table(spark, d, "masters").where("master_id is not null and corpo is not null").groupBy("master_id").agg(F.max("titulo").alias("titulo"))
    x = n.select(F.lit("note").alias("layer"), F.upper("titulo").alias("name"), F.col("note_id").alias("id")).unionByName(m.select(F.lit("master").alias("layer"), F.col("titulo").alias("name"), F.col("master_id").alias("id")))
    return V.collisions(x.where("name is not null"))


@query("J12_changed_by_cleaning", rf"with {masters('corpo')}, f as (select master_id, corpo, regexp_replace(regexp_replace(regexp_replace(regexp_replace(corpo, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') t from m) select master_id, case when master_id % 4 = 0 then 'absent' when t = corpo then 'equal' else 'changed' end state from f")
def j12(spark, d):
    m = table(spark, d, "masters").where("master_id is not null and corpo is not null").groupBy("master_id").agg(F.max("corpo").alias("corpo"))
    return V.compared(m, m.where("master_id % 4 != 0").select("master_id", V.basic(F.col("corpo")).alias("corpo")))


@query("S13_sources", f"with {notes('path')}, s as (select note_id, regexp_replace(path, '/[^/]*$', '') || case when note_id % 2 = 1 then '/' else '' end p from n where path is not null), k as (select note_id, regexp_replace(trim(p), '(.)/+$', '\\1') p from s) select min(note_id) ord, p as path, case when ends_with(lower(p), '.pdf') then 'file' else 'folder' end kind from k where p <> '' group by p")
def s13(spark, d):
    n = table(spark, d, "notes").where("note_id is not null").groupBy("note_id").agg(F.max("path").alias("path"))
    path = F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.when(F.col("note_id") % 2 == 1, "/").otherwise(""))
    return V.first_of_each(n.select(F.col("note_id").alias("ord"), path.alias("path"), F.lit(None).cast("string").alias("kind")))
