"""Further queries of the collection's operators: graph faults, pages, indexes, catalogue, lookups between layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import dims
from tabularium.operators import anchors as A
from tabularium.operators import connect as K
from tabularium.operators import notes as N
from tabularium.operators import slices as S
from tabularium.operators import vault as V
from tabularium.operators import wordscore as L
from tabularium.operators.multivalue import split_values
from tabularium.plans import reference as R
from tabularium.plans.reference import TARGET, blank, link, masters, notes
from tabularium.sources.tables import cut, table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_K = dims.sql_values(dims.KINDS_BY_SOURCE, "tf", "tp")
_CODES = lambda pairs: "(" + ", ".join(f"'{c}'" for _, c in pairs) + ")"
_FAULTS = rf"""{notes('has_fm', 'stem', 'tipo', 'tipo_fonte', 'status', 'area', 'parte', 'obra', 'partes', 'corpo', 'confiabilidade')},
lk as (select *, {link('obra')} target from n), bl as (select distinct note_id, {link('l')} t from (select note_id, unnest(regexp_extract_all(corpo, '\[\[[^\]]*\]\]')) l from n)),
f as (select note_id, 'error' severity, 'no_metadata' code from n where not coalesce(has_fm, false)
 union select note_id, 'error', 'slice_without_link' from n where not {blank('parte')} and {blank('obra')}
 union select note_id, 'error', 'orphan' from lk where not {blank('parte')} and target is not null and target not in (select stem from n where stem is not null)
 union select i.note_id, 'error', 'slice_count' from n i where regexp_matches(trim(partes), '^[0-9]{{1,9}}$') and trim(partes)::bigint <> (select count(*) from lk where lk.target = i.stem and not {blank('lk.parte')})
 union select note_id, 'error', 'kind' from n where not {blank('tipo')} and tipo not in (select canonico from vocabulary where campo = 'tipo')
 union select note_id, 'error', 'status' from n where not {blank('status')} and status not in (select canonico from vocabulary where campo = 'status')
 union select note_id, 'error', 'no_area' from n where {blank('parte')} and {blank('area')}
 union select note_id, 'error', 'pair' from n where not {blank('tipo')} and not {blank('tipo_fonte')} and (tipo_fonte, tipo) not in (select (tf, tp) from {_K})
 union select note_id, 'error', 'duplicate_name' from n where stem in (select stem from n group by stem having count(*) > 1)
 union select note_id, 'warning', 'trust' from n where not {blank('confiabilidade')} and confiabilidade not in ('Oficial', 'Doutrinária', 'Interna', 'A-conferir', 'Conferida')
 union select note_id, 'warning', 'area_code' from n where regexp_matches(stem, '{N.NAME}') and not regexp_matches(stem, '(?i)_p[0-9]+$') and regexp_extract(stem, '{N.NAME}', 1) not in {_CODES(dims.AREA_CODES)}
 union select note_id, 'warning', 'kind_code' from n where regexp_matches(stem, '{N.NAME}') and not regexp_matches(stem, '(?i)_p[0-9]+$') and regexp_extract(stem, '{N.NAME}', 2) not in {_CODES(dims.KINDS)}
 union select note_id, 'warning', 'count_not_a_number' from n where not {blank('partes')} and not regexp_matches(trim(partes), '^[0-9]{{1,9}}$')
 union select note_id, 'warning', 'name' from n where not regexp_matches(stem, '{N.NAME}') and not regexp_matches(stem, '(?i)_p[0-9]+$')
 union select note_id, 'warning', 'broken_link' from bl where t is not null and not starts_with(t, '«') and t not in (select stem from n where stem is not null))"""


def _faults(spark, d):
    return V.findings(table(spark, d, "notes"), table(spark, d, "vocabulary"))


@query("C24_graph_faults", f"with {_FAULTS} select note_id, severity, code from f")
def c24(spark, d):
    return _faults(spark, d)


@query("A02_fault_families", f"with {_FAULTS}, g as (select code, count(*)::bigint n from f group by code), r as (select *, row_number() over (order by n desc, code)::bigint rk from g) select * from r where rk <= 6")
def a02(spark, d):
    return V.families(_faults(spark, d))


@query("A01_worst_severity", f"with {_FAULTS}, w as (select n.note_id, max(case when severity = 'error' then 2 when severity = 'warning' then 1 else 0 end) s from n left join f using (note_id) group by 1) select case s when 2 then 'error' when 1 then 'warning' else 'none' end worst, count(*)::bigint n from w group by 1")
def a01(spark, d):
    return V.worst(table(spark, d, "notes"), _faults(spark, d))


_RF = list(dict.fromkeys(f for _, f in dims.REQUIRED))


@query("J19_required_blanks", f"with {notes('tipo_fonte', 'parte', *_RF)}, l as (" + " union all ".join(f"select tipo_fonte, '{f}' campo from n where {blank('parte')} and {blank(f)}" for f in _RF) + f") select tipo_fonte, campo, count(*)::bigint n from l where (tipo_fonte, campo) in (select (a, b) from {dims.sql_values(dims.REQUIRED, 'a', 'b')}) group by all")
def j19(spark, d):
    return V.required_blanks(table(spark, d, "notes"))


_PAGES = f"{R._LINES}, x as (select *, nullif(regexp_extract(line, '{R._ALINE}', 1), '') a from l), y as (select *, last_value(a ignore nulls) over (partition by master_id order by line_no rows unbounded preceding) page from x), pg as (select master_id, page, min(line_no)::bigint first_line, count(*)::bigint n_lines, string_agg(line, chr(10) order by line_no) as text from y where a is null and trim(line) <> '' and page is not null group by master_id, page)"


@query("C04_pages", f"with {_PAGES} select master_id, page, first_line, n_lines, md5(text) digest from pg")
def c04(spark, d):
    return V.pages(table(spark, d, "masters")).select("master_id", "page", "first_line", "n_lines", F.md5("text").alias("digest"))


@query("C04_assembled", f"with {_PAGES} select master_id, md5(string_agg('{{{{p.' || page || '}}}}' || chr(10) || chr(10) || text, chr(10) || chr(10) order by first_line)) digest from pg group by master_id")
def c04b(spark, d):
    return V.assemble(V.pages(table(spark, d, "masters"))).select("master_id", F.md5("texto").alias("digest"))


@query("C02_text_layer", rf"with {_PAGES}, s as (select master_id, length(regexp_replace(text, '\s', '', 'g')) < 10 or coalesce(try_cast(page as bigint) % 3 = 0, false) and length(regexp_replace(text, '\s', '', 'g')) < 300 e from pg) select master_id, count(*)::bigint n_pages, count(*) filter (where e)::bigint n_empty, count(*) filter (where e) < 1 searchable from s group by master_id")
def c02(spark, d):
    pages = V.pages(table(spark, d, "masters"))
    big = pages.where("try_cast(page as bigint) % 3 = 0").select("master_id", "page")  # the tables know no images: every third page stands for one
    return V.text_layer(pages, images=big)


@query("F15_basic_clean", rf"with {masters('corpo')} select master_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(corpo, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) digest from m")
def f15(spark, d):
    once = table(spark, d, "masters").where("master_id is not null and corpo is not null").groupBy("master_id").agg(F.max("corpo").alias("t"))
    return once.select("master_id", F.md5(V.basic(F.col("t"))).alias("digest"))


@query("A17_cleaning_counts", rf"with {masters('corpo')} select master_id, len(regexp_extract_all(corpo, '[\p{{L}}\p{{N}}_]-\n[a-záàâãéêíóôõúüçñäöüß]'))::bigint n_joined from m")
def a17(spark, d):
    from tabularium.operators.clean import clean

    return clean(table(spark, d, "masters")).select("master_id", "n_joined")


@query("C13_index_notes", rf"with {notes('stem', 'parte', 'obra', 'pagina_inicio', 'pagina_fim')}, s as (select {link('obra')} as work, try_cast(trim(parte) as bigint) p, stem, case when regexp_matches(pagina_inicio, '^[0-9]{{1,9}}$') then pagina_inicio::bigint end a, case when regexp_matches(pagina_fim, '^[0-9]{{1,9}}$') then pagina_fim::bigint end z from n where not {blank('parte')}) select work, count(*)::bigint n, min(a) first_page, max(z) last_page, string_agg('- [[' || stem || ']]', chr(10) order by p, stem) slices from s where work is not null and p is not null group by work")
def c13(spark, d):
    return V.slice_index(table(spark, d, "notes"))


_SL = R.SQL["C11_slices"].split("\nselect master_id, parte, sum(words)")[0]


@query("W05_C12_slice_titles", _SL + r""", hd as (select master_id, line_no, rtrim(regexp_extract(line, '^#{1,4}\s+(.*)$', 1)) head from l where regexp_matches(line, '^#{1,4}\s+\S')) select r.master_id, r.parte, coalesce(left(arg_min(hd.head, r.first_line) filter (where hd.head is not null), 70), 'Parte ' || lpad(r.parte::varchar, 2, '0')) titulo from r left join hd on hd.master_id = r.master_id and hd.line_no = r.first_line group by r.master_id, r.parte""")
def w05(spark, d):
    return V.slice_titles(table(spark, d, "masters"), TARGET)


@query("C38_catalogue", f"with {R._IDS}, x as (select i.work, i.label, i.num, row_number() over (partition by i.work order by df.df, i.n desc, i.label, i.num) rk from ids i join df using (label, num)), g as (select work, count(*)::bigint n_ids, string_agg(label || ' ' || num, '; ' order by rk) ids from x where rk <= 10 group by work), t as (select stem, max(titulo) titulo from notes group by stem) select g.work, coalesce(nullif(trim(t.titulo), ''), g.work) alias, n_ids, g.ids from g left join t on t.stem = g.work")
def c38(spark, d):
    return V.catalogue(table(spark, d, "notes"), K.distinctive(cut(R._ids(spark, d))))


@query("J10_sources_of_notes", rf"with {notes('titulo')}, {masters('titulo', 'converted_at', 'corpo')}, mt as (select master_id, max(titulo) titulo, max(converted_at) born from masters where master_id is not null and titulo is not null group by 1), k as (select regexp_replace(regexp_replace(lower(translate(titulo, '{N.ACCENTED}', '{N.PLAIN}')), '_ocr\b', '', 'g'), '[^a-z0-9]', '', 'g') k, arg_min(master_id, (born, master_id)) master_id from mt group by 1) select n.note_id, k.master_id from n join k on k.k = regexp_replace(regexp_replace(lower(translate(n.titulo, '{N.ACCENTED}', '{N.PLAIN}')), '_ocr\b', '', 'g'), '[^a-z0-9]', '', 'g') where k.k <> ''")
def j10(spark, d):
    return V.sources_of(table(spark, d, "notes"), table(spark, d, "masters"))


@query("J18_dangling_hubs", f"with {R._HUB}, h as (select hub_id, count(*)::bigint n from (select note_id, max(hub_id) hub_id from notes where note_id is not null group by 1) where not {blank('hub_id')} group by 1) select hub_id, n from h where hub_id not in (select label || '-' || num from hb)")
def j18(spark, d):
    return V.dangling_hubs(table(spark, d, "notes"), K.hubs(R._ids(spark, d)))


@query("X02_author_year", f"with {notes('autoria', 'ano', 'titulo', 'parte')}, x as (select note_id, ano, titulo, upper(trim(split_part(autoria, ',', 1))) who from n where {blank('parte')} and not {blank('autoria')} and regexp_matches(ano, '^[0-9]{{4}}$')), y as (select *, count(*) over (partition by who, ano) c, row_number() over (partition by who, ano order by titulo nulls first, note_id) i from x) select note_id, who || ', ' || ano || case when c > 1 then repeat('z', ((i - 1) // 26)::int) || chr((97 + (i - 1) % 26)::int) else '' end citation from y")
def x02(spark, d):
    return V.author_year_letters(table(spark, d, "notes"))


@query("X04_short_authors")
def x04(spark, d):
    return V.short_authors(split_values(table(spark, d, "notes").select("note_id", "autoria").distinct(), ("autoria",)))


@query("C40_language_fixes", f"with d as ({R.SQL['C03_language']}) select doc_id, lang was, idioma becomes from documents join d using (doc_id) where lang is distinct from idioma and not ambiguous")
def c40(spark, d):
    docs = table(spark, d, "documents")
    found = L.detect(docs).where("not ambiguous").select("doc_id", "idioma")
    return docs.select("doc_id", "lang").join(found, "doc_id").where(~F.col("lang").eqNullSafe(F.col("idioma"))).select("doc_id", F.col("lang").alias("was"), F.col("idioma").alias("becomes"))


@query("C31_to_flag", f"with {notes('hub_id', 'status')}, f as (select distinct note_id fid, split_part(hub_id, '-', 1) label, regexp_replace(substr(hub_id, instr(hub_id, '-') + 1), '[^0-9]', '', 'g') num from n where not {blank('hub_id')}), t as (select distinct m.note_id from mentions m join f using (label, num) where m.note_id is not null and m.note_id <> f.fid) select n.note_id, n.status was from n join t using (note_id) where n.status is distinct from 'A-conferir'")
def c31(spark, d):
    hit = K.touched(R.findings(spark, d), table(spark, d, "mentions").where("note_id is not null"))
    return N.once(table(spark, d, "notes"), "status").join(hit, "note_id").where(~F.col("status").eqNullSafe("A-conferir")).select("note_id", F.col("status").alias("was"))


@query("O10_panel_order", f"with {R._BOARD}, x as (select note_id, tipo, ano, row_number() over (partition by tipo order by ano desc nulls last, stem)::bigint pos from b where status = 'Vigente') select * from x")
def o10(spark, d):
    from tabularium.operators import panels as P

    b = P.board(table(spark, d, "notes")).where("status = 'Vigente'")
    return P.ordered(b).select("note_id", "tipo", "ano", "pos")


@query("A12_layer_counts", f"with {masters('titulo', 'converted_at', 'corpo')}, t as (select titulo, max(mtime) mtime from notes where titulo is not null group by 1), s as (select case when t.titulo is null then 'absent' when m.converted_at > t.mtime then 'stale' else 'fresh' end state from m left join t using (titulo)) select state, count(*)::bigint n from s group by 1")
def a12(spark, d):
    return R.QUERIES["J13_freshness"](spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("F12_alias_and_summary", r"select note_id, coalesce(nullif(trim(titulo), ''), stem) alias, trim(regexp_replace(resumo, '\s+', ' ', 'g')) resumo from (select note_id, max(titulo) titulo, max(stem) stem, max(resumo) resumo from notes where note_id is not null group by 1) where resumo is not null")
def f12(spark, d):
    n = N.once(table(spark, d, "notes"), "titulo", "stem", "resumo").where("resumo is not null")
    return n.select("note_id", F.coalesce(F.nullif(F.trim("titulo"), F.lit("")), F.col("stem")).alias("alias"), F.trim(F.regexp_replace("resumo", r"\s+", " ")).alias("resumo"))


@query("anchor_labels", f"with {R._ANC} select label, count(*)::bigint n from an group by label")
def s04(spark, d):
    return A.anchors(table(spark, d, "masters")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("C11_slice_sizes", _SL + "\n, sl as (select master_id, parte, sum(words) w from r group by all) select count(*)::bigint slices, max(w)::bigint largest, min(w)::bigint smallest, count(distinct master_id)::bigint works from sl")
def c11s(spark, d):
    return S.slices(table(spark, d, "masters"), TARGET).agg(F.count(F.lit(1)).alias("slices"), F.max("words").alias("largest"), F.min("words").alias("smallest"), F.count_distinct("master_id").alias("works"))
