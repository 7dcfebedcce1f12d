"""Queries of the collection's own operators, by the ids of the inventory, each with the SQL that says the same.

Every query runs over its whole tables. The SQL is written apart from the
DataFrame code, with joins and windows of its own.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabularium.functions import dims, jsonfix
from tabularium.functions.text import is_blank, words
from tabularium.operators import anchors as A
from tabularium.operators import clean as C
from tabularium.operators import connect as K
from tabularium.operators import frontmatter as FM
from tabularium.operators import notes as N
from tabularium.operators import panels as P
from tabularium.operators import slices as S
from tabularium.operators import wordscore as L
from tabularium.operators.triage import inferred_type
from tabularium.sources.tables import cut, table
from tabularium.streaming import windows as W

TODAY = "2026-06-01"  # a parameter of the panels, so that results can be repeated
TARGET = 300  # words a slice aims at


def blank(c: str) -> str:
    return rf"({c} is null or regexp_replace({c}, '^\s+|\s+$', '', 'g') in ('', 'null', '[]'))"


def link(c: str) -> str:
    inner = rf"case when contains({c}, '[[') then regexp_extract({c}, '\[\[([^\]]*)\]\]', 1) else {c} end"
    return rf"case when {blank(c)} then null else nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace({inner}, '[|#].*$', ''), '^.*/', '')), '(?i)\.md$', '')), '') end"


def notes(*cols: str) -> str:
    return "n as (select note_id, " + ", ".join(f"max({c}) as {c}" for c in cols) + " from notes where note_id is not null group by note_id)"


def masters(*cols: str) -> str:
    return "m as (select master_id, " + ", ".join(f"max({c}) as {c}" for c in cols) + " from masters where master_id is not null and corpo is not null group by master_id)"


Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_t = table
_FIELDS = ("tipo", "status", "idioma", "area", "autoria", "obra", "partes", "parte", "titulo", "ano")

# ---------------------------------------------------------------- predicates and names


@query("P01_blank", f"with {notes(*_FIELDS)} " + " union all ".join(f"select '{c}' as campo, count(*) filter (where {blank(c)})::bigint as n_blank, count(*)::bigint as n from n" for c in _FIELDS))
def p01(spark, d):
    n = N.once(_t(spark, d, "notes"), *_FIELDS)
    long = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), is_blank(F.col(c)).alias("b")) for c in _FIELDS])).alias("x")).select("x.*")
    return long.groupBy("campo").agg(F.count_if("b").alias("n_blank"), F.count(F.lit(1)).alias("n"))


@query("P02_visible", f"with {notes('path', 'file_name')} select note_id, path from n where not list_has_any(string_split(path, '/'), ['99-Templates', 'Radar', '.obsidian', '.trash']) and not regexp_matches(file_name, '^(RELATORIO|_)')")
def p02(spark, d):
    return N.visible(_t(spark, d, "notes"))


@query("P04_roles", f"with {notes('stem', 'parte', 'obra', 'partes', 'hub_id')} select note_id, not {blank('parte')} and not {blank('obra')} as is_slice, coalesce(contains(upper(stem), '_INDICE'), false) or not {blank('partes')} as is_index, not {blank('hub_id')} as is_hub from n")
def p04(spark, d):
    return N.roles(_t(spark, d, "notes"))


@query("P07_vocabulary", f"with {notes('tipo', 'status')}, l as (select note_id, 'tipo' campo, tipo valor from n union all select note_id, 'status', status from n) select campo, valor, count(*)::bigint n from l where not {blank('valor')} and not exists (select 1 from vocabulary v where v.campo = l.campo and v.canonico = l.valor) group by campo, valor")
def p07(spark, d):
    return N.outside_vocabulary(_t(spark, d, "notes"), _t(spark, d, "vocabulary"), "tipo", "status")


@query("P12_incoherent_pairs", f"with {notes('tipo', 'tipo_fonte')}, k as (select * from {dims.sql_values(dims.KINDS_BY_SOURCE, 'tf', 'tp')}) select note_id, tipo, tipo_fonte from n where not {blank('tipo')} and not {blank('tipo_fonte')} and (tipo_fonte, tipo) not in (select (tf, tp) from k)")
def p12(spark, d):
    return N.incoherent_pairs(_t(spark, d, "notes"))


@query("P13_derived_kind", f"with {notes('tipo', 'tipo_fonte')}, k as (select tf, max(tp) tp from {dims.sql_values(dims.KINDS_BY_SOURCE, 'tf', 'tp')} group by tf having count(*) = 1) select note_id, tp as tipo from n join k on k.tf = n.tipo_fonte where {blank('tipo')}")
def p13(spark, d):
    return N.derived_kind(_t(spark, d, "notes"))


_NAME = N.NAME
_P = {i: f"regexp_extract(stem, '{_NAME}', {i})" for i in range(1, 7)}
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query("P15_name_parts", f"with {notes('stem')} select note_id, {_P[1]} area, {_P[2]} tipo, {_P[3]} ano, {_P[4]} titulo, {_P[5]} autor, {_P[6]} sufixo, {_P[1]} in {_in([c for _, c in dims.AREA_CODES])} known_area, {_P[2]} in {_in([c for _, c in dims.KINDS])} known_kind from n where regexp_matches(stem, '{_NAME}')")
def p15(spark, d):
    return N.name_parts(_t(spark, d, "notes"))


@query("P15_off_grammar", f"with {notes('stem')} select note_id, stem from n where not regexp_matches(stem, '{_NAME}') and not regexp_matches(stem, '(?i)_p[0-9]+$')")
def p15b(spark, d):
    return N.off_grammar(_t(spark, d, "notes"))


# ---------------------------------------------------------------- scalar functions


@query("F01_link_target", f"with {notes('obra')} select note_id, {link('obra')} as target from n")
def f01(spark, d):
    from tabularium.functions.text import link_stem

    return N.once(_t(spark, d, "notes"), "obra").select("note_id", link_stem(F.col("obra")).alias("target"))


@query("F02_body_links", rf"with {notes('corpo')}, l as (select note_id, unnest(regexp_extract_all(corpo, '\[\[[^\]]*\]\]')) l from n), x as (select note_id, {link('l')} target from l) select note_id, target, count(*)::bigint n from x where target is not null and not starts_with(target, '«') group by all")
def f02(spark, d):
    return N.body_links(_t(spark, d, "notes")).groupBy("note_id", "target").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = f"translate(titulo, '{N.ACCENTED}', '{N.PLAIN}')"


@query("F03_F07_slugs", rf"""with {notes('titulo')}
select note_id, regexp_replace(left(regexp_replace(titulo, '[^\p{{L}}\p{{N}}_\-]+', '-', 'g'), 60), '^-+|-+$', '', 'g') prefixo, {_PLAIN} sem_acento,
  regexp_replace(regexp_replace(lower({_PLAIN}), '[^a-z0-9/]+', '-', 'g'), '^-+|-+$', '', 'g') slug, regexp_replace(regexp_replace(lower({_PLAIN}), '_ocr\b', '', 'g'), '[^a-z0-9]', '', 'g') chave
from n where titulo is not null""")
def f03(spark, d):
    t = F.col("titulo")
    return N.once(_t(spark, d, "notes"), "titulo").where("titulo is not null").select("note_id", N.prefix(t).alias("prefixo"), N.plain(t).alias("sem_acento"), N.slug(t).alias("slug"), N.name_key(t).alias("chave"))


@query("F05_tags", rf"select note_id, tag, regexp_replace(regexp_replace(lower(translate(tag, '{N.ACCENTED}', '{N.PLAIN}')), '[^a-z0-9/]+', '-', 'g'), '^-+|-+$', '', 'g') valid, count(*)::bigint n from (select note_id, unnest(tags) tag from (select distinct note_id, tags from notes where note_id is not null)) where tag is not null group by note_id, tag")
def f05(spark, d):
    n = _t(spark, d, "notes").where("note_id is not null").select("note_id", "tags").distinct()
    t = n.select("note_id", F.explode("tags").alias("tag")).where("tag is not null")
    return t.groupBy("note_id", "tag").agg(F.count(F.lit(1)).alias("n")).select("note_id", "tag", N.slug(F.col("tag")).alias("valid"), "n")


@query("F08_areas_by_key", f"with {notes('area')}, k as (select * from {dims.sql_values(dims.AREA_KEYS, 'chave', 'nome')}) select distinct note_id, k.nome as area from n join k on contains(lower(translate(area, '{N.ACCENTED}', '{N.PLAIN}')), k.chave) where not {blank('area')}")
def f08(spark, d):
    return N.areas_by_key(_t(spark, d, "notes"))


@query("F13_roman", "with r as (select unnest(range(1, 4000)) n, ['', 'm', 'mm', 'mmm'] t, ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'] h, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'] z, ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'] u) select n::bigint n, t[n // 1000 + 1] || h[n // 100 % 10 + 1] || z[n // 10 % 10 + 1] || u[n % 10 + 1] roman from r")
def f13(spark, d):
    return spark.range(1, 4000).select(F.col("id").alias("n"), N.to_roman(F.col("id")).alias("roman"))


@query("F14_page_label", "with p as (select unnest(range(1, 401)) n), r as (select n, ['', 'c', 'cc', 'ccc', 'cd'] h, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'] z, ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'] u from p) select n::bigint physical, case when n <= 16 then h[n // 100 + 1] || z[n // 10 % 10 + 1] || u[n % 10 + 1] else (n - 16)::varchar end as label from r")
def f14(spark, d):
    return spark.range(1, 401).select(F.col("id").alias("physical"), A.page_label(F.col("id"), 16, 16).alias("label"))


@query("F20_F23_text_facts", rf"select doc_id, len(regexp_extract_all(text, '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B]+'))::bigint words, ((length(text) - length(replace(text, 'lei', ''))) // 3)::bigint lei, md5(text) digest from documents where text is not null")
def f20(spark, d):
    t = F.col("text")
    n = F.floor((F.length(t) - F.length(F.replace(t, F.lit("lei"), F.lit("")))) / 3)
    return _t(spark, d, "documents").where("text is not null").select("doc_id", words(t).alias("words"), n.cast("long").alias("lei"), F.md5(t).alias("digest"))


@query("F24_surname", f"select name_id, upper(trim(split_part(nome, ',', 1))) as sobrenome from author_names where contains(nome, ',')")
def f24(spark, d):
    return _t(spark, d, "author_names").where(F.contains("nome", F.lit(","))).select("name_id", N.surname(F.col("nome")).alias("sobrenome"))


@query("T01_stamp", f"with {notes('mtime')} select note_id, strftime(mtime, '%d/%m %H:%M') stamp, mtime >= date '{TODAY}' - interval 30 day recent from n where mtime is not null")
def t01(spark, d):
    n = N.once(_t(spark, d, "notes"), "mtime").where("mtime is not null")
    return n.select("note_id", F.date_format("mtime", "dd/MM HH:mm").alias("stamp"), (F.col("mtime") >= F.date_sub(F.to_date(F.lit(TODAY)), 30).cast("timestamp_ntz")).alias("recent"))


@query("json_props", "select event_type, (json_extract_string(props, '$.k'))::bigint as k, count(*)::bigint n from events group by all")
def n01(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return _t(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("N02_mended_json", """with n as (select distinct note_id, stem, titulo, tipo, area from notes where note_id is not null and stem is not null and titulo is not null and tipo is not null and area is not null)
select note_id, stem, 'o termo "' || titulo || '", de fato' || chr(10) || 'diz "' || area || '": sim' resumo, tipo || ' "de" fato' first_item, note_id as n from n""")
def n02(spark, d):
    """Answers with loose quotes and line breaks, in a fence, read into columns."""
    n = _t(spark, d, "notes").where("note_id is not null and stem is not null and titulo is not null and tipo is not null and area is not null").select("note_id", "stem", "titulo", "tipo", "area").distinct()
    said = F.concat(
        F.lit('Segue:\n```json\n{"stem": "'), "stem", F.lit('", "resumo": "o termo "'), "titulo", F.lit('", de fato\ndiz "'), "area", F.lit('": sim",\n "items": ["'), "tipo", F.lit(' "de" fato", "b"], "n": '), "note_id", F.lit("}\n```\n")
    )
    got = F.from_json(jsonfix.recover_json(said), "stem string, resumo string, items array<string>, n bigint")
    return n.select("note_id", got.alias("j")).select("note_id", "j.stem", "j.resumo", F.get("j.items", F.lit(0)).alias("first_item"), "j.n")


# ---------------------------------------------------------------- joins


@query("J02_orphans", f"with {notes('stem', 'parte', 'obra')}, s as (select note_id, {link('obra')} target from n where not {blank('parte')}) select note_id, target from s where target is not null and target not in (select stem from n where stem is not null)")
def j02(spark, d):
    return N.orphans(_t(spark, d, "notes"))


@query("J03_slice_counts", rf"with {notes('stem', 'partes', 'parte', 'obra')}, l as (select {link('obra')} stem, count(*) c from n where not {blank('parte')} group by 1), i as (select note_id, stem, trim(partes)::bigint declared from n where regexp_matches(trim(partes), '^[0-9]{{1,9}}$')) select i.note_id, declared, coalesce(c, 0)::bigint actual from i left join l using (stem) where declared <> coalesce(c, 0)")
def j03(spark, d):
    return N.slice_counts(_t(spark, d, "notes"))


@query("J04_broken_links", rf"with {notes('corpo')}, l as (select distinct note_id, unnest(regexp_extract_all(corpo, '\[\[[^\]]*\]\]')) l from n), x as (select distinct note_id, {link('l')} target from l) select note_id, target from x where target is not null and not starts_with(target, '«') and not exists (select 1 from notes where stem = target)")
def j04(spark, d):
    return N.broken_links(_t(spark, d, "notes"))


@query("J05_J11_duplicate_stems", f"with {notes('stem')} select lower(stem) stem_key, count(*)::bigint n from n where stem is not null group by 1 having count(*) > 1")
def j05(spark, d):
    return N.duplicate_stems(_t(spark, d, "notes"))


@query("J06_uncovered_areas", f"with {notes('area')}, k as (select * from {dims.sql_values(dims.AREA_KEYS, 'chave', 'nome')}), u as (select k.nome area, count(distinct note_id) n from n join k on contains(lower(translate(area, '{N.ACCENTED}', '{N.PLAIN}')), k.chave) group by 1) select area, n::bigint n from u where area not in (select assunto from subjects)")
def j06(spark, d):
    used = N.areas_by_key(_t(spark, d, "notes")).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return used.join(F.broadcast(_t(spark, d, "subjects").select(F.col("assunto").alias("area"))), "area", "left_anti")


@query("J13_freshness", f"with {notes('stem', 'mtime')}, {masters('titulo', 'converted_at', 'corpo')}, t as (select titulo, max(mtime) mtime from (select titulo, mtime from notes where titulo is not null) group by titulo) select m.master_id, case when t.titulo is null then 'absent' when m.converted_at > t.mtime then 'stale' else 'fresh' end state from m left join t using (titulo)")
def j13(spark, d):
    m = _t(spark, d, "masters").where("master_id is not null and corpo is not null").groupBy("master_id").agg(F.max("titulo").alias("titulo"), F.max("converted_at").alias("converted_at"))
    n = _t(spark, d, "notes").where("titulo is not null").groupBy("titulo").agg(F.max("mtime").alias("mtime"), F.lit(True).alias("there"))
    return m.join(n, "titulo", "left").select("master_id", F.when(F.col("there").isNull(), "absent").when(F.col("converted_at") > F.col("mtime"), "stale").otherwise("fresh").alias("state"))


# the rules in RE2: what counts as letter, digit and space is Unicode's, as in the query
_WORD, _SPACE = r"\p{L}\p{M}\p{N}\p{Pc}", r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _re2(p: str) -> str:
    p = p.replace(r"\s", f"[{_SPACE}]").replace(r"\d", r"\p{Nd}")
    out = []
    for alt in p.split("|") if "(" not in p else [p]:
        alt = f"(?:^|[^{_WORD}])" + alt[2:] if alt.startswith(r"\b") else alt
        out.append(alt[:-2] + f"(?:$|[^{_WORD}])" if alt.endswith(r"\b") else alt)
    return "(?i)" + "|".join(out).replace(r"|\b", f"|(?:^|[^{_WORD}])").replace("'", "''")


_HITS = " union ".join(
    ["select doc_id, {i} o, '{t}' tf, 2 w, true named from d where {c}".format(i=i, t=t, c=" or ".join(f"contains(lower(obra), '{k}')" for k in keys)) for i, (keys, t) in enumerate(dims.NAME_RULES)]
    + [f"select doc_id, {len(dims.NAME_RULES) + i}, '{t}', {w}, false from d where regexp_matches(text, '{_re2(p)}')" for i, (p, t, w) in enumerate(dims.CONTENT_RULES)]
)


@query("J15_C01_inferred_source", f"""with d as (select * from documents where doc_id is not null), h as ({_HITS}),
g as (select doc_id, tf, sum(w) score, min(o) o, coalesce(sum(w) filter (where named), 0) nm, coalesce(sum(w) filter (where not named), 0) tx from h group by all),
b as (select * from (select *, row_number() over (partition by doc_id order by score desc, o) r, sum(nm) over (partition by doc_id) anm, sum(tx) over (partition by doc_id) atx from g) where r = 1),
i as (select distinct doc_id from d)
select i.doc_id, case when score >= 2 then tf else '' end tipo_fonte, coalesce(score, 0)::bigint score,
 case when coalesce(score, 0) < 2 then 'baixa' when nm > 0 and tx > 0 then 'alta' when anm > 0 and atx > 0 and nm = 0 then 'media' when tx >= 4 then 'alta' else 'media' end confianca
from i left join b using (doc_id)""")
def j15(spark, d):
    return inferred_type(_t(spark, d, "documents"))


@query("J21_first_claim", "select source, doc_id, obra from (select source, obra, doc_id, row_number() over (partition by source, obra order by added_at, doc_id) r from documents where source is not null and obra is not null) where r = 1")
def j21(spark, d):
    w = Window.partitionBy("source", "obra").orderBy("added_at", "doc_id")
    return _t(spark, d, "documents").where("source is not null and obra is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "doc_id", "obra")


# ---------------------------------------------------------------- aggregations


@query("A06_A07_summary", f"with {notes('stem', 'parte', 'obra', 'partes', 'hub_id')} select count(*)::bigint notes, count(*) filter (where coalesce(contains(upper(stem), '_INDICE'), false) or not {blank('partes')})::bigint indexes, count(*) filter (where not {blank('parte')} and not {blank('obra')})::bigint slices, count(*) filter (where not {blank('hub_id')})::bigint hubs from n")
def a06(spark, d):
    r = N.roles(_t(spark, d, "notes"))
    return r.agg(F.count(F.lit(1)).alias("notes"), F.count_if("is_index").alias("indexes"), F.count_if("is_slice").alias("slices"), F.count_if("is_hub").alias("hubs"))


@query("A08_grouping_sets", f"with {notes('tipo_fonte', 'status', 'confiabilidade')} select tipo_fonte, status, confiabilidade, count(*)::bigint n from n group by grouping sets ((tipo_fonte), (status), (confiabilidade), ())")
def a08(spark, d):
    N.once(_t(spark, d, "notes"), "tipo_fonte", "status", "confiabilidade").createOrReplaceTempView("_a08")
    return spark.sql("select tipo_fonte, status, confiabilidade, count(*) n from _a08 group by grouping sets ((tipo_fonte), (status), (confiabilidade), ())")


@query("A10_slices_per_work", rf"with {notes('stem', 'parte', 'obra', 'status')}, s as (select {link('obra')} as work, stem, status from n where not {blank('parte')}) select work, count(*)::bigint total, count(*) filter (where status <> 'Vigente' or status is null)::bigint pending, arg_min(stem, stem) first_stem from s where work is not null group by work")
def a10(spark, d):
    from tabularium.functions.text import link_stem

    s = N.once(_t(spark, d, "notes"), "stem", "parte", "obra", "status").where(~is_blank(F.col("parte"))).select(link_stem(F.col("obra")).alias("work"), "stem", "status").where("work is not null")
    return s.groupBy("work").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(F.col("status") == "Vigente", F.lit(False))).alias("pending"), F.min("stem").alias("first_stem"))


@query("A15_word_frequency", r"with w as (select lang, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) word from documents where lang is not null and text is not null) select lang, word, count(*)::bigint n from w group by all")
def a15(spark, d):
    w = _t(spark, d, "documents").where("lang is not null and text is not null").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(L.TOKEN), F.lit(0))).alias("word"))
    return w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("A19_label_list", "select note_id, string_agg(distinct label, ', ' order by label) labels, count(distinct num)::bigint nums from mentions where label is not null group by note_id")
def a19(spark, d):
    m = _t(spark, d, "mentions").where("label is not null")
    return m.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"), F.count_distinct("num").alias("nums"))


# ---------------------------------------------------------------- anchors and lines

_ANC = rf"{masters('corpo')}, a as (select master_id, unnest(regexp_extract_all(corpo, '\{{\{{(?:p|loc)\.([0-9ivxlcdm]+)\}}\}}', 1)) label, generate_subscripts(regexp_extract_all(corpo, '\{{\{{(?:p|loc)\.([0-9ivxlcdm]+)\}}\}}', 1), 1)::bigint pos from m), an as (select *, try_cast(label as bigint) n from a)"


def _anchors(spark, d):
    return A.anchors(_t(spark, d, "masters"))


@query("D04_anchors", f"with {_ANC} select master_id, pos, label, n from an")
def d04(spark, d):
    return _anchors(spark, d)


@query("W01_out_of_order", f"with {_ANC}, x as (select *, lag(n) over (partition by master_id order by pos) before from an where n is not null) select master_id, pos, n, before from x where n < before")
def w01(spark, d):
    return A.out_of_order(_anchors(spark, d))


@query("W02_double_anchors", f"with {_ANC} select master_id, label, count(*)::bigint times from an group by all having count(*) > 1")
def w02(spark, d):
    return A.doubles(_anchors(spark, d))


@query("W03_gaps", f"with {_ANC} select master_id, min(n) as first, max(n) as last, (max(n) - min(n) + 1 - count(distinct n))::bigint missing from an where n is not null group by master_id having max(n) - min(n) + 1 > count(distinct n)")
def w03(spark, d):
    return A.gaps(_anchors(spark, d))


@query("W04_page_range", f"with {_ANC} select master_id, arg_min(label, pos) first_label, arg_max(label, pos) last_label, count(*)::bigint n_anchors from an group by master_id")
def w04(spark, d):
    return A.ends(_anchors(spark, d))


@query("C05_anchor_integrity", f"""with {_ANC}, i as (select distinct master_id from masters where master_id is not null),
t as (select master_id, count(*) c from an group by 1), db as (select master_id, count(*) c from (select master_id, label from an group by all having count(*) > 1) group by 1),
ds as (select master_id, count(*) c from (select *, lag(n) over (partition by master_id order by pos) b from an where n is not null) where n < b group by 1),
g as (select master_id, max(n) - min(n) + 1 - count(distinct n) c from an where n is not null group by 1)
select i.master_id, coalesce(t.c, 0)::bigint n_anchors, coalesce(db.c, 0)::bigint n_double, coalesce(ds.c, 0)::bigint n_disorder, coalesce(g.c, 0)::bigint n_missing,
 case when coalesce(t.c, 0) = 0 or db.c > 0 or ds.c > 0 then 'fail' when g.c > 0 then 'warn' else 'ok' end verdict
from i left join t using (master_id) left join db using (master_id) left join ds using (master_id) left join g using (master_id)""")
def c05(spark, d):
    return A.integrity(_t(spark, d, "masters"), cut(_anchors(spark, d)))


_LINES = rf"{masters('corpo')}, l as (select master_id, unnest(string_split(corpo, chr(10))) line, generate_subscripts(string_split(corpo, chr(10)), 1)::bigint line_no from m)"
_ALINE = r"^\s*\{\{(?:p|loc)\.([0-9ivxlcdm]+)\}\}\s*$"


@query("X01_page_of_line", rf"with {_LINES}, x as (select *, nullif(regexp_extract(line, '{_ALINE}', 1), '') a from l), y as (select *, last_value(a ignore nulls) over (partition by master_id order by line_no rows unbounded preceding) page from x) select master_id, line_no, page from y where a is null and trim(line) <> '' and page is not null")
def x01(spark, d):
    return A.page_of_lines(_t(spark, d, "masters"))


@query("A16_C08_repeated_edges", rf"with {_LINES}, x as (select *, trim(line) s, regexp_matches(line, '\{{\{{(?:p|loc)\.([0-9ivxlcdm]+)\}}\}}')::int a from l), y as (select *, max(a) over (partition by master_id order by line_no rows between 2 preceding and 2 following) near from x) select master_id, s as line, count(*)::bigint times, sum(near)::bigint near from y where a = 0 and length(s) between 3 and 70 and not regexp_matches(s, '^[#>\-*]') group by master_id, s having count(*) >= 4 and sum(near) >= 0.7 * count(*)")
def c08(spark, d):
    return C.repeated_edges(_t(spark, d, "masters"))


@query("C09_damage_signs", rf"""with {masters('corpo')}, s as (select master_id, len(regexp_extract_all(corpo, '[\p{{L}}\p{{N}}_]-\n[\p{{L}}\p{{N}}_]'))::bigint cut_words,
 len(regexp_extract_all(corpo, '(?im)^[ \t]*(p[áa]gina[ \t]+\d+[ \t]+de[ \t]+\d+|\d{{1,4}})[ \t]*$'))::bigint loose_numbers, len(regexp_extract_all(corpo, '[|¬~^]{{2,}}'))::bigint noise,
 (select count(*) from (select unnest(string_split(corpo, chr(10))) x) where length(x) between 1 and 2)::bigint short_lines, length(corpo) size from m)
select master_id, cut_words, loose_numbers, noise, short_lines, cut_words > 3 or loose_numbers > 5 or noise > size / 500 or short_lines > 30 dirty from s""")
def c09(spark, d):
    return C.signs(_t(spark, d, "masters"))


@query("C07_clean")
def c07(spark, d):
    return C.clean(_t(spark, d, "masters"))


@query("C06_anchor_diff")
def c06(spark, d):
    m = _t(spark, d, "masters")
    after = A.anchors(C.clean(m), "master_id", "texto")
    return A.difference(A.anchors(m), after)


# ---------------------------------------------------------------- slices

_BLOCKS = rf"""{_LINES}, k as (select *, case when regexp_matches(line, '^#{{1,4}}\s+\S') then 'title' when regexp_matches(trim(line), '^\{{\{{(?:p|loc)\.([0-9ivxlcdm]+)\}}\}}$') then 'anchor' when trim(line) = '' then 'blank' else 'text' end kind from l),
kq as (select *, coalesce(max(case when kind = 'text' and starts_with(trim(line), '>') then line_no end) over v, 0) > coalesce(max(case when kind <> 'text' then line_no end) over v, 0) inq from k window v as (partition by master_id order by line_no rows unbounded preceding)),
o as (select * exclude (inq), case when kind in ('title', 'anchor') or kind = 'text' and coalesce(lag(kind) over z, 'blank') <> 'text' and not coalesce(lag(kind) over z = 'blank' and lag(kind, 2) over z = 'text' and lag(inq, 2) over z, false) then 1 else 0 end op from kq window z as (partition by master_id order by line_no)),
b as (select *, sum(op) over (partition by master_id order by line_no) block from o where kind <> 'blank'),
bl as (select master_id, block::bigint block, arg_min(kind, line_no) kind, max(case when kind = 'title' then length(regexp_extract(line, '^(#+)', 1)) end)::bigint as level, sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')))::bigint words, min(line_no)::bigint first_line from b group by all)"""
_CUT = f"""case when r.n > 0 and ((coalesce(x.level, 9) <= 2 and r.n >= {TARGET} * 0.4) or (coalesce(x.level, 9) > 2 and r.n + x.words > {int(TARGET * 1.3)} and r.n >= {TARGET} * 0.5))"""


@query("C10_blocks", f"with {_BLOCKS} select * from bl")
def c10(spark, d):
    return S.blocks(_t(spark, d, "masters"))


@query("C11_slices", f"""with recursive {_BLOCKS}, r as (
 select master_id, block, 1::bigint parte, words n, words, first_line from bl where block = 1
 union all
 select x.master_id, x.block, {_CUT} then r.parte + 1 else r.parte end, {_CUT} then x.words else r.n + x.words end, x.words, x.first_line from r join bl x on x.master_id = r.master_id and x.block = r.block + 1)
select master_id, parte, sum(words)::bigint words, count(*)::bigint n_blocks, min(first_line)::bigint first_line from r group by all""")
def c11(spark, d):
    return S.slices(_t(spark, d, "masters"), TARGET)


@query("W08_navigation", rf"with {notes('stem', 'parte', 'obra')}, s as (select note_id, stem, {link('obra')} as work, try_cast(trim(parte) as bigint) parte from n where not {blank('parte')}) select note_id, work, parte, lag(stem) over w previous, lead(stem) over w as following from s where work is not null and parte is not null window w as (partition by work order by parte, stem)")
def w08(spark, d):
    return S.navigation(_t(spark, d, "notes"))


# ---------------------------------------------------------------- front matter, language


@query("C14_front_matter", r"""with h as (select doc_id, regexp_extract(text, '^---[ \t\r]*\n((?:[^\n]*\n)*?)---[ \t\r]*\n', 1) raw from documents where regexp_matches(text, '^---[ \t\r]*\n(?:[^\n]*\n)*?---[ \t\r]*\n')),
l as (select doc_id, unnest(string_split(replace(raw, chr(13), ''), chr(10))) x from h), f as (select doc_id, trim(split_part(x, ':', 1)) campo, trim(trim(trim(substr(x, instr(x, ':') + 1)), '"'), '''') valor from l where contains(x, ':'))
select doc_id, campo, valor from f where valor not in ('', 'null', '~', 'true', 'false')""")
def c14(spark, d):
    return FM.scalars(_t(spark, d, "documents"))


_ROUND = ("titulo", "idioma", "area", "autoria", "resumo", "obra")
_FLAT = ", ".join(f"""('{c}', case when {c} is null or lower({c}) in ('', 'null', '~') then 'null' else 'string' end, case when lower({c}) in ('', 'null', '~') then null else regexp_replace({c}, '[\\r\\n]+', ' ', 'g') end)""" for c in _ROUND)


@query("F10_written_and_read", f"""with n as (select distinct note_id, has_fm, tags, {", ".join(_ROUND)} from notes where note_id is not null)
select n.note_id, u.campo, u.kind, u.valor from n, lateral (values {_FLAT}, ('has_fm', case when has_fm is null then 'null' else 'bool' end, has_fm::varchar), ('tags', case when tags is null then 'null' else 'list' end, case when len(tags) = 0 then '' else list_aggregate(tags, 'string_agg', '; ') end)) u(campo, kind, valor)""")
def f10(spark, d):
    """The fields of the notes written as front matter and read back."""
    cols = [*_ROUND, "has_fm", "tags"]
    n = _t(spark, d, "notes").where("note_id is not null").select("note_id", *cols).distinct()
    return FM.flat(cut(n.select("note_id", F.concat(FM.written(n, cols), F.lit("text")).alias("corpo"))), "note_id", "corpo")


@query("C14_typed_fields", r"""with n as (select distinct note_id, has_fm, tags, titulo, resumo, idioma from notes where note_id is not null and titulo is not null and resumo is not null and tags is not null)
select note_id, u.* from n, lateral (values ('titulo', 'string', titulo), ('resumo', 'string', trim(regexp_replace(resumo, '\s+', ' ', 'g'))), ('aberto', 'bool', coalesce(has_fm, false)::varchar), ('vazio', 'null', null),
 ('tags', 'list', coalesce(list_aggregate(tags, 'string_agg', '; '), '')), ('areas', 'list', 'Civil; Penal'),
 ('idioma', case when trim(coalesce(idioma, '')) = '[]' then 'list' when lower(trim(coalesce(idioma, ''))) in ('', 'null') then 'null' else 'string' end, case when trim(idioma) = '[]' then '' when lower(trim(idioma)) in ('', 'null') then null else trim(idioma) end)) u(campo, kind, valor)""")
def c14b(spark, d):
    """Heads in every form a reader meets: repeated names, comments, folded blocks, lists over lines, bare lists, other cases."""
    n = _t(spark, d, "notes").where("note_id is not null and titulo is not null and resumo is not null and tags is not null").select("note_id", "has_fm", "tags", "titulo", "resumo", "idioma").distinct()
    items = F.array_join(F.transform("tags", lambda x: F.concat(F.lit('  "'), x, F.lit('"'))), ",\n")
    head = F.concat(
        F.lit("---\ntitulo: not this\n# resumo: nor this\ntags:\n  [\n"), items, F.lit("\n  ]\nresumo: >-\n  "), F.regexp_replace(F.regexp_replace("resumo", r"\s+", " "), " ", "\n\n  "),
        F.lit("\naberto: "), F.initcap(F.coalesce("has_fm", F.lit(False)).cast("string")), F.lit(" # yes or no\nareas: [ Civil , Penal,]\nno colon here\nvazio: ~\nidioma: "), F.coalesce("idioma", F.lit("")), F.lit("  # code\ntitulo: \""), F.col("titulo"), F.lit("\"\n---\ntext: x\n"),
    )
    return FM.flat(cut(n.select("note_id", head.alias("corpo"))), "note_id", "corpo")


_TOK = r"t as (select doc_id, word, count(*) n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) word from documents) group by all)"


_LANG = rf"""with {_TOK}, tot as (select doc_id, sum(n) total from t group by 1 having sum(n) >= 30),
df as (select lang, word, count(*) df from (select distinct lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) word from documents where lang is not null) group by all),
top as (select lang, word from (select *, row_number() over (partition by lang order by df desc, word) r from df) where r <= 40), lw as (select lang, word, (27720 // count(*) over (partition by word))::bigint w from top),
s as (select doc_id, lang, ((2000000 * sum(n * w)::bigint + 27720 * any_value(total)::bigint) // (2 * 27720 * any_value(total)::bigint))::bigint score from t join lw using (word) join tot using (doc_id) group by doc_id, lang),
r as (select *, row_number() over (partition by doc_id order by score desc, lang) r, coalesce(lead(score) over (partition by doc_id order by score desc, lang), 0) nx from s)"""


@query("C03_language", f"{_LANG} select doc_id, lang idioma, score / 1000000.0::double score, score - nx < 50000 ambiguous from r where r = 1")
def c03(spark, d):
    return L.detect(_t(spark, d, "documents"))


@query("O08_top_languages", f"{_LANG} select doc_id, r::bigint rk, lang idioma, score / 1000000.0::double score from r where r <= 3")
def o08(spark, d):
    return L.top(_t(spark, d, "documents"))


# ---------------------------------------------------------------- identifiers, relations, hubs


_RX = lambda p: p.replace("'", "''")


@query("C29_identifiers", "with r as (" + " union all ".join(f"select doc_id, '{label}' label, unnest(regexp_extract_all(text, '(?i){_RX(p)}', 1)) raw from documents" for label, p in dims.IDENTIFIERS) + r"), x as (select doc_id, label, regexp_replace(raw, '\D', '', 'g') num from r) select doc_id, label, num, count(*)::bigint n from x where num <> '' group by all")
def c29(spark, d):
    return K.extract(_t(spark, d, "documents").where("text is not null"), "doc_id", "text")


_WORK = rf"{notes('stem', 'parte', 'obra')}, wk as (select note_id, stem, coalesce(case when not {blank('parte')} then {link('obra')} end, stem) as work from n where stem is not null)"
_IDS = f"{_WORK}, mm as (select mention_id, max(note_id) note_id, max(label) label, max(num) num, max(n) n from mentions where mention_id is not null and label is not null and num is not null group by 1), ids as (select work, label, num, sum(mm.n)::bigint n from mm join wk using (note_id) group by all), df as (select label, num, count(*)::bigint df from ids group by all), tot as (select count(distinct work) as t from ids)"


def _ids(spark, d):
    return K.work_identifiers(_t(spark, d, "notes"), _t(spark, d, "mentions"))


@query("C35_A04_work_identifiers", f"with {_IDS} select work, label, num, n from ids")
def c35(spark, d):
    return _ids(spark, d)


@query("A03_document_frequency", f"with {_IDS} select label, num, df from df")
def a03(spark, d):
    return K.document_frequency(_ids(spark, d))


_REL = f"{_IDS}, wt as (select label, num, ln(t::double / df) w from df, tot where df >= 2 and df <= ceil(t / 2.0)), pr as (select a.work, b.work other, count(*)::bigint common, round(sum(w), 6) weight from ids a join ids b on a.label = b.label and a.num = b.num and a.work <> b.work join wt on wt.label = a.label and wt.num = a.num group by all having round(sum(w), 6) >= 2.0), rel as (select *, row_number() over (partition by work order by weight desc, other)::bigint rk from pr)"


@query("C36_relations", f"with {_REL} select work, other, common, weight, rk from rel where rk <= 8")
def c36(spark, d):
    return K.relations(cut(_ids(spark, d)))


@query("O02_proofs", f"with {_REL}, x as (select r.work, r.other, a.label, a.num, df.df, row_number() over (partition by r.work, r.other order by df.df, a.label, a.num)::bigint rk from rel r join ids a on a.work = r.work join ids b on b.work = r.other and b.label = a.label and b.num = a.num join df on df.label = a.label and df.num = a.num where r.rk <= 8) select * from x where rk <= 5")
def o02(spark, d):
    ids = cut(_ids(spark, d))
    return K.proofs(ids, cut(K.relations(ids)))


_NOT = dims.sql_values(dims.NOTABLE, "label", "num")
_HUB = f"{_IDS}, nt as (select label, num, true notable from {_NOT}), hb as (select df.label, df.num, df, coalesce(notable, false) notable from df cross join tot left join nt on nt.label = df.label and nt.num = df.num where notable or df >= greatest(4, ceil(0.10 * greatest(1, t))))"


@query("C37_hubs", f"with {_HUB} select * from hb")
def c37(spark, d):
    return K.hubs(_ids(spark, d))


@query("O05_hub_works", f"with {_HUB} select i.label, i.num, i.work, i.n, row_number() over (partition by i.label, i.num order by i.n desc, i.work)::bigint rk from ids i join hb using (label, num)")
def o05(spark, d):
    ids = cut(_ids(spark, d))
    return K.hub_works(ids, K.hubs(ids))


@query("O03_densest_slices", f"with {_HUB}, x as (select m.label, m.num, wk.work, wk.stem, sum(m.n)::bigint n from mm m join hb using (label, num) join wk using (note_id) where wk.stem <> wk.work group by all having sum(m.n) > 0), y as (select *, row_number() over (partition by label, num, work order by n desc, stem)::bigint rk from x) select * from y where rk <= 3")
def o03(spark, d):
    ids = cut(_ids(spark, d))
    return K.densest_slices(_t(spark, d, "notes"), _t(spark, d, "mentions"), K.hubs(ids))


@query("O04_distinctive", f"with {_IDS}, x as (select i.work, i.label, i.num, df.df, i.n, row_number() over (partition by i.work order by df.df, i.n desc, i.label, i.num)::bigint rk from ids i join df using (label, num)) select * from x where rk <= 10")
def o04(spark, d):
    return K.distinctive(cut(_ids(spark, d)))


@query("A05_shared_count", f"with {_IDS} select count(*) filter (where df >= 2)::bigint shared, count(*)::bigint total from df")
def a05(spark, d):
    return K.document_frequency(_ids(spark, d)).agg(F.count_if(F.col("df") >= 2).alias("shared"), F.count(F.lit(1)).alias("total"))


def findings(spark, d):
    """(finding, label, num): the identifier each hub note names; finding is its note_id."""
    hub = N.once(_t(spark, d, "notes"), "hub_id").where(~is_blank(F.col("hub_id")))
    return hub.select(F.col("note_id").alias("finding"), F.split_part("hub_id", F.lit("-"), F.lit(1)).alias("label"), F.regexp_replace(F.regexp_replace("hub_id", "^[^-]*-", ""), "[^0-9]", "").alias("num"))


@query("C30_J07_affected", f"with {notes('hub_id')}, f as (select distinct note_id::varchar finding, split_part(hub_id, '-', 1) label, regexp_replace(substr(hub_id, instr(hub_id, '-') + 1), '[^0-9]', '', 'g') num from n where not {blank('hub_id')}), m as (select distinct note_id, label, num from mentions where note_id is not null) select finding, note_id, count(*)::bigint common from f join m using (label, num) group by all")
def c30(spark, d):
    return K.affected(findings(spark, d).withColumn("finding", F.col("finding").cast("string")), _t(spark, d, "mentions").where("note_id is not null"))


_PARTS = rf"{notes('stem', 'parte', 'obra', 'pagina_inicio', 'pagina_fim')}, s as (select note_id, {link('obra')} as work, try_cast(trim(parte) as bigint) parte, try_cast(pagina_inicio as bigint) a, try_cast(pagina_fim as bigint) z from n where not {blank('parte')}), p as (select * from s where work is not null and parte is not null)"


def _parts(spark, d):
    from tabularium.functions.text import link_stem, squeeze

    n = N.once(_t(spark, d, "notes"), "stem", "parte", "obra", "pagina_inicio", "pagina_fim").where(~is_blank(F.col("parte")))
    num = lambda c: F.when(F.col(c).rlike("^[0-9]{1,9}$"), F.col(c).try_cast("bigint"))
    return n.select("note_id", link_stem(F.col("obra")).alias("work"), squeeze(F.col("parte")).try_cast("bigint").alias("parte"), num("pagina_inicio").alias("a"), num("pagina_fim").alias("z")).where("work is not null and parte is not null")


@query("W03_slice_gaps", f"with {_PARTS} select work, min(parte) as first, max(parte) as last, (max(parte) - min(parte) + 1 - count(distinct parte))::bigint missing from p group by work having max(parte) - min(parte) + 1 > count(distinct parte)")
def w03s(spark, d):
    return A.gaps(_parts(spark, d).withColumnRenamed("parte", "n"), "work")


@query("J08_shared_pairs", f"with {_IDS} select a.work, b.work other, count(*)::bigint common from ids a join ids b on a.label = b.label and a.num = b.num and a.work < b.work join df on df.label = a.label and df.num = a.num cross join tot where df.df between 2 and ceil(t / 2.0) group by all")
def j08(spark, d):
    ids = cut(_ids(spark, d))
    w = K._weighted(ids).select("label", "num")
    one = ids.select("work", "label", "num").join(w, ["label", "num"])
    return K.shared(one)


@query("F11_identifier_text", r"with m as (select distinct label, num from mentions where label is not null and num is not null) select label, num, label || ' ' || case when label = 'processo' or length(num) <= 3 then num else ltrim(reverse(regexp_replace(reverse(num), '(\d{3})', '\1.', 'g')), '.') end shown from m")
def f11(spark, d):
    m = _t(spark, d, "mentions").where("label is not null and num is not null").select("label", "num").distinct()
    return m.select("label", "num", K.label_text(F.col("label"), F.col("num")).alias("shown"))


@query("A20_commonest_area", f"with {notes('area', 'autoria')}, g as (select autoria, area, count(*) c from n where not {blank('area')} and not {blank('autoria')} group by all) select autoria, arg_min(area, (-c, area)) area, max(c)::bigint n from g group by autoria")
def a20(spark, d):
    n = N.once(_t(spark, d, "notes"), "area", "autoria").where(~is_blank(F.col("area")) & ~is_blank(F.col("autoria")))
    g = n.groupBy("autoria", "area").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("autoria").agg(F.min_by("area", F.struct((-F.col("c")).alias("r"), "area")).alias("area"), F.max("c").alias("n"))


@query("U04_distinct_in_order", "with v as (select note_id, tag, min(i) i from (select note_id, unnest(tags) tag, generate_subscripts(tags, 1) i from (select distinct note_id, tags from notes where note_id is not null)) where tag is not null group by all) select note_id, string_agg(tag, '; ' order by i) tags from v group by note_id")
def u04(spark, d):
    n = _t(spark, d, "notes").where("note_id is not null").select("note_id", "tags").distinct()
    return n.where("size(tags) > 0").select("note_id", F.array_join(F.array_distinct("tags"), "; ").alias("tags"))


@query("U05_clean_layer", f"with {notes('stem', 'parte')} select stem as name, case when {blank('parte')} then 'whole' else 'slice' end layer from n where stem is not null union all select stem, 'master' from (select distinct master_id, stem from masters where master_id is not null) where stem is not null")
def u05(spark, d):
    n = N.once(_t(spark, d, "notes"), "stem", "parte").where("stem is not null").select(F.col("stem").alias("name"), F.when(is_blank(F.col("parte")), "whole").otherwise("slice").alias("layer"))
    m = _t(spark, d, "masters").where("master_id is not null").select("master_id", "stem").distinct().where("stem is not null")
    return n.unionByName(m.select(F.col("stem").alias("name"), F.lit("master").alias("layer")))


@query("O06_catalogue_order", f"with {notes('stem', 'titulo', 'parte')}, x as (select stem, coalesce(nullif(trim(titulo), ''), stem) alias from n where {blank('parte')} and stem is not null) select stem, alias, row_number() over (order by lower(alias), stem)::bigint pos from x")
def o06(spark, d):
    n = N.once(_t(spark, d, "notes"), "stem", "titulo", "parte").where(is_blank(F.col("parte")) & F.col("stem").isNotNull())
    x = n.select("stem", F.coalesce(F.nullif(F.trim("titulo"), F.lit("")), F.col("stem")).alias("alias"))
    # positions without a single-task window: a range sort, then offsets per partition
    s = cut(x.withColumn("k", F.lower("alias")).repartitionByRange("k", "stem").sortWithinPartitions("k", "stem").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    first = s.groupBy("p").agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("c"))
    start = first.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(start), "p").select("stem", "alias", (F.col("i") - F.col("i0") + 1 + F.col("before")).alias("pos"))


# ---------------------------------------------------------------- panels, sets, sources, streams

_BOARD = f"{notes('stem', 'tipo', 'status', 'confiabilidade', 'autoria', 'ano', 'mtime', 'parte')}, b as (select * from n where {blank('parte')})"


def _board(spark, d):
    return P.board(_t(spark, d, "notes"))


@query("Q1_ready", f"with {_BOARD} select note_id, stem, tipo, autoria, ano from b where status = 'Vigente'")
def q1(spark, d):
    return P.ready(_board(spark, d))


@query("Q2_pending", f"with {_BOARD} select note_id, stem, status, confiabilidade, ano from b where status = 'A-conferir' or confiabilidade = 'A-conferir'")
def q2(spark, d):
    return P.pending(_board(spark, d))


@query("Q3_superseded", f"with {_BOARD} select note_id, stem, status, ano from b where status in {_in(dims.STATUS_OLD)}")
def q3(spark, d):
    return P.superseded(_board(spark, d))


for _i, (_g, _ks) in enumerate(dims.KIND_GROUPS, 4):
    query(f"Q{_i}_{_g}", f"with {_BOARD} select note_id, stem, autoria, ano, status from b where tipo in {_in(_ks)}")(lambda spark, d, g=_g: P.by_group(_board(spark, d), g))


@query("Q7_recent", f"with {_BOARD} select note_id, stem, tipo, strftime(mtime, '%Y-%m-%d %H:%M:%S') mtime from b where mtime >= date '{TODAY}' - interval 30 day")
def q7(spark, d):
    return P.recent(_board(spark, d), TODAY).withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"))


@query("Q8_health", f"with {_BOARD} select status, count(*)::bigint n from b group by status")
def q8(spark, d):
    return P.health(_board(spark, d))


@query("Q9_panel_text", f"with {_BOARD} select stem as nota, status, ano from b where tipo in ('Doutrina', 'Artigo') and (status = 'Vigente' or confiabilidade = 'Oficial')")
def q9(spark, d):
    return P.run('TABLE WITHOUT ID file.link AS "nota", status AS "status", ano AS "ano" FROM -"99-Templates" WHERE (tipo = "Doutrina" OR tipo = "Artigo") AND (status = "Vigente" OR confiabilidade = "Oficial") AND !parte', N.once(_t(spark, d, "notes"), *P.COLUMNS, "path"), TODAY)


@query("equal_texts", "select md5(text) digest, count(*)::bigint n, min(doc_id) first_doc from documents where text is not null and trim(text) <> '' group by 1 having count(*) > 1")
def s14(spark, d):
    t = _t(spark, d, "documents").where("text is not null and trim(text) != ''")
    return t.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("U02_missing_and_extra", "select 'only in notes' side, titulo from (select distinct titulo from notes where titulo is not null except select titulo from masters) union all select 'only in masters', titulo from (select distinct titulo from masters where titulo is not null except select titulo from notes)")
def u02(spark, d):
    a = _t(spark, d, "notes").select("titulo").where("titulo is not null").distinct()
    b = _t(spark, d, "masters").select("titulo").where("titulo is not null").distinct()
    return a.join(b, "titulo", "left_anti").select(F.lit("only in notes").alias("side"), "titulo").unionByName(b.join(a, "titulo", "left_anti").select(F.lit("only in masters").alias("side"), "titulo"))


@query("ST_tumbling", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*)::bigint n, round(sum(value), 4) total from events where ts is not null group by all")
def st1(spark, d):
    return W.tumbling(_t(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("ST_sliding", "select strftime(s, '%Y-%m-%d %H:%M:%S') as start, count(*)::bigint n from (select unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour]) s from events where ts is not null) group by all")
def st2(spark, d):
    return W.sliding(_t(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("ST_sessions", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b from events where ts is not null), y as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) s from x) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*)::bigint n from y group by user_id, s")
def st3(spark, d):
    return W.sessions(_t(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = dict(Q)
