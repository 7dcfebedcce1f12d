"""Checks over the whole graph of notes, works put together from pages and slices, and lookups between layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import dims
from tabularium.functions.text import is_blank, link_stem, squeeze
from tabularium.operators import notes as N
from tabularium.operators.anchors import lines, page_of_lines
from tabularium.sources.tables import cut


def findings(notes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(note_id, severity, code): what is wrong in the graph of notes, one row a note and fault.

    Errors: metadata absent, name borne by several notes, slice without link,
    orphan, slice count, kind or status outside the list, no area, pair of kind
    and source. Warnings: count that is no number, trust outside the list, name
    off the grammar, unknown code of area or kind in it (slices aren't judged),
    broken link.
    """
    fields = ("has_fm", "stem", "tipo", "tipo_fonte", "status", "area", "parte", "obra", "partes", "confiabilidade")
    n = cut(N.once(notes, *fields))  # one pass over the notes; all checks but that of links read this
    listed = lambda field: F.broadcast(vocabulary.where(F.col("campo") == field).select(F.col("canonico").alias(field), F.lit(True).alias(f"{field}_ok")).distinct())
    pair = F.broadcast(dims.kinds_by_source(notes.sparkSession).withColumn("pair_ok", F.lit(True)))
    j = n.join(listed("tipo"), "tipo", "left").join(listed("status"), "status", "left").join(pair, ["tipo_fonte", "tipo"], "left")
    area, code = F.regexp_extract("stem", N.NAME, 1), F.regexp_extract("stem", N.NAME, 2)
    judged = F.col("stem").rlike(N.NAME) & ~F.col("stem").rlike("(?i)_p[0-9]+$")
    part, b = ~is_blank(F.col("parte")), lambda c: is_blank(F.col(c))
    row = lambda severity, code, cond: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    faults = F.array(
        row("error", "no_metadata", ~F.coalesce("has_fm", F.lit(False))),
        row("error", "slice_without_link", part & b("obra")),
        row("error", "kind", ~b("tipo") & F.col("tipo_ok").isNull()),
        row("error", "status", ~b("status") & F.col("status_ok").isNull()),
        row("error", "no_area", ~part & b("area")),
        row("error", "pair", ~b("tipo") & ~b("tipo_fonte") & F.col("pair_ok").isNull()),
        row("warning", "count_not_a_number", ~b("partes") & ~squeeze(F.col("partes")).rlike("^[0-9]{1,9}$")),
        row("warning", "trust", ~b("confiabilidade") & ~F.col("confiabilidade").isin(*dims.TRUST)),
        row("warning", "area_code", judged & ~area.isin(*[c for _, c in dims.AREA_CODES])),
        row("warning", "kind_code", judged & ~code.isin(*[c for _, c in dims.KINDS])),
        row("warning", "name", ~F.col("stem").rlike(N.NAME) & ~F.col("stem").rlike("(?i)_p[0-9]+$")),
    )
    alone = j.select("note_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("f")).select("note_id", "f.severity", "f.code")
    tag = lambda df, severity, code: df.select("note_id", F.lit(severity).alias("severity"), F.lit(code).alias("code")).distinct()
    several = n.where("stem is not null").groupBy("stem").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("stem")
    return alone.unionByName(tag(n.join(several, "stem"), "error", "duplicate_name")).unionByName(tag(N.orphans(n), "error", "orphan")).unionByName(tag(N.slice_counts(n), "error", "slice_count")).unionByName(tag(N.broken_links(notes), "warning", "broken_link"))


def families(found: DataFrame, top: int = 6) -> DataFrame:
    """(code, n, rk): the commonest faults."""
    g = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rk", F.row_number().over(Window.orderBy(F.col("n").desc(), "code")).cast("long")).where(F.col("rk") <= top)


def worst(notes: DataFrame, found: DataFrame) -> DataFrame:
    """(worst, n): notes by the worst severity found in them."""
    per = found.groupBy("note_id").agg(F.max(F.when(F.col("severity") == "error", 2).otherwise(1)).alias("s"))
    j = N.once(notes, "stem").join(per, "note_id", "left")
    return j.select(F.when(F.col("s") == 2, "error").when(F.col("s") == 1, "warning").otherwise("none").alias("worst")).groupBy("worst").agg(F.count(F.lit(1)).alias("n"))


def required_blanks(notes: DataFrame) -> DataFrame:
    """(tipo_fonte, campo, n): fields a source type must have and notes leave blank; slices aren't judged."""
    fields = list(dict.fromkeys(f for _, f in dims.REQUIRED))
    n = N.once(notes, "tipo_fonte", "parte", *fields).where(is_blank(F.col("parte")))
    long = n.select("tipo_fonte", F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), is_blank(F.col(f)).alias("b")) for f in fields])).alias("x")).select("tipo_fonte", "x.*").where("b")
    need = F.broadcast(dims.rows(notes.sparkSession, dims.REQUIRED, "tipo_fonte string, campo string"))
    return long.join(need, ["tipo_fonte", "campo"]).groupBy("tipo_fonte", "campo").agg(F.count(F.lit(1)).alias("n"))


def pages(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, page, first_line, n_lines, text): the text of each page, its lines in order."""
    p = page_of_lines(texts, key, text).join(lines(texts, key, text), [key, "line_no"])
    return p.groupBy(key, "page").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")
    )


def assemble(pages: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, texto): pages put together again, each behind its anchor, parted by blank lines."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("first_line", "page", "text"))), lambda x: F.concat(F.lit("{{p."), x["page"], F.lit("}}\n\n"), x["text"]))
    return pages.groupBy(key).agg(F.array_join(one, "\n\n").alias("texto"))


def basic(c: Column) -> Column:
    """Plain mending of extracted text: cut words joined whatever their case, spaces at line ends and surplus blank lines taken out."""
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def text_layer(pages: DataFrame, key: str = "master_id", images: DataFrame | None = None, least: int = 10, full: int = 300) -> DataFrame:
    """(key, n_pages, n_empty, searchable): pages with fewer than ``least`` other characters than white space count as empty.

    So do those with fewer than ``full`` that are in images(key, page), the pages with a big image.
    """
    size = F.length(F.regexp_replace("text", r"\s", ""))
    if images is None:
        pages = pages.withColumn("big", F.lit(False))
    else:
        pages = pages.join(images.select(key, "page", F.lit(True).alias("big")).distinct(), [key, "page"], "left")
    empty = (size < least) | (F.coalesce("big", F.lit(False)) & (size < full))
    g = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(empty).alias("n_empty"))
    return g.withColumn("searchable", F.col("n_empty") < 1)


def slice_index(notes: DataFrame) -> DataFrame:
    """(work, n, first_page, last_page, slices): the index text of each work, its slices in order."""
    n = N.once(notes, "stem", "parte", "obra", "pagina_inicio", "pagina_fim").where(~is_blank(F.col("parte")))
    page = lambda c: F.when(F.col(c).rlike("^[0-9]{1,9}$"), F.col(c).try_cast("bigint"))
    s = n.select(link_stem(F.col("obra")).alias("work"), squeeze(F.col("parte")).try_cast("bigint").alias("parte"), "stem", page("pagina_inicio").alias("a"), page("pagina_fim").alias("z")).where("work is not null and parte is not null")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parte", "stem"))), lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]]"))), "\n")
    return s.groupBy("work").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first_page"), F.max("z").alias("last_page"), names.alias("slices"))


def slice_titles(texts: DataFrame, target: int, key: str = "master_id") -> DataFrame:
    """(key, parte, titulo): the first title in each slice, 70 characters at most, else its number in words."""
    from tabularium.operators.slices import blocks, slice_numbers

    b = blocks(texts, key)
    heads = lines(texts, key).where(F.col("line").rlike(r"^#{1,4}\s+\S")).select(key, F.col("line_no").alias("first_line"), F.rtrim(F.regexp_extract("line", r"^#{1,4}\s+(.*)$", 1)).alias("head"))
    j = b.join(slice_numbers(b, target, key), [key, "block"]).join(heads, [key, "first_line"], "left")
    first = j.groupBy(key, "parte").agg(F.min_by("head", F.when(F.col("head").isNotNull(), F.col("first_line"))).alias("head"))
    return first.select(key, "parte", F.coalesce(F.left("head", F.lit(70)), F.format_string("Parte %02d", "parte")).alias("titulo"))


def catalogue(notes: DataFrame, distinctive: DataFrame) -> DataFrame:
    """(work, alias, n_ids, ids): each work with its title and its most distinctive identifiers in order."""
    ids = distinctive.groupBy("work").agg(F.count(F.lit(1)).alias("n_ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "label", "num"))), lambda x: F.concat(x["label"], F.lit(" "), x["num"])), "; ").alias("ids"))
    head = notes.where("stem is not null").groupBy(F.col("stem").alias("work")).agg(F.max("titulo").alias("titulo"))
    return ids.join(head, "work", "left").select("work", F.coalesce(F.nullif(F.trim("titulo"), F.lit("")), F.col("work")).alias("alias"), "n_ids", "ids")


def sources_of(notes: DataFrame, masters: DataFrame) -> DataFrame:
    """(note_id, master_id): the work a note was made from, by the key of its title; of several the first by (age, id)."""
    n = N.once(notes, "titulo").where("titulo is not null").select("note_id", N.name_key(F.col("titulo")).alias("k")).where("k != ''")
    m = masters.where("master_id is not null and titulo is not null").groupBy("master_id").agg(F.max("titulo").alias("titulo"), F.max("converted_at").alias("at"))
    m = m.select("master_id", "at", N.name_key(F.col("titulo")).alias("k")).groupBy("k").agg(F.min_by("master_id", F.struct("at", "master_id")).alias("master_id"))
    return n.join(m, "k").select("note_id", "master_id")


def dangling_hubs(notes: DataFrame, hub: DataFrame) -> DataFrame:
    """(hub_id, n): hubs that notes name and that aren't elected."""
    named = N.once(notes, "hub_id").where(~is_blank(F.col("hub_id"))).groupBy("hub_id").agg(F.count(F.lit(1)).alias("n"))
    return named.join(F.broadcast(hub.select(F.concat_ws("-", "label", "num").alias("hub_id"))), "hub_id", "left_anti")


def author_year_letters(notes: DataFrame) -> DataFrame:
    """(note_id, citation): works of one author and year told apart by letters, in order of their titles."""
    n = N.once(notes, "autoria", "ano", "titulo", "parte").where(is_blank(F.col("parte")) & ~is_blank(F.col("autoria")) & F.col("ano").rlike("^[0-9]{4}$"))
    who = N.surname(F.col("autoria"))
    w = Window.partitionBy("who", "ano")
    x = n.select("note_id", "ano", "titulo", who.alias("who")).withColumn("c", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("titulo", "note_id")))
    letter = F.when(F.col("c") > 1, F.concat(F.repeat(F.lit("z"), F.floor((F.col("i") - 1) / 26).cast("int")), F.char(F.lit(97) + (F.col("i") - 1) % 26))).otherwise("")
    return x.select("note_id", F.concat("who", F.lit(", "), "ano", letter).alias("citation"))


def short_authors(values: DataFrame) -> DataFrame:
    """values(note_id, pos, valor) -> (note_id, autores): up to three names, else the first and "et al."."""
    g = values.groupBy("note_id").agg(F.array_sort(F.collect_set(F.struct("pos", "valor"))).alias("v"))
    v = F.transform("v", lambda x: x["valor"])
    return g.select("note_id", F.when(F.size("v") > 3, F.concat(v[0], F.lit(" et al."))).otherwise(F.array_join(v, "; ")).alias("autores"))


def sources_listing(listing: DataFrame) -> DataFrame:
    """listing(folder, name) -> the PDFs that are sources: a copy that bears ``_OCR`` is one only where its original is gone."""
    pdf = listing.where(F.col("name").rlike(r"(?i)\.pdf$")).select("folder", "name").distinct()
    stem = F.regexp_replace("name", r"(?i)\.pdf$", "")
    copies = pdf.where(stem.endswith("_OCR"))
    original = F.concat(F.regexp_replace(stem, "_OCR$", ""), F.regexp_extract("name", r"(?i)(\.pdf)$", 1))
    there = pdf.select("folder", F.col("name").alias("original"))
    kept = copies.withColumn("original", original).join(there, ["folder", "original"], "left_anti").select("folder", "name")
    return pdf.where(~stem.endswith("_OCR")).unionByName(kept)


def first_of_each(sources: DataFrame) -> DataFrame:
    """sources(ord, path, kind) -> the list without malformed and repeated paths, a closing slash taken off, first place kept."""
    s = sources.withColumn("path", F.regexp_replace(F.trim("path"), "(?<=.)/+$", "")).where("path is not null and path != ''")
    w = Window.partitionBy("path").orderBy("ord")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select("ord", "path", F.coalesce("kind", F.when(F.lower("path").endswith(".pdf"), "file").otherwise("folder")).alias("kind"))


def collisions(names: DataFrame) -> DataFrame:
    """names(layer, name, id) -> (name_key, n, layers, first_id): names that several files bear, whatever their case."""
    g = names.groupBy(F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("layer").alias("layers"), F.min("id").alias("first_id"))
    return g.where("n > 1")


def compared(origin: DataFrame, copy: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, state): 'absent' where the copy has no such row, 'equal' or 'changed' by the digest of the texts; one row a key on both sides."""
    a = origin.where(F.col(key).isNotNull()).select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("a"))
    b = copy.where(F.col(key).isNotNull()).select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("b"))
    return a.join(b, key, "left").select(key, F.when(F.col("b").isNull(), "absent").when(F.col("a") == F.col("b"), "equal").otherwise("changed").alias("state"))
