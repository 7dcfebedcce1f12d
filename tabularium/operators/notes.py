"""Notes of the vault: one row each, their roles, and column functions over their names and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions import dims
from tabularium.functions.text import is_blank, link_stem, squeeze

IGNORED_FOLDERS = ("99-Templates", "Radar", ".obsidian", ".trash")
NAME = r"^([A-ZÀ-Ü]+)_([A-ZÀ-Ü]+)_([0-9]{4})_([^_]+)_([^_]+?)(_INDICE|_p[0-9]+)?$"
# Accented letters of the closed Latin set, and their plain ones.
ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"


def once(notes: DataFrame, *cols: str) -> DataFrame:
    """One row per note_id with the columns asked for: the last delivery, whole. Null ids are left out.

    Deliveries of one time (or of none, where the table doesn't keep it) are
    told apart by the columns themselves, the greatest first.
    """
    rows = notes.where("note_id is not null")
    if "ingested_at" in notes.columns:
        last = F.max(F.struct(F.col("ingested_at").alias("__at"), *cols))
    else:
        last = F.max(F.struct(*cols))
    return rows.groupBy("note_id").agg(last.alias("__n")).select("note_id", *[F.col(f"__n.{c}").alias(c) for c in cols])


def plain(c: Column) -> Column:
    """Accents taken off the letters of the closed Latin set (JVM side)."""
    return F.translate(c, ACCENTED, PLAIN)


def roles(notes: DataFrame) -> DataFrame:
    """(note_id, is_slice, is_index, is_hub): a slice has a number and a work, an index counts slices or is named so."""
    n = once(notes, "stem", "parte", "obra", "partes", "hub_id")
    return n.select(
        "note_id",
        (~is_blank(F.col("parte")) & ~is_blank(F.col("obra"))).alias("is_slice"),
        (F.coalesce(F.upper("stem").contains("_INDICE"), F.lit(False)) | ~is_blank(F.col("partes"))).alias("is_index"),
        (~is_blank(F.col("hub_id"))).alias("is_hub"),
    )


def visible(notes: DataFrame, folders: tuple[str, ...] = IGNORED_FOLDERS) -> DataFrame:
    """Notes that a scan keeps: no ignored folder in the relative path, no report or underscore name."""
    n = once(notes, "path", "file_name")
    parts = F.split("path", "/")
    return n.where(~F.arrays_overlap(parts, F.array(*[F.lit(f) for f in folders])) & ~F.col("file_name").rlike("^(RELATORIO|_)")).select("note_id", "path")


def outside_vocabulary(notes: DataFrame, vocabulary: DataFrame, *fields: str) -> DataFrame:
    """(campo, valor, n): values of single-valued fields that are no entry of their list."""
    n = once(notes, *fields)
    long = n.select("note_id", F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("valor")) for f in fields])).alias("x")).select("note_id", "x.*").where(~is_blank(F.col("valor")))
    listed = vocabulary.select("campo", F.col("canonico").alias("valor"))
    return long.join(F.broadcast(listed), ["campo", "valor"], "left_anti").groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("n"))


def incoherent_pairs(notes: DataFrame) -> DataFrame:
    """(note_id, tipo, tipo_fonte): a kind that its source type can't carry; a missing side is no fault, an unknown source type is."""
    n = once(notes, "tipo", "tipo_fonte").where(~is_blank(F.col("tipo")) & ~is_blank(F.col("tipo_fonte")))
    return n.join(F.broadcast(dims.kinds_by_source(notes.sparkSession)), ["tipo_fonte", "tipo"], "left_anti").select("note_id", "tipo", "tipo_fonte")


def derived_kind(notes: DataFrame) -> DataFrame:
    """(note_id, tipo): the kind of notes without one whose source type carries exactly one."""
    one = dims.kinds_by_source(notes.sparkSession).groupBy("tipo_fonte").agg(F.count(F.lit(1)).alias("c"), F.max("tipo").alias("derived")).where("c = 1")
    return once(notes, "tipo", "tipo_fonte").where(is_blank(F.col("tipo"))).join(F.broadcast(one), "tipo_fonte").select("note_id", F.col("derived").alias("tipo"))


def name_parts(notes: DataFrame) -> DataFrame:
    """(note_id, area, tipo, ano, titulo, autor, sufixo, known_area, known_kind): the file name read by its grammar."""
    n = once(notes, "stem").where(F.col("stem").rlike(NAME))
    part = lambda i: F.regexp_extract("stem", NAME, i)
    areas, kinds = [c for _, c in dims.AREA_CODES], [c for _, c in dims.KINDS]
    return n.select(
        "note_id", part(1).alias("area"), part(2).alias("tipo"), part(3).alias("ano"), part(4).alias("titulo"), part(5).alias("autor"), part(6).alias("sufixo"),
        part(1).isin(areas).alias("known_area"), part(2).isin(kinds).alias("known_kind"),
    )


def off_grammar(notes: DataFrame) -> DataFrame:
    """(note_id, stem): notes whose name doesn't follow the grammar; slices aren't judged again."""
    return once(notes, "stem").where(~F.col("stem").rlike(NAME) & ~F.col("stem").rlike("(?i)_p[0-9]+$"))


def slug(c: Column) -> Column:
    """Lower case, no accents, runs of other characters as one hyphen, none at the ends; ``/`` stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(plain(c)), "[^a-z0-9/]+", "-"), "^-+|-+$", "")


def prefix(c: Column) -> Column:
    """File-name prefix: other characters than letters, digits, _ and - as one hyphen, cut to 60, none at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_\-]+", "-"), 1, 60), "^-+|-+$", "")


def name_key(c: Column) -> Column:
    """Key by which a text finds its scan: accents off, lower case, ``_ocr`` dropped, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(plain(c)), r"_ocr\b", ""), "[^a-z0-9]", "")


def surname(c: Column) -> Column:
    """Family name of an author in inverted form, in capitals."""
    return F.upper(squeeze(F.split_part(c, F.lit(","), F.lit(1))))


def areas_by_key(notes: DataFrame) -> DataFrame:
    """(note_id, area): areas whose key is part of the typed text, each once; keys are tried on every distinct text only once."""
    n = once(notes, "area").where(~is_blank(F.col("area")))
    keys = [(k, a) for k, a in dims.AREA_KEYS]
    typed = n.select("area").distinct().withColumn("p", F.lower(plain(F.col("area"))))
    hit = F.array_distinct(F.filter(F.array(*[F.when(F.contains("p", F.lit(k)), F.lit(a)) for k, a in keys]), lambda x: x.isNotNull()))
    return n.join(typed.select("area", F.explode(hit).alias("found")), "area").select("note_id", F.col("found").alias("area"))


def to_roman(n: Column) -> Column:
    """Small roman numeral of a positive whole number."""
    table = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    out, left = F.lit(""), n
    for v, s in table:
        out, left = F.concat(out, F.repeat(F.lit(s), F.floor(left / v).cast("int"))), left % v
    return out


def link_targets(rows: DataFrame) -> DataFrame:
    """(note_id, target): stems named by links in each row's text, placeholders in « » left out; repeated rows repeat."""
    found = F.explode(F.regexp_extract_all("corpo", F.lit(r"(\[\[[^\]]*\]\])"), F.lit(1)))
    return rows.where("note_id is not null and corpo is not null").select("note_id", found.alias("l")).select("note_id", link_stem(F.col("l")).alias("target")).where("target is not null and target not like '«%'")


def body_links(notes: DataFrame) -> DataFrame:
    """(note_id, target): one row a link; a note delivered twice counts once."""
    return link_targets(once(notes, "corpo"))


def broken_links(notes: DataFrame) -> DataFrame:
    """(note_id, target): links to stems that no note has. Texts aren't shuffled, only their distinct links."""
    stems = notes.select(F.col("stem").alias("target")).where("target is not null").distinct()
    return link_targets(notes).distinct().join(stems, "target", "left_anti").select("note_id", "target")


def duplicate_stems(notes: DataFrame) -> DataFrame:
    """(stem_key, n): stems of more than one note, whatever their case."""
    return once(notes, "stem").groupBy(F.lower("stem").alias("stem_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and stem_key is not null")


def slice_counts(notes: DataFrame) -> DataFrame:
    """(note_id, declared, actual): indexes whose stated number of slices isn't the number that link to them; 0 counts too."""
    n = once(notes, "stem", "partes", "parte", "obra")
    declared = n.where(squeeze(F.col("partes")).rlike("^[0-9]{1,9}$")).select("note_id", "stem", squeeze(F.col("partes")).cast("bigint").alias("declared"))
    links = n.where(~is_blank(F.col("parte"))).select(link_stem(F.col("obra")).alias("stem")).where("stem is not null").groupBy("stem").agg(F.count(F.lit(1)).alias("c"))
    return declared.join(links, "stem", "left").select("note_id", "declared", F.coalesce("c", F.lit(0)).alias("actual")).where("declared != actual")


def orphans(notes: DataFrame) -> DataFrame:
    """(note_id, target): slices whose index no note is."""
    n = once(notes, "stem", "parte", "obra")
    stems = n.select(F.col("stem").alias("target")).where("target is not null").distinct()
    return n.where(~is_blank(F.col("parte"))).select("note_id", link_stem(F.col("obra")).alias("target")).where("target is not null").join(stems, "target", "left_anti").select("note_id", "target")
