"""Subjects of each document, by spreading trusted labels over a graph of shared phrases.

Two documents are neighbours if they share phrases that tell subjects apart. The
graph is kept in its factored form, documents - phrases (hashed word pairs of a
sentence), and is never multiplied out into pairs of documents. An edge counts
only if its phrase is *verified*: among the documents whose subject is known
where it stands it keeps to one subject. Each round

1. takes the subject known for each sentence (at first: all labels of its
   document) and counts documents per phrase and subject,
2. keeps the phrases that keep to one subject,
3. gives each sentence the subject most of its verified phrases point to.

Rounds end when hardly any verified phrase changes. Hand labels are clamped in
every round: a sentence of a labelled document counts for what its phrases say
only if that is among the document's labels, else for the labels. In the result
a labelled document keeps its labels whatever its neighbours say, unless its
own text speaks of other subjects only (then the label isn't trusted). Several
subjects per document are kept; one that holds a single sentence beside a
larger one is a passing mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.sources.tables import balanced, cut

ROUNDS = 8  # at most; they end
CHANGE = 0.02  # when so small a share of the verified phrases is new or gone
FIRST_PURITY, FIRST_SUPPORT = 0.6, 2  # with labels of whole documents; purity is c / (n + 1)
PURITY, SUPPORT = 0.7, 4  # with subjects of sentences; support counts documents
LEAST_SHARE = 0.25  # of the sentences of the largest subject, for a further one
LEAST_SENTENCES = 2
BROADCAST_PHRASES = 400_000  # verified phrases up to which they are broadcast (some 20 MB); beyond, a shuffle join
_BREAK = r"(?<=[.!?;:])\s+|[\r\n]+"


def sentences(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sents): of each document its sentences of two words or more, as (sent, grams) with their hashed word pairs.

    Null, empty and blank texts give no row; texts of one doc_id give a row each.
    """
    rows = balanced(documents.select("doc_id", F.lower(F.translate(F.col(text).cast("string"), "​﻿­", "")).alias("t")).where("doc_id is not null and t is not null"))
    words = F.transform(F.split("t", _BREAK), lambda x, i: F.struct(i.alias("sent"), F.regexp_extract_all(x, F.lit(r"\p{L}+"), F.lit(0)).alias("w")))
    rows = rows.select("doc_id", F.filter(words, lambda x: F.size(x["w"]) > 1).alias("x")).where("size(x) > 0")
    return rows.select("doc_id", F.expr("transform(x, s -> struct(s.sent as sent, array_distinct(transform(sequence(1, size(s.w) - 1), i -> xxhash64(s.w[i - 1], s.w[i]))) as grams))").alias("sents"))


def evidence(rows: DataFrame, own: str) -> DataFrame:
    """(doc_id, gram, subject): what each phrase of each document counts for, once a subject; -1 where nothing is known of it.

    ``own`` gives an array of subjects for a sentence ``s``, empty if none is known.
    """
    told = rows.select("doc_id", F.expr(f"transform(sents, s -> struct(s.grams as grams, {own} as own))").alias("x"))
    # phrases are made distinct as plain numbers, subject by subject: that is hashed, where structs would be compared in pairs
    told = told.select("doc_id", "x", F.expr("""
      transform(array_distinct(flatten(transform(x, s -> s.own))), o -> struct(o as subject,
        array_distinct(flatten(transform(filter(x, s -> array_contains(s.own, o)), s -> s.grams))) as grams))""").alias("k"))
    rest = F.expr("array(struct(-1 as subject, array_except(flatten(transform(filter(x, s -> size(s.own) = 0), s -> s.grams)), flatten(transform(k, e -> e.grams))) as grams))")
    each = told.select("doc_id", F.explode(F.concat("k", rest)).alias("e"))
    return each.select("doc_id", F.explode("e.grams").alias("gram"), F.col("e.subject").alias("subject"))


def verified(rows: DataFrame, known: list[str], support: int, purity: float) -> DataFrame:
    """rows(gram, subject), one a document -> (gram, subject) of the phrases that keep to one subject.

    One pass: a sum per listed subject beside the number of rows, so that a
    phrase on a third of all rows is added up before it is shuffled.
    """
    sums = [F.count_if(F.col("subject") == i).alias(f"c{i}") for i in range(len(known))]
    per = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *sums)
    best = F.greatest(*[F.struct(F.col(f"c{i}").alias("c"), F.lit(i).alias("i")) for i in range(len(known))]) if len(known) > 1 else F.struct(F.col("c0").alias("c"), F.lit(0).alias("i"))
    per = per.select("gram", "n", best.alias("b")).where(f"n >= {support} and b.c >= {support} and b.c / (n + 1) >= {purity}")
    return per.select("gram", F.col("b.i").cast("int").alias("subject"))


def assign(units: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, sent, subject): the subject most verified phrases of a sentence point to; none on a tie."""
    small = phrases.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES
    rows = units.select("doc_id", F.explode("sents").alias("s")).select("doc_id", "s.sent", F.explode("s.grams").alias("gram"))
    hits = rows.join(F.broadcast(phrases) if small else phrases, "gram")
    votes = hits.groupBy("doc_id", "sent", "subject").agg(F.count(F.lit(1)).alias("v"))
    two = votes.groupBy("doc_id", "sent").agg(F.max(F.struct("v", "subject")).alias("b"), F.sort_array(F.collect_list("v"), asc=False).alias("vs"))
    return two.where("size(vs) = 1 or vs[0] > vs[1]").select("doc_id", "sent", F.col("b.subject").alias("subject"))


def spread(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, assunto, sentences, share, seed): how many sentences of each document speak of each subject.

    ``share`` is of the document's sentences with a subject; ``seed`` marks hand
    labels that are trusted. Labels of unknown documents, null labels and labels
    outside the list of subjects are left out, repeated ones count once. Without
    labels there are no rows.
    """
    known = [r[0] for r in subjects.where("assunto is not null").select("assunto").distinct().orderBy("assunto").collect()]  # the fixed list
    if not known:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, assunto string, sentences bigint, share double, seed boolean")
    number = F.create_map(*[x for i, s in enumerate(known) for x in (F.lit(s), F.lit(i))])
    seeds = labels.where("doc_id is not null").select("doc_id", number[F.col("assunto")].alias("subject")).where("subject is not null").distinct()
    seeds = cut(seeds.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("own")))
    units = cut(sentences(documents))
    # first round: what a labelled document says belongs to each of its labels
    phrases = cut(verified(evidence(units.join(seeds, "doc_id"), "own"), known, FIRST_SUPPORT, FIRST_PURITY))
    told = cut(assign(units, phrases))
    for _ in range(rounds):
        spoken = told.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("sent", "subject"))).alias("says"))
        use = units.join(spoken, "doc_id", "left").join(seeds, "doc_id", "left").where("says is not null or own is not null")
        # clamp: a labelled document's sentence counts for what it says if that is among its labels, else for these
        said = "try_element_at(says, s.sent)"
        mine = f"case when own is null then array_compact(array({said})) when array_contains(own, {said}) then array({said}) else own end"
        now = cut(verified(evidence(use, mine), known, SUPPORT, PURITY))
        told = cut(assign(units, now))
        size = now.count()
        same = now.join(phrases, ["gram", "subject"], "left_semi").count()
        was, phrases = phrases.count(), now
        if size + was - 2 * same <= CHANGE * size:
            break
    count = told.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("sentences"))
    # clamp: labels hold where the text speaks of them, or of nothing
    any_of = count.groupBy("doc_id").agg(F.collect_set("subject").alias("has"))
    there = documents.select("doc_id").where("doc_id is not null").distinct()
    trusted = seeds.join(there, "doc_id").join(any_of, "doc_id", "left").select("doc_id", F.explode("own").alias("subject"), "has").where("has is null or array_contains(has, subject)")
    all_rows = count.join(trusted.select("doc_id", "subject", F.lit(True).alias("seed")), ["doc_id", "subject"], "full")
    total = F.sum(F.coalesce("sentences", F.lit(0))).over(Window.partitionBy("doc_id"))
    name = F.element_at(F.array(*[F.lit(s) for s in known]), F.col("subject") + 1)
    return all_rows.select(
        "doc_id", name.alias("assunto"), F.coalesce("sentences", F.lit(0)).alias("sentences"),
        F.when(total > 0, F.coalesce("sentences", F.lit(0)) / total).otherwise(F.lit(0.0)).alias("share"), F.coalesce("seed", F.lit(False)).alias("seed"),
    )


def dealt(scores: DataFrame) -> DataFrame:
    """(doc_id, assunto, sentences, share): the subjects a document deals with, passing mentions left out."""
    most = F.max("sentences").over(Window.partitionBy("doc_id"))
    keep = F.col("seed") | (F.col("sentences") == most) & (F.col("sentences") > 0) | (F.col("sentences") >= LEAST_SENTENCES) & (F.col("sentences") >= LEAST_SHARE * most)
    return scores.withColumn("keep", keep).where("keep").select("doc_id", "assunto", "sentences", "share")


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """p10_found: (doc_id, assunto) of the subjects each document deals with."""
    return dealt(spread(documents, labels, subjects, rounds)).select("doc_id", "assunto").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(assunto, n_docs, doc_share, text_share): how the corpus divides into subjects.

    ``doc_share`` is of all documents, ``text_share`` of all characters, a
    document's text going to its subjects by their sentences. The row '' holds
    documents without a subject. Every listed subject has a row.
    """
    deals = dealt(spread(documents, labels, subjects, rounds))
    size = documents.where("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("chars"))
    w = deals.withColumn("w", F.greatest(F.col("sentences"), F.lit(1)) / F.sum(F.greatest(F.col("sentences"), F.lit(1))).over(Window.partitionBy("doc_id")))
    parts = size.join(w, "doc_id", "left").select(F.coalesce("assunto", F.lit("")).alias("assunto"), (F.col("chars") * F.coalesce("w", F.lit(1.0))).alias("chars"))
    got = parts.groupBy("assunto").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("chars"))
    total = size.agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("all_chars"))
    listed = subjects.select("assunto").where("assunto is not null").unionByName(got.select("assunto")).distinct()
    return listed.join(F.broadcast(got), "assunto", "left").join(F.broadcast(total)).select(
        "assunto", F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.when(F.col("docs") > 0, F.coalesce("n_docs", F.lit(0)) / F.col("docs")).otherwise(F.lit(0.0)).alias("doc_share"),
        F.when(F.col("all_chars") > 0, F.coalesce("chars", F.lit(0.0)) / F.col("all_chars")).otherwise(F.lit(0.0)).alias("text_share"),
    )
