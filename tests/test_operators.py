from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabularium.functions import dims, jsonfix
from tabularium.functions.fuzzy import fold, osa
from tabularium.operators import anchors as A
from tabularium.operators import clean as C
from tabularium.operators import connect as K
from tabularium.operators import frontmatter as FM
from tabularium.operators import graph as G
from tabularium.operators import notes as N
from tabularium.operators import panels as P
from tabularium.operators import slices as S
from tabularium.operators import vault as V
from tabularium.operators import wordscore as L
from tabularium.streaming import windows as W


def masters(spark, *rows):
    return spark.createDataFrame(list(rows), "master_id bigint, corpo string")


def test_dimensions_agree():
    assert dims.self_test() == []


def test_distance_and_fold():
    assert fold("Ação ÇÉ") == "acao ce"
    assert [osa("vigente", x) for x in ("vigente", "vignete", "vigent", "vgiente", "x")] == [0, 1, 1, 1, 7]
    assert osa("abcdef", "uvwxyz", 2) == 3


def test_anchor_checks(spark):
    m = masters(spark, (1, "{{p.1}}\na\n{{p.3}}\nb\n{{p.2}}\n{{p.2}}\n{{p.xiv}}\n{{loc.9}}"), (2, "no anchor"), (3, None), (None, "{{p.1}}"), (1, "{{p.1}}\na\n{{p.3}}\nb\n{{p.2}}\n{{p.2}}\n{{p.xiv}}\n{{loc.9}}"))
    a = A.anchors(m)
    assert [r["label"] for r in a.orderBy("pos").collect()] == ["1", "3", "2", "2", "xiv", "9"]
    assert [(r["n"], r["before"]) for r in A.out_of_order(a).collect()] == [(2, 3)]
    assert [(r["label"], r["times"]) for r in A.doubles(a).collect()] == [("2", 2)]
    assert A.gaps(a).first()["missing"] == 5
    v = {r["master_id"]: r["verdict"] for r in A.integrity(m, a).collect()}
    assert v == {1: "fail", 2: "fail", 3: "fail"}
    p = {r["line_no"]: r["page"] for r in A.page_of_lines(m).collect()}
    assert p == {2: "1", 4: "3"}
    empty = masters(spark)
    assert A.integrity(empty, A.anchors(empty)).collect() == []


def test_anchor_difference_counts_copies(spark):
    a, b = A.anchors(masters(spark, (1, "{{p.1}} {{p.1}} {{p.2}}"))), A.anchors(masters(spark, (1, "{{p.1}} {{p.3}}")))
    assert sorted(tuple(r) for r in A.difference(a, b).collect()) == [(1, "1", "lost", 1), (1, "2", "lost", 1), (1, "3", "invented", 1)]


def test_clean_keeps_anchors_and_drops_edges(spark):
    page = "RUNNING HEAD\n\n{{p.%d}}\n\nLinha %d.\n\nO texto vai seguin-\ndo aqui\nsem parar.\n\nFim %d.\n\n"
    m = masters(spark, (1, "".join(page % (i, i, i) for i in range(1, 7)) + "Frase que fica.\n" * 5), (2, None))
    got = C.clean(m).collect()
    assert len(got) == 1 and "RUNNING HEAD" not in got[0]["texto"] and "seguindo aqui sem parar." in got[0]["texto"]
    assert got[0]["texto"].count("{{p.") == 6 and got[0]["n_joined"] == 6 and got[0]["n_headers"] == 6
    assert "Frase que fica." in got[0]["texto"]  # repeated far from anchors: stays
    assert A.difference(A.anchors(m), A.anchors(C.clean(m), "master_id", "texto")).collect() == []


def test_slices_hold_every_block_once(spark):
    text = "# Um\n\n" + "\n\n".join("palavra " * 40 for _ in range(20)) + "\n\n## Dois\n\n" + "\n\n".join("outra " * 40 for _ in range(20))
    m = masters(spark, (1, text), (2, "curto"), (3, ""), (4, None))
    b, s = S.blocks(m), S.slices(m, 300)
    assert s.agg(F.sum("words")).first()[0] == b.agg(F.sum("words")).first()[0] == len(text.split()) + 1
    assert max(r["words"] for r in s.collect()) <= 390
    first = s.where("master_id = 1").orderBy("parte").collect()
    assert [r["parte"] for r in first] == list(range(1, len(first) + 1))


@pytest.mark.parametrize("text, want", [
    ("---\na: 1\nb: [x, y]\nc: true\n---\nbody", {"a": "1", "b": ["x", "y"], "c": True}),
    ("---\na: >\n  one\n  two\nb: null\n---\n", {"a": "one two", "b": None}),
    ("---\ntags:\n  [\n  \"u\",\n  'v'\n  ]\na: x # note\n---\n", {"tags": ["u", "v"], "a": "x"}),
    ("---\na: 1\na: 2\n---\n", {"a": "2"}),
    ("---\r\ntitulo: \"Um\"\r\n---\r\nbody", {"titulo": "Um"}),
])
def test_front_matter(spark, text, want):
    got = FM.parse(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    value = lambda v: {"string": v["s"], "bool": v["b"], "list": v["l"], "null": None}[v["kind"]]
    assert got["has_fm"] and {k: value(v) for k, v in got["fm"].items()} == want


def test_front_matter_absent_update_and_round_trip(spark):
    docs = lambda *ts: spark.createDataFrame(list(enumerate(ts)), "doc_id bigint, text string")
    got = FM.parse(docs("no head", "---\na: 1\n---", None, "", "---\na: x\n---\nb")).orderBy("doc_id").collect()
    assert [(r["fm"], r["body"], r["has_fm"]) for r in got[:4]] == [({}, "no head", False), ({}, "---\na: 1\n---", False), ({}, None, False), ({}, "", False)]
    assert got[4]["fm"]["a"]["s"] == "x" and got[4]["body"] == "b" and got[4]["has_fm"]
    cols = "doc_id bigint, titulo string, n string, ok boolean, area array<string>"
    values = [("Um: dois", None, True, ["Civil", "Água, Energia"]), ('diz "sim"', " x ", False, []), ("it's \"so\" \\ c", "a # b", None, ['a "b"', "it's #1"]), ("- um", "C:\\d", True, None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], cols)
    back = FM.parse(df.select("doc_id", F.concat(FM.written(df, ["titulo", "n", "ok", "area"]), F.lit("x")).alias("text"))).orderBy("doc_id").collect()
    assert [(r["fm"]["titulo"]["s"], r["fm"]["n"]["s"], r["fm"]["ok"]["b"], r["fm"]["area"]["l"]) for r in back] == values and {r["body"] for r in back} == {"x"}
    new = lambda t: docs(t).select(FM.updated(F.col("text"), "a", FM.line("a", F.lit('n$1 "q"'), "string")).alias("t")).first()["t"]
    t = new("---\na: [\n  x\n  ]\nb: 2\n# c\na: 3\n---\nbody")
    assert t == "---\na: 'n$1 \"q\"'\nb: 2\n# c\na: 3\n---\nbody"
    assert new("body") == "---\na: 'n$1 \"q\"'\n---\nbody" and new("---\nb: 1\n---\n") == "---\nb: 1\na: 'n$1 \"q\"'\n---\n"


def test_front_matter_of_a_long_head(spark):
    head = "".join(f"k{i % 5000}: v{i}\n" for i in range(20_000)) + "t: >\n" + "  x\n" * 20_000
    got = FM.parse(spark.createDataFrame([(1, f"---\n{head}---\nb")], "doc_id bigint, text string")).select(F.size("fm"), F.expr("fm['k7'].s"), F.length(F.expr("fm['t'].s"))).first()
    assert tuple(got) == (5001, "v15007", 39_999)


@pytest.mark.parametrize("text, want", [
    ('said ```json\n{"a": "he said "no" again"}\n```', {"a": 'he said "no" again'}),
    ('{"a": "line\nbreak\tand tab"}', {"a": "line\nbreak\tand tab"}),
    ('x {"k": 1} y', {"k": 1}),
    ('{"a": "o termo "Laffer", cunhado depois", "b": 1}', {"a": 'o termo "Laffer", cunhado depois', "b": 1}),
    ('{"a": "diz "x": y", "b": ["um "dois", tres", "q"], "c": {"d": "e "f"}"}}', {"a": 'diz "x": y', "b": ['um "dois", tres', "q"], "c": {"d": 'e "f"}'}}),
    ('[{"a": "b \\"c\\" "d""}, {"a": null}]', [{"a": 'b "c" "d"'}, {"a": None}]),
    ("nothing", None), ("", None), (None, None), ('"text"', None), ('{"a": ', None),
])
def test_json_is_found_and_mended(spark, text, want):
    import json

    got = spark.createDataFrame([(text,)], "t string").select(jsonfix.recover_json(F.col("t")).alias("j")).first()["j"]
    assert (got and json.loads(got)) == want


def test_names_and_roman(spark):
    df = spark.createDataFrame([("Ação & Reação_OCR",)], "t string")
    r = df.select(N.slug(F.col("t")).alias("s"), N.name_key(F.col("t")).alias("k"), N.prefix(F.col("t")).alias("p")).first()
    assert (r["s"], r["k"], r["p"]) == ("acao-reacao-ocr", "acaoreacao", "Ação-Reação_OCR")
    got = {x["id"]: x["r"] for x in spark.range(1, 60).select("id", N.to_roman(F.col("id")).alias("r")).collect()}
    assert got[4] == "iv" and got[49] == "xlix" and got[58] == "lviii"


def test_relations_by_hand(spark):
    ids = spark.createDataFrame([("a", "lei", "1", 1), ("b", "lei", "1", 2), ("a", "lei", "2", 1), ("b", "lei", "2", 1), ("c", "lei", "3", 5), ("d", "lei", "3", 1), ("c", "lei", "9", 1), ("a", "lei", "9", 1), ("d", "lei", "9", 1)], "work string, label string, num string, n bigint")
    rel = K.relations(ids, least=0.5)
    got = sorted((r["work"], r["other"], r["common"]) for r in rel.collect())
    assert got == [("a", "b", 2), ("b", "a", 2), ("c", "d", 1), ("d", "c", 1)]  # 9 is in three of four works
    empty = ids.limit(0)
    assert K.relations(empty).collect() == [] and K.hubs(empty).collect() == []


def test_common_identifiers_change_no_relation(spark):
    import random

    rnd = random.Random(4)
    rows = sorted({(f"w{rnd.randint(0, 25)}", "lei", str(min(rnd.randint(1, 30), rnd.randint(1, 30))), 1) for _ in range(260)})
    ids = spark.createDataFrame(rows, "work string, label string, num string, n bigint")
    want = {(r["work"], r["other"], r["common"], r["weight"]) for r in K.relations(ids, least=2.0, top=99, common=10**6).collect()}
    for common in (0, 3, 6):
        assert {(r["work"], r["other"], r["common"], r["weight"]) for r in K.relations(ids, least=2.0, top=99, common=common).collect()} == want and want


def test_findings_touch_notes_in_any_cells(spark):
    import random

    rnd = random.Random(6)
    f = spark.createDataFrame(sorted({(rnd.randint(1, 40), "lei", str(rnd.choice((1, 1, 2, 3)))) for _ in range(60)}), "finding bigint, label string, num string")
    n = spark.createDataFrame(sorted({(rnd.randint(1, 90), "lei", str(rnd.choice((1, 1, 1, 2, 4)))) for _ in range(150)}), "note_id bigint, label string, num string")
    want = {tuple(r) for r in f.join(n, ["label", "num"]).groupBy("finding", "note_id").count().collect()}
    for cell in (10**6, 50, 1):
        got = [tuple(r) for r in K.affected(f, n, cell).collect()]
        assert set(got) == want and len(got) == len(want) > 500
    assert {r["note_id"] for r in K.touched(f, n).collect()} == {b for a, b, _ in want if a != b}
    one = f.groupBy("finding").agg(F.min("label").alias("label"), F.min("num").alias("num"))
    df = K.affected(one, n)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # pairs aren't shuffled
    assert sorted((r["finding"], r["note_id"], r["common"]) for r in df.collect()) == sorted((r["finding"], r["note_id"], 1) for r in one.join(n, ["label", "num"]).collect())
    alone = spark.createDataFrame([(5, "lei", "7")], "finding bigint, label string, num string")
    assert K.touched(alone, alone.withColumnRenamed("finding", "note_id")).collect() == [] and K.affected(f.limit(0), n).collect() == []


def test_touched_pairs_take_little_disk(spark, tmp_path):
    f = spark.range(40).selectExpr("cast(id + 1000000000 as string) finding", "'lei' label", "'1' num")
    n = spark.range(20_000).selectExpr("id * 7 note_id", "'lei' label", "'1' num")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be sent
    try:
        K.affected(f, n).write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.count() == got.distinct().count() == 800_000 and got.join(n, "note_id", "left_anti").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 400_000  # notes in one long row beside each finding: 1.5 MB and more
    odd = n.where("note_id < 70").unionByName(n.where("note_id < 14").selectExpr("cast(null as bigint) note_id", "label", "num"))
    for cell, tile in ((10**6, 4), (50, 3), (50, 100)):  # lists that end early, and a note without number
        pairs = K.affected(f, odd, cell, tile).collect()
        assert len(pairs) == len(set(pairs)) == 40 * 11 and {r["note_id"] for r in pairs} == {None, *range(0, 70, 7)}


def test_blocks_of_works_change_no_pair(spark):
    rows = sorted({(f"w{i % 23:02}", "lei", str(i * i % 17), 1) for i in range(200)})
    ids = spark.createDataFrame(rows, "work string, label string, num string, n bigint")
    a, b = ids.select("work", "label", "num"), ids.select(F.col("work").alias("other"), "label", "num")
    want = sorted(tuple(r) for r in a.join(b, ["label", "num"]).where("work < other").groupBy("work", "other").count().collect())
    assert sorted(tuple(r) for r in K.shared(a, works=4).collect()) == want and len(want) > 50
    top = [sorted(tuple(r) for r in K.relations(ids, least=0.5, top=3, works=w).collect()) for w in (4, 100)]
    assert top[0] == top[1] and len(top[0]) > 20


def test_identifiers_need_their_words(spark):
    docs = spark.createDataFrame([(1, "Lei nº 5.172 e a SÚMULA 473; decreto-lei 200"), (2, None), (3, "lei 12")], "doc_id bigint, t string")
    got = {(r["label"], r["num"]) for r in K.extract(docs, "doc_id", "t").collect()}
    assert {("lei", "5172"), ("sumula", "473"), ("decreto", "200")} <= got and ("lei", "12") not in got


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == got[101] == 100
    assert G.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_panels(note_rows, spark):
    n = note_rows(
        {"note_id": 1, "stem": "a", "tipo": "Doutrina", "status": "Vigente", "ano": "2001", "mtime": datetime(2026, 5, 20), "path": "01/a.md"},
        {"note_id": 2, "stem": "b", "tipo": "Artigo", "status": "A-conferir", "mtime": datetime(2020, 1, 1), "path": "99/b.md"},
        {"note_id": 3, "stem": "c", "tipo": "Doutrina", "status": "Vigente", "parte": "1", "path": "01/c.md"},
    )
    b = P.board(n)
    assert P.ready(b).count() == 1 and P.pending(b).count() == 1 and P.recent(b, "2026-06-01").count() == 1
    full = N.once(n, *P.COLUMNS, "path")
    got = P.run('TABLE WITHOUT ID file.link AS "nota", ano FROM -"99" WHERE contains(tipo,"Dout") AND !parte AND file.mtime >= date(today) - dur(30 days) SORT ano DESC', full, "2026-06-01")
    assert [tuple(r) for r in got.collect()] == [("a", "2001")]
    g = P.run("TABLE key, length(rows) AS n WHERE tipo GROUP BY status", full)
    assert sorted(tuple(r) for r in g.collect()) == [("A-conferir", 1), ("Vigente", 2)]
    for bad in ("TABLE x WHERE", 'TABLE x WHERE tipo = "a" nonsense ;', "SELECT"):
        with pytest.raises(P.QueryError):
            P.run(bad, full)


def test_language_by_word_lists(spark):
    por, eng = "o texto de lei que não se aplica a um caso e os autos da parte ", "the court of law which does not apply to this case and the claim of "
    docs = spark.createDataFrame([(i, (por if i % 2 else eng) * 5, "por" if i % 2 else "eng") for i in range(10)] + [(90, por * 5, None), (91, "curto", None), (92, None, None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["idioma"] for r in L.detect(docs).collect()}
    assert got[90] == "por" and 91 not in got and 92 not in got and got[0] == "eng"


def test_windows_batch(spark):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0), 7, "a", 1.0), (2, datetime(2024, 1, 1, 0, 10), 7, "a", 2.0), (3, datetime(2024, 1, 1, 3, 0), 7, "b", None), (3, datetime(2024, 1, 1, 3, 0), 7, "b", None), (4, None, 7, "b", 1.0)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    assert sorted(r["n"] for r in W.tumbling(W.distinct(e)).collect()) == [1, 2]
    assert sorted(r["n"] for r in W.sessions(W.distinct(e)).collect()) == [1, 2]
    assert W.tumbling(e.limit(0)).collect() == []


def test_graph_faults_of_a_planted_vault(spark, note_rows):
    ok = {"has_fm": True, "tipo": "Doutrina", "tipo_fonte": "livro", "status": "Vigente", "area": "Civil"}
    name = "CIVIL_DOUT_2020_Obra_Autor"
    rows = [
        dict(ok, note_id=1, stem=f"{name}_INDICE", partes="2", corpo=f"[[{name}_p01]] [[nowhere|x]] [[«modelo»]]"),
        dict(ok, note_id=2, stem=f"{name}_p01", parte="1", obra=f"[[{name}_INDICE | x ]]"),
        dict(ok, note_id=3, stem="odd name", tipo="Doutrinaa", area=None, partes="?"),
        dict(ok, note_id=4, stem=f"{name}2_p01", parte="1", obra="[[Ghost_INDICE]]"),
        dict(ok, note_id=5, stem=f"{name}3_p01", parte="1", obra="  "),
        {"note_id": 6, "stem": f"{name}4", "tipo": "Jurisprudência", "tipo_fonte": "livro", "area": "x"},
    ]
    voc = spark.createDataFrame([("tipo", 1, "Doutrina"), ("tipo", 2, "Jurisprudência"), ("status", 1, "Vigente")], "campo string, ord bigint, canonico string")
    got = sorted((r["note_id"], r["code"]) for r in V.findings(note_rows(*rows, rows[0]), voc).collect())
    assert got == [(1, "broken_link"), (1, "slice_count"), (3, "count_not_a_number"), (3, "kind"), (3, "name"), (3, "no_area"), (3, "pair"), (4, "orphan"), (5, "slice_without_link"), (6, "no_metadata"), (6, "pair")]
    assert V.findings(note_rows(), voc).collect() == []


def test_listings(spark):
    pdf = spark.createDataFrame([("a", "x.pdf"), ("a", "x_OCR.pdf"), ("a", "y_OCR.PDF"), ("b", "x_OCR.pdf"), ("a", "n.txt"), ("a", None)], "folder string, name string")
    assert sorted(tuple(r) for r in V.sources_listing(pdf).collect()) == [("a", "x.pdf"), ("a", "y_OCR.PDF"), ("b", "x_OCR.pdf")]
    src = spark.createDataFrame([(1, "/a/", None), (2, "/a", "folder"), (3, " ", None), (4, None, None), (5, "/b.pdf", None), (6, "/", None)], "ord int, path string, kind string")
    assert sorted(tuple(r) for r in V.first_of_each(src).collect()) == [(1, "/a", "folder"), (5, "/b.pdf", "file"), (6, "/", "folder")]


def test_pages_are_taken_apart_and_put_together(spark):
    m = masters(spark, (1, "{{p.1}}\n\num\ndois\n\n{{p.2}}\n\ntrês"), (2, None), (3, "sem"))
    p = V.pages(m)
    assert sorted((r["page"], r["text"]) for r in p.collect()) == [("1", "um\ndois"), ("2", "três")]
    assert V.assemble(p).first()["texto"] == "{{p.1}}\n\num\ndois\n\n{{p.2}}\n\ntrês"


def test_panel_order_keeps_every_row(spark, note_rows, tmp_path):
    import __spark_entry__ as entry

    rows = [{"note_id": i, "stem": f"s{i:03}", "tipo": "Doutrina" if i % 5 else None, "ano": str(1990 + i % 7) if i % 4 else None, "status": "Vigente"} for i in range(60)]
    note_rows(*rows, {"note_id": 99, "stem": "x", "tipo": "Doutrina", "status": "Revogado"}).write.parquet(f"{tmp_path}/notes.parquet")
    want = []
    for kind in ("Doutrina", None):
        own = sorted((r for r in rows if r["tipo"] == kind), key=lambda r: (-int(r["ano"] or 0), r["stem"]))
        want += [(r["note_id"], kind, r["ano"], k) for k, r in enumerate(own, 1)]
    assert sorted(map(tuple, entry.queries()["O10_panel_order"](spark, str(tmp_path)).collect())) == sorted(want)


def test_source_type_from_name_and_text(spark):
    from tabularium.operators.triage import inferred_type

    rows = [
        (1, "obra-1", "conforme a Lei nº 77"), (2, "obra-2", "Ementa: nada mais"), (3, "lei-77", "LEI Nº 77"), (4, "revista-2", "Acórdão. Relatora: X"), (5, "obra-5", "Acórdão. Relator: X"),
        (6, "Tese de A", None), (7, None, "nada"), (8, "obra-8", "o congresso nacional DECRETA e a presidência da república"), (9, "obra-9", "isbn 1 © habeas corpus"), (10, "obra", "Excelentíssimo senhor"),
        (11, "minuta", "portaria nº 3"), (1, "obra-1", "conforme a Lei nº 77"), (None, "lei", "x"),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in inferred_type(spark.createDataFrame(rows, "doc_id bigint, obra string, text string")).collect()}
    assert got == {
        1: ("legislacao", 2, "media"), 2: ("", 1, "baixa"), 3: ("legislacao", 4, "alta"), 4: ("jurisprudencia", 4, "media"), 5: ("jurisprudencia", 4, "alta"), 6: ("trabalho_academico", 2, "media"), 7: ("", 0, "baixa"),
        8: ("legislacao", 4, "alta"), 9: ("livro", 3, "media"), 10: ("peca_interna", 2, "media"), 11: ("peca_interna", 2, "media"),
    }


def test_long_identifiers_are_shown(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([("lei", "1234567"), ("lei", "1234567890"), ("lei", "12"), ("processo", "12345678")], "label string, num string").write.parquet(f"{tmp_path}/mentions.parquet")
    got = {r["shown"] for r in entry.queries()["F11_identifier_text"](spark, str(tmp_path)).collect()}
    assert got == {"lei 1.234.567", "lei 1.234.567.890", "lei 12", "processo 12345678"}


def test_a_blank_line_in_a_quote_doesnt_end_its_block(spark):
    m = masters(spark, (1, "> um\n\nsegue\n\noutro\n\n\n> dois\n\n\nfora"), (2, "a\n\nb\n{{p.1}}\n\n> c\nd\n\ne\n# T\n\nf"), (3, "> x"), (4, ""), (5, None))
    got: dict[int, list[int]] = {}
    for r in S.blocks(m).orderBy("master_id", "block").collect():
        got.setdefault(r["master_id"], []).append(r["first_line"])
    assert got == {1: [1, 5, 8, 11], 2: [1, 3, 4, 6, 10, 12], 3: [1]}


def test_works_under_the_least_size_are_delivered_whole(spark):
    m = masters(spark, (1, "\n\n".join("palavra " * 40 for _ in range(20))), (2, "curto"), (3, None))
    assert sorted(tuple(r) for r in S.delivered(m, 300, 100).collect()) == [(1, 800, 3, False), (2, 1, 1, True)]
    assert {r["whole"] for r in S.delivered(m, 300, 4000).collect()} == {True}


def test_anchors_behind_an_open_fence(spark):
    m = masters(spark, (1, "```\n{{p.1}}"), (2, "```\nx\n```\n`y`{{p.1}}"), (3, "{{p.1}}"), (4, None))
    assert {r["master_id"]: r["fenced"] for r in A.fenced(m).collect()} == {1: True, 2: False, 3: False}


def test_layers_are_compared_by_name_and_text(spark):
    a, b = masters(spark, (1, "x"), (2, "y"), (3, None), (4, "z"), (None, "x")), masters(spark, (1, "x"), (2, "Y"), (3, None), (9, "q"))
    assert {r["master_id"]: r["state"] for r in V.compared(a, b).collect()} == {1: "equal", 2: "changed", 3: "equal", 4: "absent"}
    x = spark.createDataFrame([("a", "Um", 3), ("b", "um", 1), ("a", "dois", 5)], "layer string, name string, id bigint")
    assert [tuple(r) for r in V.collisions(x).collect()] == [("um", 2, 2, 1)] and V.collisions(x.limit(0)).collect() == []


def test_pages_with_a_big_image_need_more_text(spark):
    p = spark.createDataFrame([(1, "1", "x" * 9), (1, "2", "x" * 299), (1, "3", "x" * 299), (2, "1", "x" * 10)], "master_id bigint, page string, text string")
    big = spark.createDataFrame([(1, "2"), (1, "2"), (9, "1")], "master_id bigint, page string")
    assert sorted(tuple(r) for r in V.text_layer(p, images=big).collect()) == [(1, 3, 2, False), (2, 1, 0, True)]
    assert sorted(tuple(r) for r in V.text_layer(p).collect()) == [(1, 3, 1, False), (2, 1, 0, True)]


def test_doubled_names_and_unknown_codes(spark, note_rows):
    ok = {"has_fm": True, "tipo": "Doutrina", "tipo_fonte": "livro", "status": "Vigente", "area": "Civil"}
    rows = [
        dict(ok, note_id=1, stem="CIVIL_DOUT_2020_Obra_Autor", confiabilidade="Oficial"), dict(ok, note_id=2, stem="CIVIL_DOUT_2020_Obra_Autor", confiabilidade="null"),
        dict(ok, note_id=3, stem="ZOO_XYZ_2020_Obra_Autor", confiabilidade="talvez"), dict(ok, note_id=4, stem="ZOO_XYZ_2020_Obra_Autor_p01", parte="1", obra="[[ZOO_XYZ_2020_Obra_Autor]]"),
    ]
    voc = spark.createDataFrame([("tipo", 1, "Doutrina"), ("status", 1, "Vigente")], "campo string, ord bigint, canonico string")
    got = sorted((r["note_id"], r["code"]) for r in V.findings(note_rows(*rows), voc).collect())
    assert got == [(1, "duplicate_name"), (2, "duplicate_name"), (3, "area_code"), (3, "kind_code"), (3, "trust")]


def test_the_last_delivery_counts_whole(note_rows):
    n = note_rows({"note_id": 1, "area": "Z", "autoria": "a", "ingested_at": datetime(2020, 1, 1)}, {"note_id": 1, "area": "A", "autoria": None, "ingested_at": datetime(2021, 1, 1)})
    assert [tuple(r) for r in N.once(n, "area", "autoria").collect()] == [(1, "A", None)]
    assert [tuple(r) for r in N.once(n.drop("ingested_at"), "area", "autoria").collect()] == [(1, "Z", "a")]
