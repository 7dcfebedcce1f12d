import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabularium.functions.fuzzy import fold
from tabularium.operators import multivalue as M

CASES = [
    ("area", "Civil; Penal", ["Civil", "Penal"]),
    ("area", "Civil;; ;Penal;", ["Civil", "Penal"]),
    ("area", '["Civil", "Água, Energia e Saneamento"]', ["Civil", "Água, Energia e Saneamento"]),
    ("area", "Civil, Água, Energia e Saneamento, Penal", ["Civil", "Água, Energia e Saneamento", "Penal"]),
    ("area", "Civil/água, enerria e saneamneto", ["Civil", "água, enerria e saneamneto"]),
    ("area", "- Civil\n- Penal", ["Civil", "Penal"]),
    ("area", "Civil\n- Penal", ["Civil", "Penal"]),
    ("area", "Civil, Penal e Digital", ["Civil", "Penal", "Digital"]),
    ("area", "Trabalho e emprego", ["Trabalho e emprego"]),
    ("area", "[Civil, Trabalho e emprego]", ["Civil", "Trabalho e emprego"]),
    ("area", "Licitações e Contratos & Civil", ["Licitações e Contratos", "Civil"]),
    ("area", 'consumidor, "Água,."', ["consumidor", "Água,."]),
    ("autoria", "SILVA, João; SOUZA, Ana Maria de", ["SILVA, João", "SOUZA, Ana Maria de"]),
    ("autoria", "SILVA, João e SOUZA, Ana", ["SILVA, João", "SOUZA, Ana"]),
    ("autoria", "SILVA, João", ["SILVA, João"]),
    ("autoria", '"SILVA, João ""Joca"" M"; SOUZA, Ana', ['SILVA, João "Joca" M', "SOUZA, Ana"]),
    ("autoria", 'SILVA, João "Joca" M | Ana de Souza', ['SILVA, João "Joca" M', "Ana de Souza"]),
    ("autoria", "['SILVA, João', 'SOUZA, Ana \"Nina\" B']", ["SILVA, João", 'SOUZA, Ana "Nina" B']),
    ("autoria", "CENTRO DE ESTUDOS FISCAIS E ADUANEIROS DE X; SILVA, João", ["CENTRO DE ESTUDOS FISCAIS E ADUANEIROS DE X", "SILVA, João"]),
    ("autoria", "Instituto de Controle e Transparência de X", ["Instituto de Controle e Transparência de X"]),
    ("autoria", "célio da silva, Ana de Souza e Luís Melo", ["célio da silva", "Ana de Souza", "Luís Melo"]),
]


@pytest.mark.parametrize("field, text, want", CASES)
def test_forms(spark, field, text, want):
    df = spark.createDataFrame([(1, text)], f"note_id bigint, {field} string")
    listed = spark.createDataFrame([("area", "Água, Energia e Saneamento"), ("area", "Licitações e Contratos"), ("area", "Civil"), (None, "x e y")], "campo string, canonico string")
    joined = {"area": {("trabalho", "e", "emprego")}, "autoria": {("fiscais", "e", "aduaneiros"), ("controle", "e", "transparencia")}}
    got = M.split_values(df, (field,), windows=joined, vocabulary=listed).orderBy("pos").collect()
    assert [r["valor"] for r in got] == want
    assert [r["pos"] for r in got] == list(range(1, len(want) + 1)) and all(r["n"] == len(want) for r in got)


def test_blanks_nulls_repeats_and_clashing_columns(spark, note_rows):
    rows = [{"note_id": i, "area": a, "autoria": None} for i, a in enumerate([None, "", "   ", "null", "[]", "~", "Civil", "Civil; Penal", "Civil; Penal"])]
    rows.append({"note_id": None, "area": "Civil; Penal"})
    n = note_rows(*rows, rows[7])
    extra = n.withColumn("k", M.F.lit(1)).withColumn("campo", M.F.lit("x")).withColumn("pos", M.F.lit(0)).withColumn("v", M.F.lit("y"))
    got = sorted(tuple(r) for r in M.found(extra).collect())
    assert got == [(7, "area", 1, "Civil"), (7, "area", 2, "Penal"), (8, "area", 1, "Civil"), (8, "area", 2, "Penal")]
    assert M.found(note_rows()).collect() == []


def test_one_long_field(spark):
    text = ";".join(f"v{i}" for i in range(50_000))
    got = M.split_values(spark.createDataFrame([(1, text)], "note_id bigint, area string"), ("area",))
    assert got.count() == 50_000 and got.where("pos = 50000").first()["valor"] == "v49999"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdé ÁZ", min_size=1, max_size=8).map(str.strip).filter(lambda x: x and x not in M.BLANK and " e " not in x and not x.startswith("e ") and not x.endswith(" e")), min_size=1, max_size=6))
def test_round_trip_of_quoted_lists(values):
    import pyarrow as pa

    text = "[" + ", ".join(f'"{v}"' for v in values) + "]"
    assert M.lists(pa.array([text]), "area").to_pylist() == [values]


def test_joined_words_are_learned_from_quoted_items(spark):
    rows = ['["Civil", "Impostos e Taxas"]', '"impostos e taxas"; Penal', "impostos e taxas; Civil", "Impostos e tsxas", "Penal e Civil", '"so e uma"', "so e uma", '"a e b', "água, luz", '["Água, luz", "Água, luz e gás"]', "luz e gás"]
    df = spark.createDataFrame(list(enumerate(rows)), "note_id bigint, area string")
    assert M.learned_windows(df, ("area",)) == {"area": {("impostos", "e", "taxas"), ("agua", ",", "luz")}}
    got: dict[int, list[str]] = {}
    for r in M.split_values(df, ("area",)).orderBy("note_id", "pos").collect():
        got.setdefault(r["note_id"], []).append(r["valor"])
    assert [got[i] for i in (2, 3, 4, 6, 8, 10)] == [["impostos e taxas", "Civil"], ["Impostos e tsxas"], ["Penal", "Civil"], ["so", "uma"], ["água, luz"], ["luz", "gás"]]
    assert M.learned_windows(df.limit(0), ("area",)) == {"area": set()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["SILVA", "João", "Ana de Souza", "Instituto de Leis", "MARIA JOSE LIMA", "LIMA FILHO", "X", "", "d'Ávila"]), max_size=6), max_size=4))
def test_commas_of_names_against_one_by_one(rows):
    """The alternation over whole batches equals going from comma to comma."""
    import pyarrow as pa

    def complete(part):
        w = part.split()
        if "," in part:
            return True
        if not w:
            return False
        if fold(w[0]) in M.BODY_WORDS:
            return True
        return len(w) >= 3 and fold(w[-1]) not in M.OPEN_ENDS if part.upper() == part else len(w) >= 2 and not (w[0].isupper() and len(w[0]) > 2)

    def one_by_one(parts):
        out, now = [], None
        for p in parts:
            if now is None:
                now = p
            elif complete(now.strip()) and "".join(out + [now]).strip():
                out, now = [*out, now], p
            else:
                now = f"{now}, {p}"
        return [x.strip() for x in [*out, *([now] if now is not None else [])] if x.strip()]

    texts = [", ".join(r) for r in rows]
    assert M.lists(pa.array(texts, pa.string()), "autoria").to_pylist() == [one_by_one(r) for r in rows]
