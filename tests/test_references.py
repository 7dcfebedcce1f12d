import random
from datetime import datetime, timedelta

from tabularium.operators import references as R

T0 = datetime(2024, 1, 1)


def brute(notes, removals):
    """The definition, row by row."""
    first, last, gone = {}, {}, {}
    arrive = {}
    for n in notes:
        s, t = n["stem"], n["ingested_at"]
        first[s], last[s] = min(first.get(s, t), t), max(last.get(s, t), t)
        arrive[n["note_id"]] = min(arrive.get(n["note_id"], t), t)
    for s, t in removals:
        gone[s] = max(gone.get(s, t), t)
    present = {s for s in first if not (s in gone and gone[s] > last[s])}
    out = set()
    have = {}
    for n in notes:
        if n["stem"] in present and n["obra"] and n["parte"]:
            have.setdefault(n["obra"].strip("[] "), set()).add(int(n["parte"]))
    for n in notes:
        if n["stem"] not in present:
            continue
        month = arrive[n["note_id"]].strftime("%Y-%m")
        if n["obra"]:
            t = n["obra"].strip("[] ")
            if t not in present:
                out.add(("obra", n["note_id"], 0, month, "deleted" if t in gone else "missing"))
            elif first[t] > arrive[n["note_id"]]:
                out.add(("obra", n["note_id"], 0, month, "late"))
        if n["partes"] and n["partes"].isdigit():
            for k in range(1, int(n["partes"]) + 1):
                if k not in have.get(n["stem"], ()):
                    child = n["stem"].removesuffix("_INDICE") + f"_p{k:02d}"
                    out.add(("partes", n["note_id"], k, month, "deleted" if child not in present and child in gone else "missing"))
    return out


def test_against_brute_force(spark, note_rows):
    rnd = random.Random(5)
    for _ in range(4):
        rows, removals, i = [], [], 0
        for w in range(12):
            base = f"W{w}"
            if rnd.random() < 0.85:
                i += 1
                rows.append({"note_id": i, "stem": f"{base}_INDICE", "partes": rnd.choice(["3", "04", "2", "?", "null", None]), "ingested_at": T0 + timedelta(days=rnd.randint(0, 200))})
            for k in range(1, 4):
                if rnd.random() < 0.8:
                    i += 1
                    rows.append({"note_id": i, "stem": f"{base}_p{k:02d}", "parte": str(k), "obra": f"[[{base}_INDICE]]", "ingested_at": T0 + timedelta(days=rnd.randint(0, 200))})
            for s in (f"{base}_INDICE", f"{base}_p01", f"{base}_p02"):
                if rnd.random() < 0.25:
                    removals.append((s, T0 + timedelta(days=rnd.randint(0, 250))))
        rows += [dict(r, ingested_at=r["ingested_at"] + timedelta(days=9)) for r in rows[:3]]
        for r in rows:
            for c in ("obra", "parte", "partes"):
                r.setdefault(c, None)
        got = {tuple(x) for x in R.found(note_rows(*rows), spark.createDataFrame(removals or [("x", T0)], "stem string, removed_at timestamp_ntz")).collect()}
        assert got == brute(rows, removals)


def test_link_forms_nulls_and_empty(spark, note_rows):
    none = spark.createDataFrame([], "stem string, removed_at timestamp_ntz")
    base = {"note_id": 1, "stem": "A_INDICE", "ingested_at": T0, "partes": "0"}
    forms = ["[[A_INDICE]]", "ver [[ 01-D/A_INDICE.md | nome ]]", "[[A_INDICE#Sumário]]", "A_INDICE", " ", "null", "[]", None, "[[]]"]
    rows = [base] + [{"note_id": i + 2, "stem": f"s{i}", "obra": f, "parte": "1", "ingested_at": T0} for i, f in enumerate(forms)]
    rows.append({"note_id": None, "stem": None, "obra": "[[nowhere]]"})
    assert R.found(note_rows(*rows), none).collect() == []
    assert R.found(note_rows(), none).collect() == []
    # an arrival that isn't known, a huge stated count, and a clashing extra column
    big = note_rows({"note_id": 1, "stem": "B_INDICE", "partes": "2500", "ingested_at": T0}).withColumn("alvo", R.F.lit("x")).withColumn("parte_n", R.F.lit(1))
    assert R.found(big, none).count() == 2500


def test_a_count_that_cant_be_meant(spark, note_rows):
    n = note_rows(
        {"note_id": 1, "stem": "B_INDICE", "partes": "999999999999", "ingested_at": T0},
        {"note_id": 2, "stem": "B_p03", "obra": "[[B_INDICE]]", "parte": "3", "ingested_at": T0},
        {"note_id": 3, "stem": "B_p1500", "obra": "[[B_INDICE]]", "parte": "1500", "ingested_at": T0},
    )
    gone = spark.createDataFrame([("B_p02", T0), ("B_p2000", T0), ("B_p002", T0)], "stem string, removed_at timestamp_ntz")
    assert sorted(tuple(r)[2:] for r in R.gaps(n, gone).collect()) == [(1, 2), (4, 1499), (1501, 999999999999)]
    got = [(r["parte"], r["caso"]) for r in R.found(n, gone).collect()]
    assert len(got) == 2 + 1496 + 1 + 1 and {(2, "deleted"), (2000, "deleted"), (999999999999, "missing"), (1, "missing")} <= set(got)


def test_summary_counts(spark, note_rows):
    rows = [{"note_id": i, "stem": f"s{i}", "obra": "[[gone]]", "parte": "1", "ingested_at": T0} for i in range(5)]
    s = R.summary(R.found(note_rows(*rows, *rows), spark.createDataFrame([], "stem string, removed_at timestamp_ntz"))).collect()
    assert [tuple(x) for x in s] == [("obra", "2024-01", "missing", 5, 5)]
