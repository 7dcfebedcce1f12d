import json
import os

from tabularium.sources import markdown as M
from tabularium.sources.tables import clear_cuts, cut, shared_dir
from tabularium.streaming import incoming


def test_scan_ledger_and_export(spark, tmp_path):
    root = tmp_path / "Radar" / "vault"  # a folder above the root may bear an ignored name
    for name, text in {"01-Doutrina/a b.md": "um\ndois", "Radar/x.md": "não", "_skip.md": "não", "RELATORIO.md": "não", "b+c.md": "três", "n.txt": "não"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    got = {r["path"]: (r["stem"], r["text"]) for r in M.scan(spark, str(root)).collect()}
    assert got == {"01-Doutrina/a b.md": ("a b", "um\ndois"), "b+c.md": ("b+c", "três")}
    assert M.ledger(spark, str(tmp_path / "none.csv")).collect() == []
    row = spark.createDataFrame([tuple(f'v"{i}' if i % 2 else None for i in range(16))], ", ".join(f"{c} string" for c in M.LEDGER))
    M.write_ledger(row, str(tmp_path / "ledger"))
    back = M.ledger(spark, str(tmp_path / "ledger")).first()
    assert back["caminho"] == 'v"1' and len(back) == 16
    out = tmp_path / "out"
    assert M.export(spark.createDataFrame([("a/b.md", "x"), ("../../c.md", None)], "path string, text string"), str(out)) == 2
    assert sorted(os.listdir(out)) == ["a", "c.md"] and (out / "a" / "b.md").read_text() == "x"
    (tmp_path / "list").write_bytes(b"a\0b c\0")
    assert [r["path"] for r in M.nul_list(spark, str(tmp_path / "list")).collect()] == ["a", "b c"]


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1, 2], None), (None, [], "x")], "a bigint, b array<int>, c string")
    again = cut(df)
    assert again.schema.simpleString() == df.schema.simpleString() and again.count() == 2
    assert shared_dir(spark).startswith("file:")
    assert clear_cuts(spark) >= 1 and clear_cuts(spark) == 0


def test_incoming_works_on_each_content_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    notes = spark.createDataFrame([(1, "lei", "5172"), (2, "lei", "8666")], "note_id bigint, label string, num string")
    write = lambda name, title, text: (inbox / name).write_text(json.dumps({"titulo": title, "corpo": text, "area": ["Civil"]}))
    write("a.json", "um", "muda a Lei 5.172")
    args = (spark, str(inbox), notes, str(tmp_path / "out"), str(tmp_path / "ck"))
    incoming.start(*args).awaitTermination()
    write("copy.json", "um", "muda a Lei 5.172")
    write("b.json", "dois", "revoga a Lei 8.666")
    incoming.start(*args).awaitTermination()
    got = sorted((r["note_id"], r["common"]) for r in spark.read.parquet(str(tmp_path / "out" / "matches")).collect())
    assert got == [(1, 1), (2, 1)]


def test_intake(spark):
    rows = [("a", "x", None, "2024-01-01"), ("", "x", None, None), ("b", " ", None, None), ("c", "x", "ftp://y", None), ("old", "x", "https://y", "soon"), ("d", "x", "https://y", "soon")]
    f = spark.createDataFrame([(t, None, None, d, None, u, None, c) for t, c, u, d in rows], incoming.FINDING)
    got = {r["titulo"]: (r["accepted"], r["reason"], r["warning"], r["data"]) for r in incoming.intake(f, spark.createDataFrame([("old",)], "titulo string"), "2026-01-01").collect()}
    assert got["a"] == (True, None, None, "2024-01-01") and got["d"] == (True, None, "date", "2026-01-01")
    assert [got[k][1] for k in ("", "b", "c", "old")] == ["no title", "no text", "address", "exists"]


def test_windows_over_a_stream_equal_those_over_the_table(spark, tmp_path):
    from datetime import datetime, timedelta

    from tabularium.streaming import windows as W

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, "a" if i % 2 else "b", float(i)) for i in range(200)]
    e = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "events"))
    late = spark.createDataFrame([(999, t0 + timedelta(days=40), 1, "a", 0.0)], e.schema)  # moves the watermark past every window
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    q = W.tumbling(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("tumbled").where("start < '2024-02-01'").collect()}
    assert got == {tuple(r) for r in W.tumbling(e, "1 hour").collect()} and got
