import io
import json
import sqlite3
import zipfile

import pytest

from quern.config import PipelineConfig, RetrievalConfig, project_root
from quern.plans import pipeline
from quern.plans.naturalize import load_cache, with_sentence
from quern.providers import HashEmbedder, stream_tokens, with_retry
from quern.sinks import counted, write_json_array, write_json_lines, write_json_lines_pretty
from quern.sources.files import expand, only_file, read_files, text_of
from quern.sources.jsonl import normalized, read_json_lines
from quern.sources.sqlite import read_news_table
from quern.streaming.ingest import append_unseen, conversation_memory, stream_json_lines, upsert_stream


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>一</w:t></w:r><w:r><w:tab/><w:t>b</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>"})
PN = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
SLIDE = "<p:sld {0}><p:sp><p:txBody><a:p><a:r><a:t>{1}</a:t></a:r></a:p></p:txBody></p:sp><p:sp/></p:sld>"
PPTX = packed({f"ppt/slides/slide{i}.xml": SLIDE.format(PN, f"s{i}") for i in (10, 2)})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = packed(
    {
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="表" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>x</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>y</t></is></c></row></sheetData></worksheet>',
    }
)


def test_office_texts():
    assert text_of("a.DOCX", DOCX) == "一\tb\n\nc"
    assert text_of("a.pptx", PPTX) == "s2\ns10\n"
    assert text_of("a.xlsx", XLSX) == "--- SHEET 表 ---\nx\t\t3\n\t\t\n\ty\t"
    assert text_of("a.csv", b'a,b\r\n01,"x,y"\r\n') == 'a,b\n01,"x,y"\n'
    with pytest.raises(ValueError, match="no reader"):
        text_of("a.exe", b"")


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("一\n二", encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"k": 1}]')
    (tmp_path / "c.exe").write_bytes(b"x")
    rows = {r.source.rsplit("/", 1)[1]: (r.text, r.error) for r in read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == ("一\n二", None) and rows["b.json"][0] == "--- ITEM 1 ---\nk: 1" and rows["c.exe"][0] is None and "no reader" in rows["c.exe"][1]
    assert only_file(str(tmp_path)) is None
    (tmp_path / "b.json").unlink()
    assert only_file(str(tmp_path)).endswith("a.txt") and expand("*.txt, a.*", str(tmp_path)) == [str(tmp_path / "a.txt")]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "n.db") as con:
        con.execute('CREATE TABLE latest_news ("標題" TEXT, "連結" TEXT, n INTEGER)')
        con.executemany("INSERT INTO latest_news VALUES (?, ?, ?)", [(f"t{i}", f"u{i}", i) for i in range(20)])
    df = read_news_table(spark, str(tmp_path / "n.db"))
    assert df.count() == 20 and {"title", "url", "html_text", "pdf_text", "published_at", "text"} <= set(df.columns)
    assert {r.html_text for r in df.collect()} == {""}


RECORDS = [
    {"title": "", "標題": "T", "pdf_url": "P", "內文": " h ", "pdf_text": "p"},
    {"type": "course_table_row", "semester": "一上", "course_name": "物理", "credit": 3, "url": "u"},
    {"doc_id": "d", "checksum_clean": "c", "text": "x"},
    {"doc_id": "e", "checksum_clean": "c", "text": "second"},
]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS) + "\n\n{broken\n", encoding="utf-8")
    rows = {r.title + (r.doc_id if r.text == "x" else ""): r for r in normalized(read_json_lines(spark, [str(path)])).collect()}
    assert len(rows) == 3 and rows["T"].url == "P" and rows["T"].text == "h\n\np" and rows["d"].checksum == "c"
    assert any(r.text == "一上｜物理｜3 學分" for r in rows.values())


def test_sentences_come_from_cache_model_or_rule(spark):
    class Model:
        def generate(self, messages):
            return "課程物理在一上，3 學分" if "物理" in messages[1]["content"] else "無關"

    rows = [("course_table_row", t, "一上", None, None, n, "3", c) for t, n, c in (("T", "物理", "k1"), ("T", "化學", "k2"), ("T", "數學", "k3"))] + [("department_member_row", "M", None, None, None, None, None, "k4")]
    df = spark.createDataFrame(rows, "type string, title string, semester string, category string, sub_category string, course_name string, credit string, checksum string").selectExpr("*", "'u' AS url", "'' AS published_at")
    cache = load_cache(spark.createDataFrame([("k3", "old", 1), ("k3", "kept", 2)], "key string, text string, seq int"))
    out, entries = with_sentence(df, cache, Model())
    got = {r.checksum: r.sentence for r in out.collect()}
    assert got["k1"] == "課程物理在一上，3 學分。" and got["k2"].startswith("T，在大一上學期") and got["k3"] == "kept" and got["k4"] == "無關。"
    assert {r.sentence for r in with_sentence(df.where("checksum = 'k4'"))[0].collect()} == {""}
    assert sorted(r.key for r in entries.collect()) == ["k1", "k2", "k4"]


def test_sinks(spark, tmp_path):
    import datetime as dt

    df, seen = counted(spark.createDataFrame([(1, None), (2, "二")], "a int, b string"))
    write_json_lines(df, str(tmp_path / "l"))
    assert seen.get["rows"] == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"二"}']
    write_json_lines_pretty(df, str(tmp_path / "p"))
    path = write_json_array(df, str(tmp_path), "x", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("x_20240102_030405.json") and json.load(open(path)) == [{"a": 1, "b": None}, {"a": 2, "b": "二"}]


def test_pipeline_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([("1", "甲", "u1", "113.03.27", "", "", "圖書館十點開門。借書需證件。"), ("2", "乙", "u2", "", "<p>體育館 visa letter</p>", "", ""), ("3", "甲", "u1", "113.03.27", "", "", "圖書館十點開門。借書需證件。")], "doc_id string, title string, url string, published_at string, html_text string, pdf_text string, text string")
    cfg = PipelineConfig(str(tmp_path / "out"), site_slug="s")
    first = pipeline.run_pipeline(docs, cfg)
    assert first == {"documents": 2, "chunks": 2, "vectors": 2, "text": 2} == pipeline.run_pipeline(docs, cfg)
    queries = spark.createDataFrame([(1, "圖書館十點開門"), (2, "visa letter"), (3, "你好")], "query_id int, query string")
    hits = pipeline.retrieve(spark, queries, cfg.out, RetrievalConfig(use_text=True))
    best = {r.query_id: r.meta["title"] for r in hits.where("rank = 1").collect()}
    assert best == {1: "甲", 2: "乙"}
    asked = {r.query_id: r.messages[1].content for r in pipeline.answers_input(queries, hits).collect()}
    assert "[1] 甲" in asked[1] and asked[3].startswith("問題：你好")
    assert pipeline.inspect(spark.read.parquet(f"{cfg.out}/vectors")).first().dims == 64


def test_streams(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for i in range(3):
        (feed / f"f{i}.jsonl").write_text("\n".join(json.dumps({"checksum_clean": c, "text": f"{i}{c}", "doc_id": f"d{i}"}) for c in "ab" + "cde"[i]))
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    for _ in range(2):
        append_unseen(stream_json_lines(spark, str(feed)), table, "checksum_clean", ["text"], checkpoint).awaitTermination()
    assert sorted(r.checksum_clean for r in spark.read.parquet(table).collect()) == list("abcde")
    upsert_stream(stream_json_lines(spark, str(feed)), str(tmp_path / "u"), "checksum_clean", ["text"], str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "u")).count() == 5
    turns = tmp_path / "turns"
    spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "bot", "b"), (2, 1, "user", "c")], "conv_id long, turn long, role string, text string").write.parquet(str(turns))
    stream = conversation_memory(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(turns)))
    stream.writeStream.format("memory").queryName("memory_out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.conv_id, r.turn): r.history for r in spark.table("memory_out").collect()} == {(1, 1): "user: a", (1, 2): "user: a\nbot: b", (2, 1): "user: c"}


def test_providers():
    a, b = HashEmbedder(16).embed(["x y", "x y"])
    assert (a == b).all() and abs((a**2).sum() - 1) < 1e-6
    assert list(stream_tokens(['{"message": {"content": "a"}}', "", "bad", '{"message": {"content": "b"}, "done": true}', '{"message": {"content": "c"}}'])) == ["a", "b"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise OSError
        return "ok"

    assert with_retry(flaky, pause=0) == "ok"
    assert project_root(__file__).name


def test_ingest_and_prompts(spark, tmp_path, capsys):
    from quern.__main__ import main

    (tmp_path / "a.txt").write_text("圖書館十點開門\n\n" + "x" * 30, encoding="utf-8")
    out = str(tmp_path / "v")
    assert pipeline.ingest(spark, [str(tmp_path / "a.txt")], out, 20, 5) == pipeline.ingest(spark, [str(tmp_path / "a.txt")], out, 20, 5) == 3
    assert pipeline.ingest(spark, [str(tmp_path / "a.txt")], out, 20, 5, append=True) == 6
    assert pipeline.ingest(spark, [str(tmp_path / "a.txt")], out, 20, 5, reset=True) == 3
    queries = spark.createDataFrame([(1, "圖書館")], "query_id int, query string")
    history = spark.createDataFrame([(1, "user: hi")], "query_id int, history string")
    text = pipeline.assistant_prompts(queries, spark.read.parquet(out), history).first().prompt
    assert "圖書館十點開門" in text and "user: hi" in text and text.endswith("圖書館")
    (tmp_path / "r.jsonl").write_text(json.dumps({"text": "甲。", "title": "T", "url": "u"}), encoding="utf-8")
    main(["build", "--in-jsonl", str(tmp_path / "*.jsonl"), "--out", str(tmp_path / "b")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["chunks"] == 1
    assert spark.read.parquet(str(tmp_path / "b" / "vectors")).first().metadata["site_slug"] == "r"
