import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quern.sources import events, files, objects
from quern.streaming import ingest


def office(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XLSX = office({
    "xl/workbook.xml": f'<workbook xmlns:r="{R}"><sheets><sheet name="Marks" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t> name </t></si><si><r><t>two</t></r><r><t>parts</t></r></si></sst>",
    "xl/worksheets/a.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"/></row><row><c r="A3"><v>4.5</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/b.xml": "<worksheet><sheetData/></worksheet>",
})
DOCX = office({
    "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Lead</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Energy</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p></w:body></w:document>',
    "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="a" Target="media/i.png"/><Relationship Id="b" Target="media/j.png"/></Relationships>',
    "word/media/i.png": b"same",
    "word/media/j.png": b"same",
})
PPTX = office({
    "ppt/presentation.xml": f'<p xmlns:r="{R}"><sldIdLst><sldId r:id="r1"/></sldIdLst></p>',
    "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s1.xml"/></Relationships>',
    "ppt/slides/s1.xml": '<sld><sp><txBody><p><r><t>Body</t></r></p></txBody></sp><sp><nvPr><ph type="title"/></nvPr><txBody><p><r><t>Title</t></r></p></txBody></sp></sld>',
})


def test_readers(spark):
    rows = [
        ("/a/x.txt", b"hi \xff", None),
        ("/a/x.HTML", b"<style>s</style><p> One <b>two</b></p><script>x()</script>", None),
        ("/a/x.csv", b"a , b\n1,2\n", None),
        ("/a/x.tsv", b"a\tb", None),
        ("/a/x.jsonl", b'{"a": "\xc3\xa9"}\n\n{"b": 1}\n', None),
        ("/a/bad.json", b"{", None),
        ("/a/x.xlsx", XLSX, None),
        ("/a/x.docx", DOCX, None),
        ("/a/x.pptx", PPTX, None),
        ("/a/p.png", b"png", None),
        ("/a/noext", b"text", "text/markdown"),
        ("/a/y.bin", b"?", "application/octet-stream"),
        ("/a/z.pdf", b"%PDF-", None),
        ("/a/none.txt", None, None),
        (None, b"x", "text/plain"),
    ]
    got = {}
    for r in files.units(spark.createDataFrame(rows, "path string, content binary, content_type string")).collect():
        got.setdefault(r.path, []).append(r)
    text = lambda p: [b.text for r in got[p] for b in r.blocks]
    assert text("/a/x.txt") == ["hi �"]
    assert text("/a/x.HTML") == ["One\ntwo"]
    assert text("/a/x.csv") == ["a | b\n1 | 2"] and text("/a/x.tsv") == ["a | b"]
    assert json.loads(text("/a/x.jsonl")[0]) == [{"a": "é"}, {"b": 1}]
    assert got["/a/bad.json"][0].error.startswith("JSONDecodeError")
    assert [(r.unit, r.label) for r in got["/a/x.xlsx"]] == [(1, "Marks"), (2, "Empty")] and text("/a/x.xlsx") == ["name |  | twoparts\n4.5 | x"]
    doc = got["/a/x.docx"][0]
    assert [(b.block_type, b.text, b.section_path) for b in doc.blocks] == [("paragraph", "Lead", []), ("heading", "Energy", ["Energy"]), ("list", "item", ["Energy"]), ("table", "a | b", ["Energy"])]
    assert len(doc.assets) == 1
    assert [(b.block_type, b.text) for b in got["/a/x.pptx"][0].blocks] == [("heading", "Title"), ("paragraph", "Body")] and got["/a/x.pptx"][0].label == "Title"
    assert text("/a/p.png") == ["Image: p.png"] and got["/a/p.png"][0].assets[0].extension == "png"
    assert text("/a/noext") == ["text"] and text(None) == ["x"]
    assert got["/a/y.bin"][0].error == "ValueError: unsupported" == got["/a/z.pdf"][0].error
    assert got["/a/none.txt"][0].error == "ValueError: no content"


def test_scan_and_hooks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    known = files.readers(pdf=lambda data, name: [files.Unit(n, f"p{n}", [files.block("text", "page")]) for n in (1, 2, 3)], ocr=None)
    rows = files.units(files.scan(spark, f"file://{tmp_path}"), known)
    assert sorted((r.reader, r.unit) for r in rows.collect()) == [("pdf", 1), ("pdf", 2), ("pdf", 3), ("text", 1)]
    assert files.blocks(rows, "reader").count() == 4
    limited = files.units(files.scan(spark, f"file://{tmp_path}"), known, most_units=2).where("reader = 'pdf'").collect()
    assert [r.error for r in limited] == ["ValueError: more than 2 units"]


def test_small_files_share_batches(monkeypatch):
    """A batch holds units of many files, but no more than so many or so many bytes; order and content stay."""
    rows = [{"path": f"/a/{n}.txt", "content": b"x" * (n % 50), "reader": "text" if n % 5 else None} for n in range(2500)]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=700)
    for most, least in ((files.BATCH_BYTES, 3), (100, 300)):
        monkeypatch.setattr(files, "BATCH_BYTES", most)
        found = list(files.parsed(batches, {"text": files.read_text}, 2000))
        assert least <= len(found) < 1300 and all(b.num_rows <= files.BATCH_UNITS for b in found)
        got = [r for b in found for r in b.to_pylist()]
        assert [r["path"] for r in got] == [r["path"] for r in rows]
        assert [r["error"] or r["blocks"][0]["text"] for r in got] == [r["content"].decode() if r["reader"] else "ValueError: unsupported" for r in rows]
    several = lambda data, name: [files.Unit(n, "p") for n in range(600)]
    assert [b.num_rows for b in files.parsed(batches[:1], {"text": several}, 599)] == [700]


def test_objects(spark):
    keys = [("a/b.pdf", True), ("/a", False), ("a/../b", False), ("", False), (None, False), ("a..b/c", True)]
    rows = spark.createDataFrame(keys, "k string, ok boolean").coalesce(1)
    assert all(r.x == r.ok for r in rows.select("ok", objects.safe_key(F.col("k")).alias("x")).collect())
    names = [("a.PDF", None, ".pdf"), ("a", "text/html", ".html"), ("a", "x/y", ".bin"), ("a", None, ".bin")]
    rows = spark.createDataFrame(names, "n string, m string, want string").coalesce(1)
    assert all(r.x == r.want for r in rows.select("want", objects.suffix(F.col("n"), F.col("m")).alias("x")).collect())
    ups = [(5, b"%PDF-1", "ok"), (5, b"nope!", "not_pdf"), (objects.UPLOAD_BYTES + 1, b"%PDF-", "too_large"), (0, b"", "empty"), (None, None, "empty")]
    rows = spark.createDataFrame(ups, "s bigint, c binary, want string").coalesce(1)
    assert all(r.x == r.want for r in rows.select("want", objects.admission(F.col("s"), F.col("c")).alias("x")).collect())


def test_upload_events(spark):
    good = {"doc_id": "d", "user_id": "u", "source_name": "s", "storage_key": "u/d/s.pdf", "content_type": "application/pdf"}
    values = [json.dumps(good), json.dumps(good | {"job_id": "j", "other": 1}), json.dumps(good | {"doc_id": ""}), json.dumps(good | {"storage_key": "/abs"}), json.dumps(good | {"storage_key": "a/../b"}), json.dumps(good | {"size_bytes": -1}), "no json", "[1]"]
    rows = spark.createDataFrame([(i, v.encode()) for i, v in enumerate(values)] + [(8, b"\xff\xfe"), (9, None)], "offset bigint, value binary")
    got = {r.offset: r for r in events.decode_uploads(rows).collect()}
    assert [got[i].reject_reason for i in range(10)] == [None, None, "decode:doc_id", "decode:storage_key", "decode:storage_key", "decode:size_bytes", "decode:json", "decode:json", "decode:json", "decode:json"]
    assert got[0].event.job_id == "d" and got[1].event.job_id == "j" and got[0].event.schema_version == 1 and got[2].event is None
    assert events.dead_letters(events.decode_uploads(rows), "offset", "value").count() == 8


def test_chunk_events(spark):
    chunk = {"chunk_id": "c", "doc_id": "d", "user_id": "u", "text": "t", "extra": {"user_id": "v", "k": "w"}}
    values = [{"chunk": chunk, "collection": "foreign"}, chunk, {"chunk": {"text": "x", "extra": {"chunk_id": "c2", "doc_id": "d", "user_id": "u"}, "embed_text": " "}}, {"chunk": {"text": "x"}}]
    rows = spark.createDataFrame([(i, json.dumps(v).encode()) for i, v in enumerate(values)] + [(4, b"\xff")], "offset bigint, value binary")
    got = {r.offset: r for r in events.decode_chunks(rows).collect()}
    assert [got[i].reject_reason for i in range(5)] == [None, None, None, "decode:chunk_id", "decode:json"]
    assert got[0].chunk.user_id == got[1].chunk.user_id == "v" and got[0].chunk.extra["k"] == "w"
    assert got[2].chunk.chunk_id == "c2" and got[2].chunk.embed_text == "x" and got[2].chunk.block_type == "text"
    wired = spark.createDataFrame([("c", "table")], "chunk_id string, block_type string")
    assert json.loads(wired.select(events.wire(wired).alias("w")).first().w) == {"chunk_id": "c", "type": "table", "block_type": "table"}


def test_large_files_are_read_by_ranges(spark, tmp_path):
    import json

    from quern.sources import files

    rows = [f'{i},"name {i}, jr", padded {i} ' for i in range(3000)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "big.csv").write_text("\n".join(rows) + "\n\n")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "big.jsonl").write_text("\n".join("{broken" if i == 7 else json.dumps({"i": i, "é": None}) for i in range(500)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        units = files.line_units(spark, str(tmp_path / "c"), "csv", 100).orderBy("unit").collect()
        assert len({u.path for u in units}) == 1 and len(units) > 30 and [u.unit for u in units] == list(range(1, len(units) + 1))
        whole = next(files.read_csv((tmp_path / "c" / "big.csv").read_bytes(), "big.csv")).blocks[0]["text"]
        assert "\n".join(u.blocks[0].text for u in units) == whole.strip() and max(u.blocks[0].text.count("\n") for u in units) < 100
        lines = files.line_units(spark, str(tmp_path / "j"), "jsonl", 400).orderBy("unit").collect()
        assert [u.error is None for u in lines].count(False) == 1 and lines[0].error.startswith("JSONDecodeError")
        assert [json.loads(x)["i"] for u in lines for x in u.blocks[0].text.split("\n")] == [i for i in range(500) if i != 7]
    finally:
        spark.conf.set(name, before)


def test_a_message_is_parsed_once(spark):
    """Conditions on what was read don't have each message parsed anew."""
    rows = spark.createDataFrame([(b"{}", "t", 0, 1)], "value binary, topic string, partition int, offset bigint").withColumn("key", F.col("value"))
    for found in ingest.accepted(rows):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("from_json") + plan.count("JsonToStructs") + plan.count("jsontostructs") <= 2
