import importlib.util
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tunemill.sources import files, logs, markup, sinks

LOG = "Time (msec),Engine Speed (rpm),Mass Airflow (g/s),Mass Airflow Sensor Voltage (V),Knock Sum (count),Feedback Knock Correction (degrees),Odd\n0,800,2.5,1.1,0,-1.5,x\n\n50,850,n/a,1.2,1\n100,,NaN,1.3,2,0,\n"


def test_roles():
    assert logs.role("Mass Airflow Sensor Voltage") is None and logs.role("Fine Learning Knock Correction") == "fine_knock_learn"
    assert logs.role("Ignition Base Timing* (degrees)") == "timing_base" and logs.role("Closed Loop Fueling Target (lambda)") == "target_afr" and logs.role("nothing") is None
    assert logs.assign(["Knock Sum", "Feedback Knock"]) == ({"knock_retard": "Feedback Knock"}, {"knock_retard": ["Knock Sum", "Feedback Knock"]})


def test_role_column(spark):
    heads = [h for h in LOG.split("\n")[0].split(",")] + ["IAM (multiplier)", "", None]
    got = spark.createDataFrame([(h,) for h in heads], "h string").select("h", logs.role_column(F.col("h")).alias("r")).collect()
    assert all(r.r == (logs.role(r.h) if r.h is not None else None) for r in got)


def test_log_from_text_and_path(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LOG)
    for src in (LOG, str(tmp_path / "a.csv")):
        df, collisions = logs.read_log(spark, src)
        rows = df.collect()
        assert [r.rpm for r in rows] == [800.0, 850.0, None] and [r.maf_gs for r in rows] == [2.5, None, None] and [r.knock_retard for r in rows] == [-1.5, None, 0.0]
        assert list(collisions) == ["knock_retard"]


def test_xml(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.xml").write_text("<roms><rom><romid><xmlid>AB1</xmlid><make>Subaru</make><model>WRX</model><year>2005</year><ecuid>77</ecuid></romid><include>BASE</include><table name='Fuel'/><table name='Boost'/><table/></rom><rom><table name='x'/></rom></roms>")
    (tmp_path / "d/bad.xml").write_text("<roms><rom><romid><xmlid>Z")
    r = files.rom_definitions(spark, str(tmp_path / "d")).collect()
    assert [x.source_id for x in r] == ["AB1"] and r[0].tables == ["Fuel", "Boost"] and r[0].includes == ["BASE"] and "Tunable tables (2):\n  - Fuel" in r[0].text and r[0].title == "Subaru WRX 2005 (AB1)"
    assert [x.xmlid for x in files.rom_ids(spark, str(tmp_path / "d/a.xml")).collect()] == ["AB1"]
    (tmp_path / "l.xml").write_text("<logger><parameter id='P1' name='Load' desc='d'><address>0x07</address><conversions><conversion units='%' expr='x'/><conversion units='%' expr='x/2'/></conversions></parameter><parameter id='P2'/><ecuparam id='E1' name='AVCS'><ecu id='1'/><ecu id='2'/><conversions><conversion units='deg'/></conversions></ecuparam></logger>")
    p = {x.source_id: x for x in files.logger_parameters(spark, str(tmp_path / "l.xml")).collect()}
    assert set(p) == {"P1", "E1"} and p["P1"].units == ["%"] and "conversion(s): %: x; %: x/2" in p["P1"].text and p["E1"].ecus == 2


def test_texts(spark, tmp_path):
    (tmp_path / "m/.git").mkdir(parents=True)
    (tmp_path / "m/a.md").write_text("intro\n# The Title\n" + "x" * 300)
    (tmp_path / "m/b.md").write_text("short")
    (tmp_path / "m/.git/c.md").write_text("y" * 400)
    assert [r.title for r in files.markdown(spark, str(tmp_path / "m")).collect()] == ["The Title"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.ini").write_text('[Other]\ntable = no, m, "No"\n[TableEditor]\ntable = t1, m1, "Fuel"\n  xBins = rpm, a\n  zBins = ve\n\n[CurveEditor]\ncurve = c1, "Warm"\n  xBins = clt\n[End]\nxBins = q\n')
    got = {r.source_id: r for r in files.ini_definitions(spark, str(tmp_path / "i")).collect()}
    assert set(got) == {"table:t1", "curve:c1"} and got["table:t1"].bins == {"xBins": "rpm, a", "zBins": "ve"}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", "<html><head><title>A</title></head><body><p>" + "first " * 30 + "</p></body></html>")
        z.writestr("o/b.html", "<html><body>tiny</body></html>")
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x.epub").write_bytes(data.getvalue())
    (tmp_path / "e/bad.epub").write_bytes(b"no zip")
    got = files.books(spark, str(tmp_path / "e")).collect()
    assert [(r.source_id, r.title) for r in got if r.error is None] == [("x.epub#c1", "A")] and [(r.source_id, r.text) for r in got if r.error] == [("bad.epub", None)]
    (tmp_path / "e/some.pdf").write_bytes(b"%PDF")
    if importlib.util.find_spec("pypdf") is None:
        with pytest.raises(Exception, match="pypdf"):
            files.books(spark, str(tmp_path / "e")).collect()


PAGE = "<html><head><title> T </title><style>x{}</style></head><body><script>1</script><div class='post'><span class='username'>ann</span><time datetime='2024-01-01'></time><div class='content'>Hello   <b>you</b><br>more</div></div><div class='post'><div class='content'>Two</div></div><div class='post'></div><a href='viewtopic.php?t=7&amp;sid=0123456789abcdef0123456789abcdef'>Boost leak</a><a href='viewtopic.php?t=8'>FS: turbo</a></body></html>"


def test_html(spark):
    assert markup.clean(PAGE)[0] == "T" and "x{}" not in markup.clean(PAGE)[1] and markup.clean("") == ("", "")
    assert markup.posts(PAGE, "phpbb") == [(1, "ann", "2024-01-01", "Hello\nyou\nmore"), (2, "?", None, "Two")]
    quoted = "<article class='message'><h4 class='message-name'>bo</h4><div class='bbWrapper'><blockquote class='bbCodeBlock--quote'>old</blockquote>new</div></article>"
    assert markup.posts(quoted, "xenforo") == [(1, "bo", None, "new")]
    pages = spark.createDataFrame([(1, 2, PAGE, "u1"), (1, 1, PAGE, "u2"), (2, 1, None, "u3"), (3, 1, "", "u4")], "thread_id int, page int, html string, url string")
    t = markup.threads(pages, "phpbb").collect()
    assert [(r.thread_id, r.posts) for r in t] == [(1, 4)] and t[0].text.startswith("--- post 1 ---\nann\nHello")
    assert markup.html_documents(pages, 5).count() == 2
    known = spark.createDataFrame([("9",)], "thread_id string")
    assert [(r.thread_id, r.title) for r in markup.discovered(pages.limit(1), known, ["boost", "turbo"], ["fs:"], 5).collect()] == [("7", "Boost leak")]
    assert spark.range(1).select(markup.last_page(F.array(F.lit("a?page=3"), F.lit("x/page-12")))).first()[0] == 12


def test_attachments(spark):
    rows = [(1, "stock 4B12504207.zip", bytearray(b"PK")), (2, "x.zip", bytearray(b"PK")), (3, "tune.hex", bytearray(b"  <html>")), (4, "a.bin", bytearray(b"1"))]
    found = spark.createDataFrame(rows, "attachment_id int, name string, content binary")
    got = {r.attachment_id: (r.rom_id, r.state) for r in files.new_attachments(found, spark.createDataFrame([(4,)], "attachment_id int")).collect()}
    assert got == {1: ("4B12504207", "ok"), 3: (None, "blocked")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "b", [0.0, 0.0]), (3, "b", None)], "id int, part string, v array<double>")
    sinks.store(df, str(tmp_path / "s"), ["part"])
    sinks.store(df.where("part = 'b'").withColumn("id", F.col("id") + 10), str(tmp_path / "s"), ["part"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 12, 13]
    for _ in range(2):
        sinks.audit(df.withColumn("at", F.lit("2025-03-04 05:06:07").cast("timestamp")), str(tmp_path / "a"), "at")
    log = spark.read.json(str(tmp_path / "a"))
    assert log.count() == 6 and log.first().stamp == "2025-03-04T05:06:07Z" and str(log.first().day) == "2025-03-04"
    sinks.vector_index(df, "id", "v", str(tmp_path / "x"))
    index, fresh = sinks.load_index(spark, str(tmp_path / "x"), df.where("id = 1"))
    assert fresh and [list(r.vec) for r in index.collect()] == [[0.6000000238418579, 0.800000011920929]]
    assert not sinks.load_index(spark, str(tmp_path / "x"), df)[1]
    sinks.split_lines(df.withColumn("split", F.lit("val")), str(tmp_path / "j"))
    assert files.json_lines(spark, str(tmp_path / "j"), "id int, part string, split string").count() == 3
    assert sinks.markdown_table(df, ["id", "part"], [F.asc("id")]).split("\n")[2] == "| 1 | a |"
    runs = spark.createDataFrame([("s", 1, 5, None), ("t", None, None, "x" * 200)], "source string, new_count int, fetched int, error string")
    assert sinks.summary(runs)["new"] == 1 and sinks.summary(runs)["failed"] == 1
    for name in ("r-m1-a.json", "r-m1-b.json", "r-m2-a.json"):
        (tmp_path / "n").mkdir(exist_ok=True)
        (tmp_path / "n" / name).write_text('{"q": "%s"}\n\n' % name)
    assert sorted(r.q for r in files.newest_per_tag(spark, str(tmp_path / "n"), "q string", "r-(m\\d)-").collect()) == ["r-m1-b.json", "r-m2-a.json"]
    for name in ("A-1", "A-2", "B-1"):
        spark.createDataFrame([(name,), (name,)], "q string").repartition(2).write.json(str(tmp_path / "m" / f"file={name}"))
    assert sorted(r.q for r in files.newest_per_tag(spark, str(tmp_path / "m"), "q string", r"=(\w)-").collect()) == ["A-2", "A-2", "B-1", "B-1"]
    (tmp_path / "j.json").write_text('{"a": 1}\n\nbroken\n')
    assert files.json_lines(spark, str(tmp_path / "j.json"), "a int").count() == 1
    assert sorted(((r.a, r.bad) for r in files.json_lines(spark, str(tmp_path / "j.json"), "a int", "bad").collect()), key=str) == [(1, None), (None, "broken")]
    assert set(files.REGISTRY) >= {"rom_defs", "ini_defs"}
    assert [r[0] for r in spark.createDataFrame([(429,), (500,), (404,), (None,)], "s int").select(files.retryable(F.col("s"))).collect()] == [True, True, False, True]


def test_keyed_store_and_reports(spark, tmp_path):
    path, row = str(tmp_path / "store"), "k int, v string, at int"
    sinks.put(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 2)], row), path, ["k"], [F.desc("at")])
    sinks.put(spark.createDataFrame([(2, "d", 0), (3, "e", 0)], row), path, ["k"], [F.desc("at")])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    sinks.replace(spark.read.parquet(path).where("k > 1"), path)
    assert spark.read.parquet(path).count() == 2 and not list(tmp_path.glob("store._*"))
    note = str(tmp_path / "report.json")
    asked = spark.createDataFrame([(1,), (2,)], "id int")
    assert sinks.resumed(spark, note, "id int", ["id"], asked).count() == 2
    for text in ('{"id": 1}\n', '{"id": 1}\n{"id": 2}\n'):
        sinks.report(text, spark, note)
    assert open(note).read().count("id") == 2 and sinks.resumed(spark, note, "id int", ["id"], asked).count() == 0
