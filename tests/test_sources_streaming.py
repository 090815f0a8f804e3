import io
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import files, html, mail
from tidemark.sources import changes as feeds
from tidemark.streaming import events as streams


def test_formats_and_office_files(spark, tmp_path):
    def container(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in entries.items():
                z.writestr(name, body)
        return out.getvalue()

    w = 'xmlns:w="w"'
    made = {
        "a.docx": container({"word/document.xml": f"<w:d {w}><w:p><w:t>Hello</w:t><w:t> there</w:t></w:p><w:p><w:t>Bye</w:t></w:p></w:d>"}),
        "b.pptx": container({"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": "<s><p><t>ten</t></p></s>", "ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>"}),
        "c.xlsx": container({"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c><v>7</v></c></row></s>'}),
        "d.docx": b"PK\x03\x04 word/document.xml broken",
        "e.pdf": b"%PDF-1.7", "f.csv": b"a;b\n1;2\n", "g.bin": b"\x00\x01",
    }
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    found = files.read_files(spark, str(tmp_path))
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in found.select("path", files.detect_format(F.col("path"), F.col("content")).alias("kind")).collect()}
    assert kinds == {"a.docx": "docx", "b.pptx": "pptx", "c.xlsx": "xlsx", "d.docx": "docx", "e.pdf": "pdf", "f.csv": "csv", "g.bin": "unknown"}
    texts = {(r["path"].rsplit("/", 1)[1], r["part"]): (r["text"], r["warning"] is None) for r in files.office_text(found).collect()}
    assert texts == {("a.docx", 0): ("Hello there\nBye", True), ("b.pptx", 0): ("two", True), ("b.pptx", 1): ("ten", True), ("c.xlsx", 0): ("Name\t7", True), ("d.docx", 0): (None, False)}


def test_csv_round_trip_with_guard(spark, tmp_path):
    (tmp_path / "in.csv").write_text('name;note\n"a;b";"say ""hi"""\nc;=1+1\n')
    rows = files.read_delimited(spark, str(tmp_path / "in.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a;b", 'say "hi"'), ("c", "=1+1")]
    files.write_csv(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"')
    assert sorted(tuple(r) for r in back.collect()) == [("a;b", 'say "hi"'), ("c", "'=1+1")]
    assert files.sniff_delimiter("a|b\n1|2") == "|" and files.sniff_delimiter("plain") == ","


def test_xml_and_html(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><item><id>1</id><n>a</n></item><item><id>2</id><n>b</n></item></r>")
    assert sorted(tuple(r) for r in files.read_xml(spark, str(tmp_path / "x.xml"), "item", "id int, n string").collect()) == [(1, "a"), (2, "b")]
    page = "<head><title>t</title></head><p>One &amp; two</p><div>three<br>four</div><script>x</script>"
    assert spark.range(1).select(html.to_text(F.lit(page)).alias("t")).first()["t"] == "One & two\nthree\nfour"
    page = "<title>no</title><ul><li>a<b>b</b>c</li><li>d &#233;&#x1F600;</li></ul><!-- <p>gone</p> --><template>t</template><table><tr><td>x</td><td>y</td></tr></table>"
    assert spark.range(1).select(html.to_text(F.lit(page)).alias("t")).first()["t"] == "- abc\n- d é😀\nx y"


def test_mail(spark):
    body = "Thanks for this.\nWill do.\n\n> old\nOn Mon, Jan 5, Ada wrote:\n> older"
    signed = "See you at 5.\n\nBest,\nAda"
    assert mail.new_part(body) == "Thanks for this.\nWill do." and mail.new_part(signed) == "See you at 5."
    assert mail.split_sentences("Dr. Ada agreed. Did you? Yes!\n- first item\n- second item") == ["Dr. Ada agreed.", "Did you?", "Yes!", "first item", "second item"]
    assert mail.chunks("aaaa\n\nbbbb\n\ncccccccccccc", 10) == ["aaaa\n\nbbbb", "cccccccccc", "cc"]
    assert mail.decode_words("=?utf-8?q?Caf=C3=A9?= now") == "Café now"
    df = spark.createDataFrame([("Re: FW: [x] Plan",), (None,)], "s string")
    assert {r[0] for r in df.select(mail.base_subject(F.col("s"))).collect()} == {"[x] Plan", None}
    assert df.select(mail.sentences("s").alias("x")).where("x IS NULL").count() == 1
    senders = spark.createDataFrame([("no-reply@x.io",), ("ada@x.io",)], "s string").select(mail.is_automated(F.col("s")).alias("a"), mail.direction(F.col("s"), ["x.io"]).alias("d"))
    assert {tuple(r) for r in senders.collect()} == {(True, "outbound"), (False, "outbound")}


def replay(spark, df, path, order, files_=4):
    """df written as files in order, and a stream that takes them one by one."""
    rows = df.orderBy(order).collect()
    for k in range(files_):
        spark.createDataFrame(rows[k * len(rows) // files_ : (k + 1) * len(rows) // files_], df.schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(path)


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    base = spark.range(200).select((F.col("id") % 5).alias("user_id"), F.timestamp_seconds(F.col("id") * 2000).alias("ts"), F.col("id").cast("double").alias("value"))
    last = spark.createDataFrame([(9, 10_000_000)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"), F.lit(0.0).alias("value"))  # lets the watermark pass
    stream = replay(spark, base.union(last), str(tmp_path / "in"), "ts")
    got = streams.run_to_end(streams.tumbling_counts(stream, "user_id", "ts", "1 hour", 1), "tumbling", str(tmp_path / "c1"))
    want = streams.tumbling_counts(base, "user_id", "ts", "1 hour", 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = streams.run_to_end(streams.sessions(stream, "user_id", "ts", "3 hours"), "sessions", str(tmp_path / "c2"))
    want = streams.sessions(base, "user_id", "ts", "3 hours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = streams.run_to_end(streams.first_of_each(stream.withColumn("k", F.col("user_id")), ["k"], "ts", "100 days"), "firsts", str(tmp_path / "c3"))
    assert sorted(r["user_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 9]


def test_upsert_sink_and_thread_state(spark, tmp_path):
    changes = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2), (1, "c", 3), (3, "d", 4)], "k int, s string, t int")
    stream = replay(spark, changes, str(tmp_path / "in"), "t", 5)
    sink = streams.UpsertSink(str(tmp_path / "table"), ["k"], ["s"], buckets=2)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    table = lambda: sorted((r["k"], r["s"], r["version"]) for r in sink.current(spark).collect())
    assert table() == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]
    sink(changes.where("t = 4"), 3)  # the last batch once more
    assert table() == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]
    talk = spark.createDataFrame([(1, 0, "user", "hi?"), (1, 1, "assistant", "done"), (2, 0, "user", "when?"), (3, 0, "user", "x"), (3, 1, "assistant", "which one?")], "conv_id long, turn long, role string, text string")
    stream = replay(spark, talk, str(tmp_path / "talk"), "turn", 2)
    got = streams.run_to_end(streams.thread_states(stream), "threads", str(tmp_path / "c2"), "update").collect()
    last = {r["conv_id"]: (r["n"], r["state"]) for r in sorted(got, key=lambda r: r["n"])}
    assert last == {1: (2, "RESOLVED"), 2: (1, "AWAITING_US"), 3: (2, "AWAITING_THEM")}


def test_change_feed_resumes_where_it_ended(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    page = lambda name, rows: (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    page("0001.json", [{"id": str(k), "kind": "doc", "payload": f"v{k}"} for k in range(3)])
    page("0002.json", [{"id": "1", "kind": "doc", "payload": "new"}, {"id": "3", "kind": "doc", "payload": "v3"}])

    def run():
        feed = feeds.change_feed(spark, str(folder), 1)
        feed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 5
    page("0003.json", [{"id": "2", "kind": "doc", "payload": "v2", "deleted": True}])
    rows = run()
    assert rows.count() == 6
    assert {(r["id"], r["payload"], r["deleted"]) for r in feeds.latest(rows).collect()} == {("0", "v0", False), ("1", "new", False), ("2", "v2", True), ("3", "v3", False)}


def test_automated_mail_by_name_and_headers(spark):
    cases = [
        ("acme-newsletter@x.io", {}, True), ("ada.digest+7@x.io", {}, True), ("No-Reply@x.io", {}, True), ("newsroom@x.io", {}, False), ("ada@x.io", {"LIST-ID": "x"}, True), ("ada@x.io", {"Precedence": " Bulk "}, True), ("ada@x.io", {"precedence": "first"}, False),
        ("ada@x.io", {"Auto-Submitted": "auto-replied"}, True), ("ada@x.io", {"auto-submitted": "NO"}, False), ("ada@x.io", None, False), ("updates@x.io", None, True), ("update@x.io", {}, False),
    ]
    df = spark.createDataFrame([(s, h) for s, h, _ in cases], "s string, h map<string,string>")
    assert [r.a for r in df.select(mail.is_automated(F.col("s"), F.col("h")).alias("a")).collect()] == [a for *_, a in cases]
    sent = spark.createDataFrame([("a@own.io", ["b@OWN.io"]), ("a@own.io", ["b@own.io", "c@x.io"]), ("c@x.io", ["a@own.io"]), ("a@own.io", [])], "s string, r array<string>")
    assert [r.d for r in sent.select(mail.direction(F.col("s"), ["own.io"], F.col("r")).alias("d")).collect()] == ["internal", "outbound", "inbound", "outbound"]
    assert [r.d for r in sent.select(mail.direction(F.col("s"), ["own.io"], F.col("r"), ["boss@own.io"]).alias("d")).collect()] == ["internal", "inbound", "inbound", "internal"]
    assert spark.createDataFrame([("Re: ",)], "s string").select(mail.base_subject(F.col("s")).alias("s")).first()[0] == "(no subject)"
